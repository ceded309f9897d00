"""The burst trie against a plain trie of dictionaries, with limits low enough that containers burst again and again."""

import hashlib
import random
import zlib

import pytest

from paperloom.llm import conversation_trie as ct

from ..conftest import rows_of


def plain(rows, group=5, most=9):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = own.get(c - c % group, [])[:h] + t[h:]
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[c] for c in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "", "long text"])) for c in range(60) for t in range(rng.randrange(1, 7))]
    for c in range(100, 160):  # a long shared path that parts late, and copies
        rows += [(c, t, "user", f"turn {t}") for t in range(40 + (c % 7 == 0) * c % 11)]
    for c in range(200, 230):  # a caterpillar: each stops one turn later
        rows += [(c, t, "user", "same") for t in range(c - 199)]
    rows += [(7, 1, None, None), (8, None, "user", "first"), (8, None, "user", None), (9, 1, "user", "x"), (9, 1, "user", "x"), (9, 1, "user", "y")]
    rows += [(301, 1, "u", "only")] * 3 + [(302, 0, "u", "no parent")]  # parents 300 and 305 are absent
    rows += [(None, 1, "user", "nobody's"), (-3, 0, "u", "negative")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, ids string"


@pytest.fixture(scope="module")
def conversations(spark):
    rows = [r for r in cases() if r[0] is None or r[0] >= 0]  # % of negative numbers differs between Python and SQL
    return rows, spark.createDataFrame([(*r, "k", 3, "i") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("limit", [3, 60, 10**9])
def test_against_plain(conversations, limit):
    rows, table = conversations
    assert sorted(map(tuple, ct.prefix_trie(table, limit).collect()), key=str) == plain(rows)


def test_pieces_of_long_conversations_and_many_members(conversations, monkeypatch):
    rows, table = conversations
    monkeypatch.setattr(ct, "RUN", 4)
    assert sorted(map(tuple, ct.prefix_trie(table, 60).collect()), key=str) == plain(rows)


def test_root_alone_turnless_and_empty(spark):
    small = lambda rows: spark.createDataFrame([(*r, "k", 3, "i") for r in rows], SCHEMA)
    assert ct.prefix_trie(small([])).count() == 0
    for rows in ([(11, 0, "u", "t")], [(5, 0, "u", "t")], [(c, 0, "u", "t") for c in range(1, 5)]):
        assert sorted(map(tuple, ct.prefix_trie(small(rows)).collect()), key=str) == plain(rows)


def test_containers_stay_small(conversations):
    """What a container holds is bounded: more than one suffix only up to the limit."""
    _, table = conversations
    state = ct.suffixes(ct.rebuilt(ct.sequences(ct.turn_ids(table))))
    assert ct._bursting(state.selectExpr("x'' AS key", "cast(null AS binary) AS up", "cast(null AS long) AS up_conv", "0 AS depth", "*"), 10**9).count() == 0
    big = ct._bursting(state.selectExpr("x'' AS key", "cast(null AS binary) AS up", "cast(null AS long) AS up_conv", "0 AS depth", "*"), 0).collect()
    assert len(big) == 1 and big[0].to == 0


def test_query(spark, sf, duck):
    got, want = ct.op13_conversation_trie(spark, sf).toPandas(), duck.sql(ct.OP13_SQL).df()
    assert rows_of(got) == rows_of(want)
