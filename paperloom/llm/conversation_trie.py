"""The prefix trie of conversations, built as a burst trie.

A turn becomes a fixed-width id: the MD5 of its role and text, then the length of the text. A conversation is its ids in a
row, so comparing bytes compares sequences of turns. Equal conversations are one suffix with a count from the start.

The root is the first trie head. Below each head, shards hold containers: the suffixes that share the head and one next
turn. A container with too many turns bursts by next turn id: what all its suffixes share (from the least to the greatest
suffix) becomes a chain of heads, and each next turn below it a new container. Containers that stay are dealt to shards,
sorted there and swept into nodes one at a time, in memory that the container's size bounds. Sums over subtrees come from
the sweep inside containers, and for heads from their containers, burst by burst from the bottom.

No step gathers a conversation's rows, a group of copies or a container in one task before it is cut into bounded parts: turns are
ordered by range, so a conversation of any length spans tasks and meets in pieces of RUN turns; member ids are ordered by range and hashed
from runs of them (one SHA-256 per node is a sequence by nature, so its runs are streamed, never held).

Defined results: null role and null text are empty; a null turn comes first; turns with the same number go by their id,
repeated rows are repeated turns; rows without conv_id belong to no conversation and are left out; an empty table gives no node,
not even a root; other columns are ignored. A conversation's ids fit one value (100 million turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, table, written

#: Bytes of a turn's id, the last four of them the length of its text.
WIDTH = 20
#: Turns, or member ids, of one piece of a run.
RUN = 1 << 15
#: Turns in a container's suffixes above which it bursts.
LIMIT = 1024
NO_ENDS = hashlib.sha256().hexdigest()
NODE = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "up": pa.binary(),
}
NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up binary"


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id): a turn's id is known from its own row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text))
    return conversations.where("conv_id is not null").select("conv_id", "turn", F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0"))).alias("id"))


def _runs(batches: Iterator[pa.RecordBatch], key: str, value: str, first: list[str], join: bytes) -> Iterator[pa.RecordBatch]:
    """Sorted rows in runs of at most RUN rows of one key: key, the run's first row in other columns, its values joined as bytes."""
    held: list[bytes] = []
    head: list = []
    done: list[list] = []

    def close() -> None:
        if held:
            done.append([*head, join.join(held)])
            held.clear()

    for batch in batches:
        keys, values = batch.column(key).to_pylist(), batch.column(value).to_pylist()
        firsts = [batch.column(c).to_pylist() for c in first]
        for i, k in enumerate(keys):
            if not held or k != head[0] or len(held) == RUN:
                close()
                head = [k, *(f[i] for f in firsts)]
            held.append(values[i])
        types = [batch.schema.field(c).type for c in (key, *first)]
        names = [key, *(f"first_{c}" for c in first), "run"]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate([*types, pa.binary()])], names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate([*types, pa.binary()])], names)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, ids): the ids of each conversation's turns in order. turns is read twice, so it should be a written table."""
    order = ("conv_id", "turn", "id")
    rows = turns.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    runs = rows.mapInArrow(lambda b: _runs(b, "conv_id", "id", ["turn", "id"], b""), "conv_id long, first_turn long, first_id binary, run binary")
    whole = F.sort_array(F.collect_list(F.struct("first_turn", "first_id", "run")))
    return runs.groupBy("conv_id").agg(F.aggregate(whole, F.lit(b""), lambda a, x: F.concat(a, x["run"])).alias("ids"))


def rebuilt(own: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % group and its own turns after its first h; h = crc32(c) % most."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % most * WIDTH).cast("int")
    heads = own.where(c % group == 0).select(c.alias("p"), F.substring("ids", 1, (most - 1) * WIDTH).alias("head"))
    d = own.select(c, (c - c % group).alias("p"), h.alias("h"), "ids").join(heads, "p", "left")
    return d.select(c, F.concat(F.coalesce(F.substring("head", F.lit(1), F.col("h")), F.lit(b"")), F.substr("ids", F.col("h") + 1)).alias("ids"))


def member_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): the SHA-256 of the conv_ids of each sequence, ascending. members (seq, conv_id) is read twice."""
    text = F.col("conv_id").cast("string").cast("binary").alias("text")
    rows = members.repartitionByRange(shuffle_parts(members.sparkSession), "seq", "conv_id").sortWithinPartitions("seq", "conv_id").select("seq", "conv_id", text)
    runs = rows.mapInArrow(lambda b: _runs(b, "seq", "text", ["conv_id"], b","), "seq binary, first_conv_id long, run binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, out = [], []
            for seq, run in zip(batch.column("seq").to_pylist(), batch.column("run").to_pylist()):
                if seq != now:
                    if state:
                        keys.append(now)
                        out.append(state.hexdigest())
                    now, state = seq, hashlib.sha256(run)
                else:
                    state.update(b"," + run)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], ["seq", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["seq", "ends"])

    return runs.repartition("seq").sortWithinPartitions("seq", "first_conv_id").mapInArrow(hashed, "seq binary, ends string")


def suffixes(conversations: DataFrame) -> DataFrame:
    """(ids, n, conv_id, ends): each distinct sequence (conv_id, ids) once, with how many have it, the least of them and the digest of all."""
    seq = F.unhex(F.md5("ids")).alias("seq")
    once = conversations.groupBy("ids").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ends = member_digests(conversations.select(seq, "conv_id"))
    return once.select("*", seq).join(ends, "seq").drop("seq")


def _bursting(state: DataFrame, limit: int) -> DataFrame:
    """The containers with more turns than limit: their head, the depth `to` down to which all suffixes agree, and the path there."""
    size = (F.octet_length("ids") / WIDTH).cast("long")
    same = {c: F.min(c).alias(c) for c in ("up", "up_conv", "depth")}
    d = state.groupBy("key").agg(
        *same.values(), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.count("*").alias("rows"), F.sum(size - F.col("depth")).alias("turns"),
        F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.min_by("ends", "ids").alias("ends"),
    )
    d = d.where((F.col("rows") > 1) & (F.col("turns") > limit))
    least = (F.least(F.octet_length("lo"), F.octet_length("hi")) / WIDTH).cast("int")
    id_ = lambda c, i: F.substring(c, i * WIDTH + 1, F.lit(WIDTH))
    agree = F.array_min(F.filter(F.sequence(F.col("depth"), least), lambda i: (i == least) | (id_(F.col("lo"), i) != id_(F.col("hi"), i))))
    d = d.withColumn("to", agree)
    low = F.greatest(F.col("depth"), F.lit(1))
    path = F.substring("lo", (low - 1) * WIDTH + 1, F.greatest(F.col("to") - low + 1, F.lit(0)) * WIDTH)
    return d.select("key", "up", "up_conv", "depth", "to", "n", "conv_id", path.alias("path"), F.when(F.octet_length("lo") == F.col("to") * WIDTH, F.col("ends")).alias("ends"))


def _bytes(path: bytes) -> list[int]:
    """The text lengths of the turns on a path."""
    return [int.from_bytes(path[i - 4 : i], "big") for i in range(WIDTH, len(path) + 1, WIDTH)]


def _as_batch(nodes: list[tuple]) -> pa.RecordBatch:
    columns = zip(*nodes) if nodes else [[]] * len(NODE)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, NODE.values())], list(NODE))


def sweep(rows: list[tuple]) -> list[tuple]:
    """The nodes of one container, its top first, from its sorted suffixes (up, up_conv, depth, ids, n, conv_id, ends)."""
    up, up_conv, base = rows[0][:3]
    depth, parent, conv, n, children, size, ends, path = [], [], [], [], [], [], [], []
    before = b""
    for *_, ids, count, who, digest in rows:
        shared = base
        if path:
            end = min(len(ids), len(before))
            while (shared + 1) * WIDTH <= end and ids[shared * WIDTH : (shared + 1) * WIDTH] == before[shared * WIDTH : (shared + 1) * WIDTH]:
                shared += 1
            del path[shared - base + 1 :]
        for t in range(base + len(path), len(ids) // WIDTH + 1):
            if path:
                children[path[-1]] += 1
            parent.append(path[-1] if path else -1)
            path.append(len(depth))
            depth.append(t)
            size.append(int.from_bytes(ids[t * WIDTH - 4 : t * WIDTH], "big") if t else 0)
            for column, value in ((conv, who), (n, 0), (children, 0), (ends, NO_ENDS)):
                column.append(value)
        for i in path:
            n[i] += count
            conv[i] = min(conv[i], who)
        ends[path[-1]] = digest
        before = ids
    leaves, saved = [int(c == 0) for c in children], [(k - 1) * b for k, b in zip(n, size)]
    for i in range(len(depth) - 1, 0, -1):
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    above = [up_conv, *(conv[p] for p in parent[1:])]
    return list(zip(conv, depth, above, n, children, leaves, saved, ends, [up, *[None] * (len(depth) - 1)]))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("key", "up", "up_conv", "depth", "ids", "n", "conv_id", "ends")]
        for key, *row in zip(*columns):
            if key != now:
                if held:
                    out += sweep(held)
                now, held = key, []
            held.append(row)
        yield _as_batch(out)
    if held:
        yield _as_batch(sweep(held))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of burst containers: from the head down to where the suffixes part."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            deep, sizes, saved = r["to"] - r["depth"], _bytes(r["path"]), r["saved"]
            sizes = [0] * (deep + 1 - len(sizes)) + sizes
            for i in range(deep, -1, -1):
                saved += (r["n"] - 1) * sizes[i]
                last, top = i == deep, i == 0
                out.append((
                    r["conv_id"], r["depth"] + i, r["up_conv"] if top else r["conv_id"], r["n"], r["n_children"] if last else 1, r["leaves"], saved,
                    (last and r["ends"]) or NO_ENDS, r["up"] if top else None,
                ))
        yield _as_batch(out)


def _sums(nodes: DataFrame) -> DataFrame:
    """What the containers below each head hold: only the tops of containers name the head above them."""
    d = nodes.where("up is not null").groupBy("up")
    return d.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def trie(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of distinct suffixes (ids, n, conv_id, ends)."""
    state = distinct.select(F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("up"), F.lit(None).cast("long").alias("up_conv"), F.lit(0).alias("depth"), "ids", "n", "conv_id", "ends")
    kept, bursts = [], []
    while True:
        big = written(_bursting(state, limit if bursts else 0), "bursts")  # the root is a head at any size
        if big.isEmpty():
            kept.append(state)
            break
        bursts.append(big)
        to = F.col("to")
        d = state.join(big.select("key", "to", F.col("conv_id").alias("above")), "key", "left")
        d = d.where(to.isNull() | (F.octet_length("ids") > to * WIDTH))
        below = F.unhex(F.md5(F.substring("ids", F.lit(1), (to + 1) * WIDTH)))
        moved = {"key": below, "up": F.col("key"), "up_conv": F.col("above"), "depth": to + 1}
        d = d.select(*(F.when(to.isNotNull(), v).otherwise(F.col(c)).alias(c) for c, v in moved.items()), "ids", "n", "conv_id", "ends", to.isNotNull().alias("open"))
        d = written(d, "containers")
        kept.append(d.where("not open").drop("open"))
        state = d.where("open").drop("open")
    whole = kept[0]
    for k in kept[1:]:
        whole = whole.unionByName(k)
    nodes = written(whole.repartition("key").sortWithinPartitions("key", "ids").mapInArrow(_swept, NODE_SCHEMA), "nodes")
    out, below = nodes, written(_sums(nodes), "tops")
    for big in reversed(bursts):
        found = big.join(below, big.key == below.up).select(big["*"], "n_children", "leaves", "saved")
        chains = written(found.mapInArrow(_chains, NODE_SCHEMA), "heads")
        out = out.unionByName(chains)
        below = below.unionByName(_sums(chains)).groupBy("up").agg(*(F.sum(c).alias(c) for c in ("n_children", "leaves", "saved")))
    return out.drop("up")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, group: int = 5, most: int = 9) -> DataFrame:
    """The nodes of all rebuilt conversations (conv_id, turn, role, text)."""
    turns = written(turn_ids(conversations), "turns")
    whole = written(rebuilt(sequences(turns), group, most), "conversations")
    return trie(written(suffixes(whole), "suffixes"), limit)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn,
         md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, conv_id::VARCHAR AS s, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, m) AS l FROM t GROUP BY conv_id),
own AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], range(8 * length(s))), lambda a, i:
    xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) >> 1, CASE WHEN xor(a, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END) & 1 = 1 THEN 3988292384 ELSE 0 END))) % 9 AS h FROM l),
b AS MATERIALIZED (
  SELECT a.conv_id, list_concat(coalesce(p.l[1:a.h], []), a.l[a.h + 1:]) AS s FROM own a LEFT JOIN own p ON p.conv_id = a.conv_id - a.conv_id % 5),
n AS MATERIALIZED (
  SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b) GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(n.p[d].x) ELSE 0 END AS own FROM n LEFT JOIN k ON k.p = n.p),
u AS (SELECT p[1:e] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT p, own, n_children, unnest(range(0, d + 1)) AS e FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN u ON u.p = w.p LEFT JOIN w a ON w.d > 0 AND a.p = w.p[1:w.d - 1]
"""
