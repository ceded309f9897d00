"""Candidate groups of the n-gram join: what shares a rare shingle but can't be linked stays apart."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import ngram_join

from .conftest import prose
from .test_operators import brute_join, join_rows


@pytest.mark.parametrize(("short", "block"), [(64, 2048), (2, 5)])
def test_shared_passages_make_no_large_groups(spark, monkeypatch, short, block):
    """Each text shares a passage with the next one, and 30 share one more: before, groups had up to 5 members."""
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    passage = [prose(1000 + i, 25) for i in range(61)]
    docs = [(i, " ".join([passage[i], prose(i, 60), passage[i + 1], *([prose(5000, 12)] if i % 2 else [])])) for i in range(60)]
    docs += [(100 + i, docs[i][1] + f" more{i}") for i in range(0, 60, 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sets, classes = ngram_join.set_classes(ngram_join.token_sets(d))
    groups = ngram_join.candidate_groups(sets, classes, len(docs))
    assert groups.groupBy("grp").count().agg(F.max("count")).first()[0] == 2
    assert join_rows(ngram_join.near_duplicates(d)) == brute_join(docs)


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_lists_across_batches(size, monkeypatch):
    """Short lists give all pairs of near sizes, longer ones none, whatever the batches."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "SHORT", 4)
    rng = random.Random(size)
    rows = [(t, 100 * t + k, rng.randrange(10, 16)) for t in range(40) for k in range(rng.choice([1, 2, 3, 4, 5, 11]))]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("token", "key", "n"), map(list, zip(*rows[i : i + size]))))) for i in range(0, len(rows), size)]
    got = sorted((r["a"], r["b"]) for b in ngram_join.short_lists(iter(batches)) for r in b.to_pylist())
    lists = [[r for r in rows if r[0] == t] for t in range(40)]
    assert got == sorted((x[1], y[1]) for rs in lists if len(rs) <= 4 for x, y in itertools.combinations(rs, 2) if 100 * min(x[2], y[2]) >= 80 * max(x[2], y[2]))


@pytest.mark.parametrize("two", [False, True])
def test_possible_pairs_connect_all_links(two):
    rng = np.random.default_rng(two)
    pool = rng.integers(0, 2**63, 80).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 60))) for _ in range(80)]
    sets += [np.unique(np.append(s[:-1], rng.integers(0, 2**63, dtype=np.int64).astype(np.uint64))) for s in sets[:40]]
    side = rng.integers(0, 2, len(sets)) if two else np.full(len(sets), 2)
    bits = np.frombuffer(b"".join(map(ngram_join.signature, sets)), np.uint64).reshape(len(sets), -1)
    pairs = list(ngram_join.spanning_possible(np.array([len(s) for s in sets]), bits, side))
    assert len(pairs) < len(sets)
    up = ngram_join.Union(len(sets))
    for a, b in pairs:
        assert not two or side[a] != side[b]
        up.up[up.find(a)] = up.find(b)
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if ngram_join.linked(sets[i], sets[j]) and (not two or side[i] != side[j])]
    assert links and all(up.find(i) == up.find(j) for i, j in links)


def test_chunks_are_bounded_by_size(spark, monkeypatch):
    """Long texts make chunks of few members: before, only their number counted."""
    monkeypatch.setattr(ngram_join, "CHUNK_SHINGLES", 1000)
    base = prose(7, 600).split()
    docs = [(i, " ".join([*base[:590], *prose(40 + i, 10).split()])) for i in range(12)] + [(50, " ".join(base[:300])), (51, prose(8, 2000))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert spark.range(6).selectExpr("id AS n").agg(ngram_join._chunks()).first()[0] == 1
    assert spark.range(6).selectExpr("id * 500 AS n").agg(ngram_join._chunks()).first()[0] == 8
    assert join_rows(ngram_join.near_duplicates(d)) == brute_join(docs)
