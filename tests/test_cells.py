"""Cells equal exact search and skip products; hashing tables reach their recall."""

import math
import random

import pytest

from paperloom.operators import cells, retrieve


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        v = [rng.gauss(0, 0.08) + (3.0 if j == i % 6 else 0.0) for j in range(6)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / n for x in v]))
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies: ties at the edge
    rows += [(2000, None), (2001, [1.0]), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)


def rows(d):
    return sorted(tuple(r) for r in d.collect())


def test_cells_are_exact_and_skip(vectors):
    q = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    good = vectors.where(cells.usable(vectors, 6))
    for k in (1, 15):
        found, counts = cells.Cells(vectors).search(q, k)
        assert rows(found) == rows(retrieve.dense_search(good, q.where("query_id < 2000"), k))
        assert all(r.skipped > 0.5 for r in counts.collect())


def test_large_cells_are_dealt_in_parts(vectors, monkeypatch):
    q = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    good = vectors.where(cells.usable(vectors, 6))
    monkeypatch.setattr(cells, "ROWS", 10)
    monkeypatch.setattr(cells, "BLOCK_NUMBERS", 6 * 5)
    assert rows(cells.Cells(vectors, 3).search(q, 15)[0]) == rows(retrieve.dense_search(good, q.where("query_id < 2000"), 15))


def test_both_forms_of_dense_search(vectors, monkeypatch):
    q = vectors.where("id % 30 = 0 and id < 2000").withColumnRenamed("id", "query_id")
    one = rows(retrieve.dense_search(vectors.where("id < 2000"), q, 5))
    monkeypatch.setattr(retrieve, "BLOCK_NUMBERS", 6 * 7)
    assert rows(retrieve.dense_search(vectors.where("id < 2000"), q, 5)) == one and len(one) == 5 * q.count()


def test_hashed_search_reaches_its_recall(vectors):
    q = vectors.where("id % 50 = 0 and id < 1000").withColumnRenamed("id", "query_id")
    exact = set((r.query_id, r.id) for r in retrieve.dense_search(vectors.where(cells.usable(vectors, 6)), q, 15).collect())
    for wanted in (0.9, 1.0):
        got = cells.hashed_search(vectors, q, 15, wanted, tables=4).collect()
        share = len(exact & {(r.query_id, r.id) for r in got}) / len(exact)
        assert share >= wanted and {r.recall for r in got} == {round(share, 4)}


def test_empty(vectors):
    q = vectors.withColumnRenamed("id", "query_id")
    assert cells.Cells(vectors.limit(0)).search(q, 3)[0].count() == 0
    assert cells.Cells(vectors).search(q.limit(0), 3)[0].count() == 0
    assert cells.hashed_search(vectors.limit(0), q, 3).count() == 0 and cells.hashed_search(vectors, q.limit(0), 3).count() == 0


def test_hashed_search_scores_vectors_where_they_lie(vectors, monkeypatch):
    """No pairs of queries and candidates are dealt or joined; queries of one block and of several give the same rows."""
    q = vectors.where("id % 50 = 0 and id < 1000").withColumnRenamed("id", "query_id")
    out = cells.hashed_search(vectors, q, 15)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(retrieve, "BLOCK_NUMBERS", 6 * 7)
    assert rows(cells.hashed_search(vectors, q, 15)) == rows(out)
