"""Integer clustering against a plain version, and its edge cases."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from paperloom.llm.centroid_clustering import OP12_SQL, cluster, first_centroids, moved, op12_centroid_clustering, whole_vectors, with_inertia

from ..conftest import rows_of


def plain(rows, dims, clusters, rounds, seed):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(v) for _, v in start[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(at)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(at)):
            own = [v for (_, v), (_, k) in zip(kept, found) if k == j]
            if own:
                at[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, j, d) for (i, _), (d, j) in zip(kept, assign())]
    total = sum(d for *_, d in out)
    inside = {j: sum(d for _, k, d in out if k == j) for _, j, _ in out}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, j, d, inside[j], total, digest[j]) for i, j, d in out]


@pytest.fixture(scope="module")
def vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [math.sin(i * 3 + j) * (i % 5) for j in range(3)]) for i in range(40)]
    rows += [(100 + i, [1.5, -0.25, 0.0]) for i in range(30)]  # equal vectors: ties and a hot cluster
    rows += [(7, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3]), (200, None), (201, [1.0, 2.0]), (202, [1.0, None, 2.0])]
    rows += [(203, [nan, 0.0, 0.0]), (204, [inf, 0.0, 0.0]), (205, [0.0, -inf, 0.0]), (206, []), (207, [0.0, 0.0, 0.0, 0.0])]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)


@pytest.mark.parametrize("clusters", [1, 6, 500])
def test_against_plain(vectors, clusters):
    rows, table = vectors
    got = with_inertia(*cluster(table, 3, clusters, 4, 2)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    key = lambda r: tuple(("" if x is None else x, x is None) if not isinstance(x, str) else x for x in map(lambda y: -1 if y is None else y, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, 3, clusters, 4, 2), key=key)


def test_no_vectors(vectors, spark):
    _, table = vectors
    assert with_inertia(*cluster(table.limit(0), 3, 4, 2, 2)).count() == 0
    assert with_inertia(*cluster(table, 99, 4, 2, 2)).count() == 0


def test_empty_cluster_stays_and_floor_of_negative_means(spark):
    rows = whole_vectors(spark.createDataFrame([(1, [-0.004]), (2, [-0.008]), (3, [-0.012])], "vec_id long, embedding array<double>"), 1)
    assert moved(rows, [[0], [10_000]]) == [[-3], [10_000]]  # -2, -3, -4 average to -3; -1 / 2 would floor to -1
    assert moved(rows.where("vec_id < 3"), [[0]]) == [[-3]]


def test_too_large_components_raise(spark):
    rows = whole_vectors(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), 1)
    with pytest.raises(Exception, match="too large"):
        first_centroids(rows, 1, 2)


def test_centroids_are_literals(spark, sf):
    from paperloom.llm.centroid_clustering import assigned

    rows = whole_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), 64)
    plan = assigned(rows, [[0] * 64, [1] * 64]).groupBy("cluster").agg(F.sum(F.col("v")[0]))._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "Python" not in plan and "partial_sum" in plan


def test_query(spark, sf, duck):
    assert rows_of(op12_centroid_clustering(spark, sf).toPandas()) == rows_of(duck.sql(OP12_SQL).df())
