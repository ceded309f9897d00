"""Centroid clustering of vectors in integers, with JVM expressions alone.

Components become whole numbers, so every engine and every partitioning agrees on distances, ties and means. A round
is one pass over the table: zip_with and aggregate give the squared distances to the centroids, which stand in the plan
as one literal array of arrays, array_min over structs (distance, number) picks the nearest, and sums of the components'
columns per cluster are combined within each map task before their shuffle, so that a cluster with most of the
vectors sends one row a task like any other. Only the centroids (clusters x dimensions numbers) reach the driver.

Defined results: vectors that are null, have another number of components or a null, NaN or infinite one are left out; equal
vec_ids are separate vectors and a null vec_id hashes as the empty text (ties of the starting order go by the components); with
fewer vectors than clusters there are as many clusters as vectors; no vector gives no row; other columns are
ignored. Components whose whole number passes 2^27 raise an error, as their squared distances would leave the long range.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, LARGEST = 256, 1 << 27


def whole_vectors(vectors: DataFrame, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors with exactly dims finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    e = F.col("embedding")
    kept = vectors.select("vec_id", e.cast("array<double>").alias("embedding")).where((F.size(e) == dims) & F.forall(e, finite))

    def whole(x: Column) -> Column:
        n = F.floor(x * scale)
        return F.when(F.abs(n) <= LARGEST, n).otherwise(F.raise_error(F.lit("a component is too large for distances in long")).cast("long"))

    return kept.select("vec_id", F.transform(e, whole).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids hash lowest."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.orderBy(order, "v").limit(clusters).select("v").collect()]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid; the smaller number wins a tie."""
    literal = F.from_json(F.lit(json.dumps(centroids)), "array<array<bigint>>")

    def distance(c: Column) -> Column:
        return F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)

    return F.array_min(F.transform(literal, lambda c, j: F.struct(distance(c).alias("distance"), j.alias("cluster"))))


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vectors with their distance and cluster."""
    # an array of one element keeps the vector from being computed again for each centroid
    found = F.transform(F.array("v"), lambda v: nearest(v, centroids))[0]
    return vectors.withColumn("near", found).select("*", "near.distance", "near.cluster").drop("near")


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each non-empty centroid becomes the floor of its vectors' mean, component by component; empty ones stay."""
    dims = len(centroids[0])
    sums = assigned(vectors, centroids).groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)))
    out = [list(c) for c in centroids]
    for row in sums.collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(dims)]
    return out


def cluster(vectors: DataFrame, dims: int, clusters: int, rounds: int, seed: int, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, distance, cluster) of every vector after so many rounds, and the final centroids."""
    rows = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).cast("long").alias("distance"), F.lit(0).alias("cluster")).where("false"), []
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return written(assigned(rows, centroids).select("vec_id", "distance", "cluster"), "clusters"), centroids


def with_inertia(members: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """members with the distances summed over their cluster and over all, and the SHA-256 of their centroid."""
    spark = members.sparkSession
    sums = {r.cluster: int(r.total) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(j, sums.get(j, 0), sum(sums.values()), d) for j, d in enumerate(digest)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(known), "cluster")  # one row per cluster


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = cluster(table(spark, sf_dir, "embeddings"), dims=64, clusters=40, rounds=5, seed=2)
    return with_inertia(members, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(rounds: int = 5, clusters: int = 40) -> str:
    """The same in DuckDB: one pair of common table expressions per round."""
    assign = """a{r} AS MATERIALIZED (SELECT vec_id, v, m.d AS distance, m.j AS cluster FROM (
  SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, j := j)) AS m FROM k, c{r} GROUP BY vec_id, v))"""
    move = """c{n} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
  SELECT cluster AS j, list(m ORDER BY i) AS m FROM (
    SELECT cluster, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM a{r}, range(1, 65) AS t(i) GROUP BY cluster, i) GROUP BY cluster) USING (j))"""
    steps = ",\n".join(f"{assign.format(r=r)},\n{move.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM k ORDER BY h LIMIT {clusters})),
{steps},
{assign.format(r=rounds)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = cluster"""


OP12_SQL = _sql()
