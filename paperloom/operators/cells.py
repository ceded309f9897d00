"""Dense search that does not look at every vector: cells with exact bounds, and hashing tables with measured recall.

Cells: centres are fitted on a bounded sample, and every vector goes to its nearest centre. A query's product with any vector of a cell
is at most its product with the centre plus its length times the cell's radius. A few promising cells give each query
a k-th score; cells whose bound stays below it are skipped, and the result is exact.

Hashing: in each of several tables a vector's key is the signs of its products with random directions. A query looks up
its own key and those with its least certain signs turned. How many keys it looks up is raised until the recall, measured against exact search on a
bounded number of queries, is reached. The recall is part of the result.

Defined results: vectors that are null, of another dimension than the first, or hold a null, NaN or infinite number are in no cell or table and match
nothing; no vectors or queries give no rows; copies of a vector are separate rows, ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import top_k
from .lineage import cut
from .retrieve import BLOCK_NUMBERS, TILE, best_products, cut_best, dense_search, matrix

#: Cells at most (each task holds all centres), and sampled vectors a cell that centres are fitted on.
MOST_CELLS, SAMPLE = 4096, 32
#: Vectors of a cell that one task holds.
ROWS = 1 << 16
#: Queries on which recall is measured, at most.
MEASURED = 200


def usable(d: DataFrame, dims: int) -> Column:
    return (F.size("embedding") == dims) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Means of the sample's nearest points, from evenly spaced ones on; an empty cell keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * sample @ centres.T, axis=1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(axis=0)
    return centres


class Cells:
    """Vectors (id, embedding) in cells. Only centres, radii and sizes reach the driver, MOST_CELLS of them at most."""

    def __init__(self, vectors: DataFrame, cells: int | None = None) -> None:
        first = vectors.where("embedding is not null").select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        self.dims = first.n if first else 1
        good = vectors.where(usable(vectors, self.dims)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        self.n = good.count()
        cells = max(1, min(cells or int(self.n**0.5), MOST_CELLS, self.n))
        sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells).select("embedding").toArrow()
        self.centres = centres = fit_centres(matrix(sample), cells) if sample.num_rows else np.zeros((1, self.dims))
        length = (centres**2).sum(axis=1)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                e = matrix(b)
                near = np.argmin(length - 2 * e @ centres.T, axis=1) if len(e) else np.zeros(0, np.int64)
                away = np.sqrt(((e - centres[near]) ** 2).sum(axis=1)) if len(e) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(away), b.column("id"), b.column("embedding")], ["cell", "away", "id", "embedding"])

        kind = dict(vectors.dtypes)["id"]
        self.vectors = cut(good.mapInArrow(placed, f"cell int, away double, id {kind}, embedding array<double>"))
        sums = self.vectors.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
        self.radius, self.sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in sums:
            self.radius[r.cell], self.sizes[r.cell] = r.radius, r.n

    def _asked(self, queries: DataFrame, pick, more: str = "") -> DataFrame:
        """(query_id, embedding, cell) for the cells that pick(bounds, batch) marks."""
        centres, radius, kind = self.centres, self.radius, dict(queries.dtypes)["query_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    q = matrix(b)
                    row, cell = np.nonzero(pick(q @ centres.T + np.sqrt((q**2).sum(axis=1))[:, None] * radius, b))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("embedding").take(at), pa.array(cell.astype(np.int32))], ["query_id", "embedding", "cell"])

        return queries.mapInArrow(run, f"query_id {kind}, embedding array<double>, cell int")

    def _best(self, asked: DataFrame, k: int, digits: int) -> DataFrame:
        """The best k of each query among the cells it asks. Large cells, and the queries that ask one cell, are dealt in parts."""
        kinds = dict(self.vectors.dtypes)["id"], dict(asked.dtypes)["query_id"]
        parts = np.maximum(1, -(-self.sizes // ROWS)).tolist()
        v_parts = F.get(F.array(*map(F.lit, parts)), F.col("cell")) if max(parts) > 1 else F.lit(1)
        q_parts = max(1, -(-asked.select("query_id").distinct().count() * self.dims // BLOCK_NUMBERS))
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        v = self.vectors.select("cell", "id", "embedding", F.pmod(F.xxhash64("id"), v_parts.cast("long")).cast("int").alias("vp")).withColumn("qp", upto(F.lit(q_parts)))
        q = asked.select("cell", "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int").alias("qp")).withColumn("vp", upto(v_parts.cast("int")))
        keys = ("cell", "vp", "qp")
        v = v.join(q.select(*keys).distinct(), list(keys), "left_semi")  # cells that nobody asks stay where they are
        out = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(lambda x, y: best_products(x, y, k, digits), f"query_id {kinds[1]}, id {kinds[0]}, score double")
        return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)

    def search(self, queries: DataFrame, k: int, digits: int = 5) -> tuple[DataFrame, DataFrame]:
        """dense_search()'s rows, and (query_id, products, skipped): how many products were made, and the share left out."""
        q = queries.where(usable(queries, self.dims)).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        sizes = self.sizes
        step = 10.0**-digits

        def promising(bounds: np.ndarray, _) -> np.ndarray:
            """The cells with the highest bounds that hold k vectors together."""
            order = np.argsort(-bounds, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            out = np.zeros(bounds.shape, bool)
            np.put_along_axis(out, order, before < k, axis=1)
            return out & (sizes > 0)

        first = cut(self._asked(q, promising))
        seen = cut(self._best(first, k, digits))
        reached = seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))

        def open_(bounds: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            low = b.column("reached").to_numpy(zero_copy_only=False).astype(float)[:, None]
            return (np.isnan(low) | (bounds >= low - step)) & ~promising(bounds, b) & (sizes > 0)

        rest = cut(self._asked(q.join(reached, "query_id", "left"), open_))
        both = seen.drop("rank").unionByName(self._best(rest, k, digits).drop("rank"))
        n = F.get(F.array(*map(F.lit, sizes.tolist())), F.col("cell"))
        counts = first.unionByName(rest).groupBy("query_id").agg(F.sum(n).alias("products"))
        counts = counts.withColumn("skipped", 1 - F.col("products") / F.lit(max(self.n, 1)))
        return top_k(both, ["query_id"], [F.desc("score"), F.col("id")], k), counts


def hashed_search(vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.9, tables: int = 12, per_key: int = 64, digits: int = 5, seed: int = 1) -> DataFrame:
    """(query_id, id, score, rank, recall): the best k of what the tables find, and the measured share of the exact best k found.

    Keys have as many signs as leave about per_key vectors a key. Scores are exact; only candidates are approximate. With all
    keys looked up the search is exact, so the recall is always reached.
    """
    one = vectors.where("embedding is not null").select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dims = one.n if one else 1
    good = vectors.where(usable(vectors, dims)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where(usable(queries, dims)).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bits = max(1, min(20, int(np.log2(max(2.0, good.count() / per_key)))))
    directions = np.random.default_rng(seed).normal(size=(tables, dims, bits))
    powers = 1 << np.arange(bits)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors with their key in each table."""
        for b in batches:
            if not b.num_rows:
                continue
            own = ((np.einsum("nd,tdb->ntb", matrix(b), directions) > 0) * powers).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, tables), pa.int32()), pa.array(own.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), lists], ["id", "embedding", "keys"])

    index = cut(good.repartition("id").mapInArrow(keyed, f"id {dict(good.dtypes)['id']}, embedding array<double>, keys array<int>"))

    def looked_up(q: np.ndarray, probes: int) -> np.ndarray:
        """[query, table, probe]: the keys that queries look up, their own and those with the least certain signs turned."""
        products = np.einsum("nd,tdb->ntb", q, directions)
        own = ((products > 0) * powers).sum(axis=2)
        turned = np.array(sorted(range(1 << bits), key=lambda m: (m.bit_count(), m))[:probes])
        order = np.argsort(np.abs(products), axis=2)
        masks = ((turned[:, None] >> np.arange(bits)) & 1).astype(bool)
        flips = np.zeros((*own.shape, len(turned)), np.int64)
        for j in range(bits):
            flips += np.where(masks[:, j], powers[order[:, :, j]][..., None], 0)
        return own[..., None] ^ flips

    def found(some: DataFrame, probes: int) -> DataFrame:
        """Vectors stay where they lie; a task lists them by table and key, and scores for each query those that its keys hold."""

        def best_found(v: pa.Table, q: pa.Table, k: int, digits: int) -> pa.Table:
            rows = [pa.table({"query_id": q.column("query_id").slice(0, 0), "id": v.column("id").slice(0, 0), "score": pa.array([], pa.float64())})]
            if v.num_rows and q.num_rows:
                e, n = matrix(v), v.num_rows
                own = v.column("keys").combine_chunks().flatten().to_numpy().reshape(n, tables)
                listed = np.argsort(own, axis=0, kind="stable").T  # [table, place]: vectors by key
                edges = np.arange((1 << bits) + 1)
                starts = np.stack([np.searchsorted(own[listed[t], t], edges) + t * n for t in range(tables)])
                listed, table = listed.reshape(-1), np.arange(tables)[:, None]
                m = matrix(q)
                for a in range(0, len(m), TILE):
                    picked, scores, whose = [], [], []
                    for i, keys in enumerate(looked_up(m[a : a + TILE], probes), a):
                        first = starts[table, keys].reshape(-1)
                        size = starts[table, keys + 1].reshape(-1) - first
                        ends = np.cumsum(size)
                        hit = np.zeros(n, bool)  # a vector that several tables find counts once
                        hit[listed[np.repeat(first - ends + size, size) + np.arange(ends[-1])]] = True
                        row = np.flatnonzero(hit)
                        score = np.round(e[row] @ m[i], digits)
                        if len(row) > k:
                            best = score >= -np.partition(-score, k - 1)[k - 1]  # ties at the edge are kept for the total order
                            row, score = row[best], score[best]
                        picked.append(row)
                        scores.append(score)
                        whose.append(np.full(len(row), i))
                    at = lambda x: pa.array(np.concatenate(x))
                    rows.append(pa.table({"query_id": q.column("query_id").take(at(whose)), "id": v.column("id").take(at(picked)), "score": at(scores)}))
            return cut_best(pa.concat_tables(rows), k)

        return dense_search(index, some, k, digits, best_found, ("keys",), BLOCK_NUMBERS // dims)

    test = cut(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(MEASURED))
    right = cut(dense_search(good, test, k, digits).select("query_id", "id"))
    total, probes, share = right.count(), 1, 1.0
    while total:
        share = found(test, probes).join(right, ["query_id", "id"], "left_semi").count() / total
        if share >= recall or probes >= 1 << bits:
            break
        probes = min(2 * probes, 1 << bits)
    return found(asked, probes).withColumn("recall", F.lit(round(share, 4)))
