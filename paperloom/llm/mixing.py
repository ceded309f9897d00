"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words. Each source has an exact quota of blocks, which may exceed its
number of blocks when it is repeated. A tree splits the vector of quotas: the left half of the output
shards takes a multivariate-hypergeometric share of the node's blocks, the right half the rest, down to
one vector per shard. Each draw of a vector is itself split in halves of the sources, so that a task can follow
any one source through the tree without the others. Blocks of a source are numbered without gaps, each pass over the
source permutes the numbers anew, and a shard draws the range of the permuted numbers that the tree gives it and
no other shard draws. The mix is dealt out by shard and sorted in each shard by a second key, the local shuffle.

Only per-source sums reach the driver. A hot source is numbered in many buckets at once. The number of shards grows
with the mix (about SHARD_WORDS words each).

Defined results: null text has size 0 and gives no blocks; null source is a source of its own, last in
order; repeated rows are separate documents; an empty table gives an empty result; other columns are ignored.
The same rows give the same mix at any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words_of, written

BLOCK_WORDS = 32
#: Least number of output shards, words that a shard is meant to hold, and runs in which it is written.
SHARDS, SHARD_WORDS, PIECES = 64, 1 << 28, 16
#: Buckets in which the documents of one source are numbered at the same time.
BUCKETS = 1024
SEED = 20_240_229


def targets(sizes: dict, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict:
    """Words per source: `share` of all words by repeating weights, none above `most` times its size."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * float(sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _log_growth(x: float, d: float) -> float:
    """log((x + d)! / x!) - d log(x), without the loss of digits that the difference of two large logarithms has."""
    if min(x, x + d) < 1000:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1) - (d * math.log(x) if x else 0.0)
    return (x + d + 0.5) * math.log1p(d / x) - d + 1 / (12 * (x + d)) - 1 / (12 * x)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `good` are among `take` drawn without replacement; exact at every size.

    numpy draws counts below 1e9. Above, the ratio-of-uniforms method (Stadlober 1990) accepts or
    rejects by the ratio of a value's probability to the mode's.
    """
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, take))
    total = good + bad
    if take > total // 2:
        return good - hypergeometric(rng, good, bad, total - take)
    if good > bad:
        return take - hypergeometric(rng, bad, good, take)
    mode = (take + 1) * (good + 1) // (total + 2)
    mean = take * good / total
    if mode < 300:  # walk up from 0
        u, k = rng.random(), 0
        p = math.exp(_log_growth(total, -take) - _log_growth(bad, -take) + take * math.log1p(-good / total))
        while u > p and k < high:
            u -= p
            p *= (good - k) / (k + 1) * ((take - k) / (bad - take + k + 1))
            k += 1
        return k
    spread = mean * (bad / total) * ((total - take) / (total - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    rest = bad - take + mode
    tilt = math.log((good - mode) / mode) + math.log((take - mode) / rest)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not low <= k <= high:
            continue
        d = k - mode
        ratio = d * tilt - _log_growth(mode, d) - _log_growth(good - mode, -d) - _log_growth(take - mode, -d) - _log_growth(rest, d)
        if 2 * math.log(u) <= ratio:
            return k


class SplittingTree:
    """The quotas of all sources, split among shards; columns sum to the quotas, rows are as even as whole numbers allow.

    Node (a, b) stands for shards a .. b - 1. Its count of the sources lo .. hi - 1 is split between its two
    halves by one draw, given how many of the wider range of sources go left. Every draw has its own seed, so
    tasks that follow different sources agree on the nodes they share.
    """

    def __init__(self, quotas, shards: int, seed: int) -> None:
        self.sums = np.concatenate([[0], np.cumsum(np.asarray(quotas, np.int64))])
        self.sources, self.shards, self.seed = len(self.sums) - 1, shards, seed

    def counts(self, wanted: list[int]) -> np.ndarray:
        """[shards, wanted] block counts."""
        out = np.zeros((self.shards, len(wanted)), np.int64)
        if not wanted:
            return out
        ranges = [(0, self.sources)]
        for lo, hi in ranges:  # the ranges on the way to a wanted source, and their other halves
            if hi - lo > 1 and any(lo <= s < hi for s in wanted):
                mid = (lo + hi) // 2
                ranges += [(lo, mid), (mid, hi)]
        stack = [(0, self.shards, {(lo, hi): int(self.sums[hi] - self.sums[lo]) for lo, hi in ranges})]
        while stack:
            a, b, here = stack.pop()
            if b - a == 1:
                out[a] = [here[s, s + 1] for s in wanted]
                continue
            mid, full = (a + b) // 2, ranges[0]
            left = {full: here[full] * (mid - a) // (b - a)}
            for lo, hi in ranges:
                half = (lo + hi) // 2
                if (lo, half) in here and hi - lo > 1:
                    rng = np.random.default_rng([self.seed, a, b, lo, hi])
                    left[lo, half] = hypergeometric(rng, here[lo, half], here[half, hi], left[lo, hi])
                    left[half, hi] = left[lo, hi] - left[lo, half]
            stack += [(a, mid, left), (mid, b, {r: here[r] - left[r] for r in ranges})]
        return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: four Feistel rounds on the next even power of two, walked until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for r in range(4):
            f = (b + np.uint64((key * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        return a << shift | b

    x = once(index.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def numbered(docs: DataFrame, block_words: int | None) -> DataFrame:
    """docs with blocks, bucket and, within source and bucket, the number of blocks before the document."""
    blocks = F.ceil(F.col("size") / block_words) if block_words else (F.col("size") > 0).cast("long")
    d = docs.withColumn("blocks", blocks.cast("long")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
    w = Window.partitionBy("source", "bucket").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("before", F.coalesce(F.sum("blocks").over(w), F.lit(0)))


class Plan:
    """Sizes, quotas and targets of all sources, and the tree over them; sent to each task."""

    def __init__(self, rows, weights, share, most, shards, seed) -> None:
        self.size = {r["source"]: int(r["size"]) for r in rows}
        self.blocks = {r["source"]: int(r["blocks"]) for r in rows}
        self.target = targets(self.size, weights, share, most)
        names = sorted((s for s in self.size if s is not None)) + [None] * (None in self.size)
        self.at = {s: i for i, s in enumerate(names)}
        self.quota = [round(self.target[s] * self.blocks[s] / self.size[s]) if self.size[s] else 0 for s in names]
        self.shards = shards or max(SHARDS, math.ceil(sum(self.target.values()) / SHARD_WORDS))
        self.tree, self.seed = SplittingTree(self.quota, self.shards, seed), seed
        self.ends: dict = {}

    def follow(self, sources) -> None:
        """Finds the ends of the shards' ranges for sources that have none yet."""
        new = [s for s in sources if s not in self.ends]
        ends = np.cumsum(self.tree.counts([self.at[s] for s in new]), axis=0)
        self.ends.update({s: ends[:, i] for i, s in enumerate(new)})

    def draw(self, source, number: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per pass: positions in `number` that are taken, their shards and their places in the source's draw.

        Places 0, 1, 2, ... of a source go to the shards in turn, as many to each as the tree gives it.
        """
        n, ends = self.blocks[source], self.ends[source]
        for turn in range(-(-int(ends[-1]) // n) if n else 0):
            place = turn * n + permute(number, n, self.seed + 7919 * self.at[source] + turn)
            shard = np.searchsorted(ends, place, side="right")
            at = np.flatnonzero(shard < self.shards)
            yield turn, at, shard[at], place[at]


def prepare(docs: DataFrame, weights, share, most, block_words, shards, seed) -> tuple[DataFrame, Plan]:
    """Rows (id, source, size, blocks, first: the number of the document's first block in its source) and the plan."""
    d = written(numbered(docs.select("id", "source", "size"), block_words), "mix")
    sums = d.groupBy("source", "bucket").agg(F.sum("blocks").alias("b"), F.sum("size").alias("s"))
    plan = Plan(sums.groupBy("source").agg(F.sum("b").alias("blocks"), F.sum("s").alias("size")).collect(), weights, share, most, shards, seed)
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("k"), F.col("bucket").alias("l"), F.coalesce(F.sum("b").over(w), F.lit(0)).alias("start"))
    d = d.join(starts, d.source.eqNullSafe(starts.k) & (d.bucket == starts.l))
    return d.withColumn("first", F.col("start") + F.col("before")).drop("k", "l", "start", "before", "bucket"), plan


def _blocks(batch: pa.RecordBatch):
    """Per source in the batch: its rows, and for each block the row, the block's place in it and its number."""
    source = batch.column("source").to_pylist()
    first, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "blocks"))
    rows: dict = {}
    for i, s in enumerate(source):
        rows.setdefault(s, []).append(i)
    for s, at in rows.items():
        at = np.array(at)
        n = blocks[at]
        row = np.repeat(at, n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield s, row, inner, first[row] + inner


def _drawn(d: DataFrame, plan: Plan, block_words: int | None) -> DataFrame:
    """One row per drawn block: id, source, first, turn, block, words, shard, shard_order."""
    kind = dict(d.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "first"))
            found = list(_blocks(batch))
            plan.follow(s for s, *_ in found)
            for s, row, inner, number in found:
                for turn, at, shard, place in plan.draw(s, number):
                    words = np.minimum(block_words, size[row[at]] - inner[at] * block_words) if block_words else size[row[at]]
                    order = (place * len(plan.at) + plan.at[s]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    order ^= order >> np.uint64(31)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(row[at])),
                            pa.array([s] * len(at), pa.string()),
                            pa.array(first[row[at]].astype(np.int64)),
                            pa.array(np.full(len(at), turn, np.int32)),
                            pa.array(inner[at].astype(np.int64)),
                            pa.array(words.astype(np.int64)),
                            pa.array(shard.astype(np.int32)),
                            pa.array((order >> np.uint64(1)).astype(np.int64)),
                        ],
                        ["id", "source", "first", "turn", "block", "words", "shard", "shard_order"],
                    )

    return d.mapInArrow(run, f"id {kind}, source string, first long, turn int, block long, words long, shard int, shard_order long")


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows with shard and shard_order, dealt out by shard and put in each shard's own order.

    A shard is dealt in PIECES runs of its order, so tasks are even and no task holds all of a large shard.
    """
    piece = F.call_function("shiftright", F.col("shard_order"), F.lit(63 - (PIECES - 1).bit_length()))
    return rows.repartition("shard", piece).sortWithinPartitions("shard", "shard_order")


def mix(docs: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0, block_words: int | None = BLOCK_WORDS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: one row per drawn block.

    docs: id (long or string), source, size (words). Rows: id, source, turn (which pass over the source), block (its number
    in the document), words, shard and shard_order (random, the same at every run; see shuffled()).
    block_words None takes whole documents as blocks; shards None as many as the mix needs.
    """
    return _drawn(*prepare(docs, weights, share, most, block_words, shards, seed), block_words).drop("first")


def taken(docs: DataFrame, weights=(3, 1, 2), share=1.5, most=2.0, block_words: int | None = BLOCK_WORDS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Per document, what the written mix holds of it: doc_id, size, source_size, target, taken."""
    d, plan = prepare(docs.select(F.col("doc_id").alias("id"), "source", "size"), weights, share, most, block_words, shards, seed)
    mixed = written(shuffled(_drawn(d, plan, block_words)), "shards")
    # a document's first block number tells it from all other rows of its source that have blocks
    sums = mixed.groupBy("source", "first").agg(F.sum("words").alias("taken")).toDF("k", "l", "taken")
    spark = docs.sparkSession
    sources = spark.createDataFrame([(s, plan.size[s], float(plan.target[s])) for s in plan.at], "source string, source_size long, target double").toDF("m", "source_size", "target")
    rows = d.withColumn("first", F.when(F.col("blocks") > 0, F.col("first")))
    out = rows.join(sums, rows.source.eqNullSafe(sums.k) & (rows["first"] == sums.l), "left").join(sources, rows.source.eqNullSafe(sources.m))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return taken(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size")))
