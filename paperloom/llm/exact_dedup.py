"""Exact de-duplication over a cuckoo-filter index of live digests.

Map tasks combine equal digests of their own rows in a bounded table, and Spark deals these partial rows out to the
shards of the index by digest. A shard holds a cuckoo filter and, beside it, the bucketed content that the
filter stands for: the full digests with their owners. Each arriving row asks the filter first. A miss is
new for certain and is inserted; a hit is verified against the stored digests, so a false positive of the filter never
drops a document, and a true hit updates the owner and the count. Deletion removes one fingerprint and
the stored key. When an insertion finds no free slot, the filter is resized and refilled from the stored keys.

Shards are small (about SHARD_KEYS rows each) and their number grows with the rows. A task takes its shards one
after the other from rows sorted by shard, so it holds one shard at a time.

Defined results: null text counts as the empty text; repeated rows of one doc_id share a fate and each
counts in group_size; of equal texts the smallest doc_id stays (null ids come last); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, shuffle_parts, table, written

SLOTS, KICKS = 4, 200
#: Rows that a shard of the index is meant to take in, and digests that a map task keeps an eye on, those met last.
SHARD_KEYS, HOT = 2_000, 256


class CuckooFilter:
    """Partial-key cuckoo filter with 16-bit fingerprints, four to a bucket, over 64-bit keys."""

    def __init__(self, buckets: int = 64) -> None:
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.cells = array("H", bytes(2 * SLOTS * self.buckets))
        self.size = 0

    @staticmethod
    def _mix(x: int) -> int:
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 33)

    def _places(self, key: int) -> tuple[int, int, int]:
        finger = (key >> 48) % 0xFFFF + 1
        first = self._mix(key) & (self.buckets - 1)
        return finger, first, self._other(first, finger)

    def _other(self, place: int, finger: int) -> int:
        return (place ^ self._mix(finger)) & (self.buckets - 1)

    def _slot(self, place: int, value: int) -> int:
        """Index of the bucket's first cell with this value, or -1."""
        cells = self.cells
        for i in range(SLOTS * place, SLOTS * place + SLOTS):
            if cells[i] == value:
                return i
        return -1

    def __contains__(self, key: int) -> bool:
        finger, a, b = self._places(key)
        return self._slot(a, finger) >= 0 or self._slot(b, finger) >= 0

    def add(self, key: int) -> bool:
        """False if no slot came free: all displaced fingerprints are put back, and the caller resizes."""
        finger, a, b = self._places(key)
        at = self._slot(a, 0)
        place, moved = b, []
        for kick in range(KICKS + 1):
            if at < 0:
                at = self._slot(place, 0)
            if at >= 0:
                self.cells[at] = finger
                self.size += 1
                return True
            cell = SLOTS * place + (finger + kick) % SLOTS
            moved.append((cell, self.cells[cell]))
            finger, self.cells[cell] = self.cells[cell], finger
            place = self._other(place, finger)
        for cell, old in reversed(moved):
            self.cells[cell] = old
        return False

    def remove(self, key: int) -> bool:
        finger, a, b = self._places(key)
        at = max(self._slot(a, finger), self._slot(b, finger))
        if at < 0:
            return False
        self.cells[at] = 0
        self.size -= 1
        return True


class Shard:
    """One shard of the index: the filter and the stored content it is verified against.

    hits and false_hits count the filter's answers that the content confirmed and refuted. overflow holds digests whose
    64-bit keys the filter can't take at any size, as more of them are equal than two buckets have cells.
    """

    def __init__(self, buckets: int = 64) -> None:
        self.filter, self.content, self.resizes = CuckooFilter(buckets), {}, 0
        self.hits = self.false_hits = 0
        self.overflow: set[str] = set()

    @staticmethod
    def key(digest: str) -> int:
        return int(digest[8:24], 16)

    def find(self, digest: str):
        """The stored value of a live digest, else None."""
        if self.key(digest) not in self.filter and digest not in self.overflow:
            return None
        value = self.content.get(digest)
        self.hits += value is not None
        self.false_hits += value is None
        return value

    def insert(self, digest: str, value) -> None:
        self.content[digest] = value
        if not self.filter.add(self.key(digest)) and not self.resize():
            self.overflow.add(digest)

    def take_in(self, digest: str, keep: int | None, size: int) -> None:
        """A document, or several of one digest: inserted if new, else joined to the verified owner."""
        old = self.find(digest)
        if old is None:
            self.insert(digest, (keep, size))
        else:
            ids = [x for x in (old[0], keep) if x is not None]
            self.content[digest] = (min(ids, default=None), old[1] + size)

    def delete(self, digest: str) -> bool:
        if self.find(digest) is None:
            return False
        del self.content[digest]
        if digest in self.overflow:
            self.overflow.discard(digest)
            return True
        return self.filter.remove(self.key(digest))

    def resize(self) -> bool:
        """A filter of twice the buckets, refilled from the stored keys; False, and the old one, if no size takes them all."""
        buckets = 2 * self.filter.buckets
        while buckets <= 64 * (len(self.content) + 64):
            fresh = CuckooFilter(buckets)
            if all(fresh.add(self.key(d)) for d in self.content if d not in self.overflow):
                self.filter, self.resizes = fresh, self.resizes + 1
                return True
            buckets *= 2
        return False


def digests(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, text_sha256, *also): white-space runs as one space, UTF-8, lower-case hex."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " ")
    return docs.select("doc_id", F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), *also)


INDEX = "text_sha256 string, keep_id long, group_size long"


def _rows(rows: Iterable[tuple[str, tuple[int | None, int]]]) -> pa.RecordBatch:
    rows = list(rows)
    columns = [pa.array([d for d, _ in rows], pa.string()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in (0, 1))]
    return pa.RecordBatch.from_arrays(columns, ["text_sha256", "keep_id", "group_size"])


def combined(keys: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size): rows of a digest that come soon after one another in a map task as one row.

    The HOT digests that were met last are kept; the one not met for longest gives way to a new one and is sent. So a hot text
    is one row, or few, a task, and copies that lie apart reach the index by themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, tuple[int | None, int]] = OrderedDict()
        for b in batches:
            sent = []
            for digest, doc in zip(b.column("text_sha256").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                old = held.pop(digest, None)
                if old is None:
                    if len(held) >= HOT:
                        sent.append(held.popitem(last=False))
                    held[digest] = doc, 1
                else:
                    held[digest] = doc if old[0] is None or (doc is not None and doc < old[0]) else old[0], old[1] + 1
            yield _rows(sent)
        yield _rows(held.items())

    return keys.select("doc_id", "text_sha256").mapInArrow(run, INDEX)


def build_index(keys: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The live index of (doc_id, text_sha256): one row per digest with its smallest doc_id and its count.

    A hot text reaches its shard as few rows per map task. `removed` (text_sha256) names digests to
    delete after the insertions.
    """
    parts = shuffle_parts(keys.sparkSession)
    shards = max(4 * parts, keys.count() // SHARD_KEYS)
    rows = combined(keys).withColumn("gone", F.lit(False))
    if removed is not None:
        rows = rows.unionByName(
            removed.select("text_sha256").distinct().selectExpr("text_sha256", "cast(null as long) keep_id", "0L group_size", "true gone")
        )
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("text_sha256"), F.lit(shards))).repartition(parts, "shard").sortWithinPartitions("shard", "gone")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, Shard()
        for b in batches:
            for here, digest, keep, size, gone in zip(*(b.column(c).to_pylist() for c in ("shard", "text_sha256", "keep_id", "group_size", "gone")), strict=True):
                if here != number:
                    yield _rows(shard.content.items())
                    number, shard = here, Shard()
                if gone:
                    shard.delete(digest)
                else:
                    shard.take_in(digest, keep, size)
        yield _rows(shard.content.items())

    return dealt.mapInArrow(load, INDEX)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = written(digests(docs), "digests")
    index = build_index(keys)
    out = keys.join(index, "text_sha256", "left")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
