"""Self-join of documents on word n-grams by Jaccard similarity, with signature trees.

1. Each document becomes the set of its distinct 5-word shingles (64-bit hashes). Equal sets are one class.
2. Lossless candidates: sets that reach the threshold share a token among their first |x| - ceil(t |x|) + 1 in any
   common order (prefix filter). The order here begins with the tokens of a fixed share of the hash space, rarest
   first. Only those tokens are counted over the corpus; tokens found once can link nothing and go no
   further. Tokens that a bounded sample shows to be very common are last in that order and skip the
   counting shuffle altogether, so no hot token is gathered.
3. Classes that share a prefix token may be linked if their sizes and 1024-bit signatures leave room for the overlap.
   Each token's list gives pairs that connect what all its possible pairs connect, long lists block by block, and
   connected components of these pairs are the groups to verify; sharing a token alone brings nobody together. Large groups
   are first held against one hub; pairs that are both linked to the hub need no comparison. The rest is cut into
   chunks of bounded number and size, and chunk pairs go to tasks.
4. A task builds a signature tree over each chunk: nodes hold OR-combined token bitmaps and size ranges. A dual
   traversal of two trees skips node pairs whose largest possible overlap is below the least one needed, or
   whose members are already connected; pairs of leaves are verified on the full sets. It returns a spanning set
   of the true links, which connects exactly what all links connect.

Defined results: null or empty text, or text without words, has no shingles and links with nothing; fewer words than a
shingle make one shingle of the whole sequence; repeated rows and equal sets share a component; documents
without a doc_id take part, and their component is null only if no member has one; different texts under one doc_id are separate
documents; an empty table gives an empty result; other columns are
ignored. Two shingles with equal 64-bit hashes would be taken as one, and two sets with equal 128-bit hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, in_slices, shuffle_parts, table, written

WORDS, PERCENT = 5, 80
#: Share of the hash space whose tokens come first in the common order; must exceed the prefix share (20 %).
FIRST_SHARE = 0.3
#: Documents in the sample that finds very common tokens, and the share of them that makes a token common.
SAMPLE_DOCS, COMMON_SHARE, COMMON_LEAST = 16_000, 0.005, 50
#: Rank in place of a count for very common tokens: after all counted ones.
COMMON = 1 << 40
#: Classes with one token beyond which its exact count no longer matters for the order.
LONGEST = 50_000
#: Most members of a chunk, and most shingles of its members together, both on average.
CHUNK, CHUNK_SHINGLES = 256, 1 << 20
BITS = 1024
#: Longest list of a token whose pairs are all looked at without signatures, and rows of a block of a longer list.
SHORT, BLOCK = 64, 2048
_FIRST = np.uint64(int(FIRST_SHARE * 2**64))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the word shingles; A-Z lower-cased, words as runs of non-white-space."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = (out + h[i : i + n]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def set_keys(s: np.ndarray) -> tuple[int | None, int | None]:
    """Both halves of the 128-bit hash of a whole set; null for the empty one."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes())) if len(s) else (None, None)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def signature(s: np.ndarray) -> bytes:
    """BITS bits, one set by each element's hash."""
    bits = np.zeros(BITS, bool)
    bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def token_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (tells a doc_id's texts apart), n (set size), key and check (hash of the whole set), bits (its signature), tokens (the first ones of the common order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in in_slices(batch)):
            n, keys, bits, tokens = [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py())
                n.append(len(s))
                keys.append(set_keys(s))
                bits.append(signature(s))
                count = max(int(np.searchsorted(s, _FIRST)), prefix_length(len(s), percent)) if len(s) else 0
                tokens.append(s[:count].astype(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["doc_id", "text_key", "n", "key", "check", "bits", "tokens"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n long, key long, check long, bits binary, tokens array<long>")


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets with key made unique, and the classes of equal sets: key, rep (the doc_id and text_key to read the text by), n, k tokens, bits.

    key is the first half of the hash. Where two different sets share it, all but the first go by a hash of both halves.
    """
    own = sets.where("key is not null").groupBy("key", "check").agg(
        F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("rep"), F.first("n").alias("n"), F.first(F.size("tokens")).alias("k"), F.first("bits").alias("bits")
    )
    own = written(own, "classes")
    twice = written(own.groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low < high").select("key", "low"), "clashes")

    def renamed(d: DataFrame) -> DataFrame:
        out = d.join(twice, "key", "left")
        return out.withColumn("key", F.when(F.col("low") < F.col("check"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("low")

    return renamed(sets.drop("bits")).drop("check"), renamed(own).drop("check")


def common_tokens(sets: DataFrame, rows: int) -> np.ndarray:
    """Sorted very common tokens, from a bounded sample of documents. They only set the order, never the result."""
    m = max(1, rows // SAMPLE_DOCS)
    sample = sets.where(F.pmod(F.xxhash64("key"), F.lit(m)) == 0).select(F.explode("tokens").alias("token"))
    least = max(COMMON_LEAST, int(COMMON_SHARE * rows / m))
    found = sample.groupBy("token").count().where(F.col("count") >= least).select("token").toArrow()
    return np.sort(found.column("token").to_numpy())


def _inside(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def rank(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Tokens of the first share by count; the few beyond it after them, alike (their hash decides)."""
    return np.where(token.astype(np.uint64) < _FIRST, count, 2 * COMMON)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: runs of two keys or more, ranked by their length, at most LONGEST.

    A run that grows beyond LONGEST goes out with that rank as it comes, so it is never held whole.
    """
    held_token, held_key = np.zeros(0, np.int64), np.zeros(0, np.int64)
    last: tuple[int, int] | None = None  # the row before those held
    growing: int | None = None  # the token whose run has gone out in part

    def out(token: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(token), 100_000):
            t, k, c = token[i : i + 100_000], key[i : i + 100_000], count[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(rank(t, c)), pa.array(t)], ["key", "rank", "token"])

    def runs(token: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        count = np.repeat(np.where(token[first] == growing, LONGEST, count) if growing is not None else count, count)
        at = count > 1
        yield from out(token[at], key[at], np.minimum(count[at], LONGEST))

    for b in batches:
        token, key = b.column("token").to_numpy(), b.column("key").to_numpy()
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        new[0] = (token[0], key[0]) != last
        last = token[-1], key[-1]
        held_token, held_key = np.append(held_token, token[new]), np.append(held_key, key[new])
        if not len(held_token):
            continue
        begin = int(np.searchsorted(held_token, held_token[-1]))
        if begin:
            yield from runs(held_token[:begin], held_key[:begin])
            held_token, held_key = held_token[begin:], held_key[begin:]
        if len(held_token) > LONGEST or held_token[0] == growing:
            growing = held_token[0]
            yield from out(held_token, held_key, np.full(len(held_token), LONGEST))
            held_token, held_key = held_token[:0], held_key[:0]
    if len(held_token):
        yield from runs(held_token, held_key)


def shared_tokens(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, rank, token) of every class's tokens that some other class has too; rank orders the prefix."""

    def rows(batches: Iterator[pa.RecordBatch], want_common: bool) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys = b.column("key").to_pylist()
            keep = [i for i, k in enumerate(keys) if k is not None and not (k in seen or seen.add(k))]
            if len(seen) > 1_000_000:
                seen.clear()  # then copies are told apart again later
            if not keep:
                continue
            lists = b.column("tokens").take(pa.array(keep))
            flat = lists.flatten().to_numpy()
            key = np.repeat(np.array([keys[i] for i in keep], np.int64), np.diff(lists.offsets.to_numpy()))
            ok = _inside(flat, common) == want_common
            yield pa.RecordBatch.from_arrays([pa.array(flat[ok]), pa.array(key[ok])], ["token", "key"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, True):
            token = b.column("token").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(rank(token, np.full(len(token), COMMON))), b.column("token")], ["key", "rank", "token"])

    few = sets.select("key", "tokens")
    parts = 2 * shuffle_parts(sets.sparkSession)
    rare = few.mapInArrow(lambda b: rows(b, False), "token long, key long").repartition(parts, "token").sortWithinPartitions("token", "key")
    out = rare.mapInArrow(counted, "key long, rank long, token long")
    if len(common):
        out = out.unionAll(few.mapInArrow(ranked, "key long, rank long, token long").distinct())
    return out


def near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def room(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Sizes and signatures (rows of uint64) leave room for the overlap needed: a set has an element of its own for each bit that only it has."""
    own = lambda x, y: np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - own(bits_a, bits_b), n_b - own(bits_b, bits_a)) >= needed(n_a, n_b, percent)


def _bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def short_lists(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """From rows token, key, n sorted by token: all pairs of near sizes of each list of SHORT rows at most. Longer lists are passed over."""
    held = [np.zeros(0, np.int64)] * 3
    passed: int | None = None

    def pairs(token: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        at = np.flatnonzero(np.repeat((count > 1) & (count <= SHORT), count))
        for d in range(1, SHORT):
            at = at[at + d < len(token)]
            at = at[token[at] == token[at + d]]  # rows that have a d-th one after them in their list
            if not len(at):
                return
            near = at[near_sizes(n[at], n[at + d], percent)]
            yield _links(key[near], key[near + d])

    for b in batches:
        rows = [np.append(h, b.column(c).to_numpy()) for h, c in zip(held, ("token", "key", "n"), strict=True)]
        if passed is not None:
            rows = [r[rows[0] != passed] for r in rows]
        if not len(rows[0]):
            held = rows
            continue
        begin = int(np.searchsorted(rows[0], rows[0][-1]))
        if begin:
            yield from pairs(*(r[:begin] for r in rows))
        held = [r[begin:] for r in rows]
        if len(held[0]) > SHORT:
            passed, held = held[0][0], [h[:0] for h in held]
    if len(held[0]):
        yield from pairs(*held)


def spanning_possible(n: np.ndarray, bits: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Pairs that connect what all possible links connect, within one block (side 2) or between two (sides 0 and 1)."""
    order = np.argsort(n, kind="stable")
    n, bits, side, group = n[order], bits[order], side[order], np.arange(len(n))
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    for i, end in enumerate(ends):
        others = np.arange(i + 1, end)
        others = others[(group[i + 1 : end] != group[i]) & ((side[i] == 2) | (side[i + 1 : end] != side[i]))]
        others = others[room(n[i], bits[i], n[others], bits[others], percent)]
        if len(others):
            met, at = np.unique(group[others], return_index=True)
            yield from ((order[i], order[others[j]]) for j in at)
            group[np.isin(group, met)] = group[i]


def long_lists(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """From rows of block pairs, sorted by token, i and j: spanning_possible() of each. One block pair is held at a time, and one batch."""
    held: pa.Table | None = None

    def links(t: pa.Table) -> pa.RecordBatch:
        key = t.column("key").to_numpy()
        found = list(spanning_possible(t.column("n").to_numpy(), _bit_rows(t.column("bits")), t.column("side").to_numpy(), percent))
        return _links(*(key[np.array([f[x] for f in found], np.int64)] for x in (0, 1)))

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows, bool)
        for c in ("token", "i", "j"):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        for a, z in zip(starts, starts[1:]):
            yield links(t.slice(a, z - a))
        held = t.slice(starts[-1])
    if held is not None:
        yield links(held)


def possible_links(prefix: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) keys, from rows token, key, n: pairs that share a token and that sizes and signatures allow, as many as connect all of them."""
    parts = 2 * shuffle_parts(prefix.sparkSession)
    dealt = prefix.repartition(parts, "token").sortWithinPartitions("token")
    short = dealt.mapInArrow(lambda b: short_lists(b, percent), "a long, b long").distinct()
    of = classes.select("key", "n", "bits")
    a, b = (of.toDF(x, f"n_{x}", f"bits_{x}") for x in "ab")

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            n_a, n_b = r.column("n_a").to_numpy(), r.column("n_b").to_numpy()
            ok = pa.array(room(n_a, _bit_rows(r.column("bits_a")), n_b, _bit_rows(r.column("bits_b")), percent))
            yield r.select(["a", "b"]).filter(ok)

    near = short.join(a, "a").join(b, "b").mapInArrow(allowed, "a long, b long")
    lengths = prefix.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("m")).where(F.col("m") > SHORT).drop("m")
    rows = prefix.join(lengths, "token").withColumn("c", F.pmod(F.xxhash64("key"), F.col("blocks")))
    rows = rows.drop("n").join(of, "key").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1)
    rows = rows.select("token", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "key", "n", "bits", side.alias("side"))
    far = rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lambda b: long_lists(b, percent), "a long, b long")
    return near.unionAll(far)


def candidate_groups(sets: DataFrame, classes: DataFrame, rows: int, percent: int = PERCENT) -> DataFrame:
    """(key, grp): every linked pair of different classes is in one group."""
    shared = shared_tokens(sets, common_tokens(sets, rows))
    lists = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("s"))
    own = lists.join(classes.select("key", "n", "k"), "key")
    # p tokens make the prefix; those that no other class has come first in it
    p = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    take = p - (F.col("k") - F.size("s"))
    prefix = written(own.where(take > 0).select("key", "n", F.explode(F.slice("s", F.lit(1), take.cast("int"))).alias("t")).select("t.token", "key", "n"), "prefix")
    return components(possible_links(prefix, classes, percent)).toDF("key", "grp")


class Node:
    """A node of a signature tree: members [a, b) of the ordered chunk."""

    __slots__ = ("a", "b", "bits", "lo", "hi", "slack", "parts", "one")

    def __init__(self, a, b, bits, lo, hi, slack, parts) -> None:
        self.a, self.b, self.bits, self.lo, self.hi, self.slack, self.parts, self.one = a, b, bits, lo, hi, slack, parts, False


class SignatureTree:
    FAN = 8

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS), bool)
        for i, s in enumerate(sets):
            bits[i, (s & np.uint64(BITS - 1)).astype(np.int64)] = True
        self.bits = np.packbits(bits, axis=1)
        pop = bits.sum(axis=1)
        slack = self.sizes - pop
        level = [
            Node(a, b := min(a + self.FAN, len(sets)), np.bitwise_or.reduce(self.bits[a:b]), self.sizes[a:b].min(), self.sizes[a:b].max(), slack[a:b].max(), None)
            for a in range(0, len(sets), self.FAN)
        ]
        while len(level) > 1:
            up = []
            for i in range(0, len(level), self.FAN):
                parts = level[i : i + self.FAN]
                bits_ = np.bitwise_or.reduce([p.bits for p in parts])
                up.append(Node(parts[0].a, parts[-1].b, bits_, min(p.lo for p in parts), max(p.hi for p in parts), max(p.slack for p in parts), parts))
            level = up
        self.root = level[0]


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap at which sets of these sizes link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    both = int(_inside(x, y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def spanning_links(left: SignatureTree, right: SignatureTree | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between two chunks, or within one (right None), that connect all that are linked.

    Members of the right chunk are numbered after those of the left one in the union-find.
    """
    other = right or left
    shift = len(left.sets) if right else 0
    union, out = Union(len(left.sets) + (len(right.sets) if right else 0)), []
    popcount = np.bitwise_count

    def one(node: Node, off: int) -> bool:
        """All members are connected already."""
        if not node.one:
            r = union.find(node.a + off)
            node.one = all(union.find(i + off) == r for i in range(node.a, node.b))
        return node.one

    stack = [(left.root, other.root)]
    while stack:
        p, q = stack.pop()
        if 100 * p.hi < percent * q.lo or 100 * q.hi < percent * p.lo:
            continue
        most = min(p.hi, q.hi, int(popcount(p.bits & q.bits).sum()) + max(p.slack, q.slack))
        if most < needed(int(p.lo), int(q.lo), percent):
            continue
        if union.find(p.a) == union.find(q.a + shift) and one(p, 0) and one(q, shift):
            continue
        if p.parts is None and q.parts is None:
            for i in range(p.a, p.b):
                spare = left.sizes[i] - popcount(left.bits[i] & ~other.bits[q.a : q.b]).sum(axis=1)
                for j in range(max(q.a, i + 1) if right is None else q.a, q.b):
                    if spare[j - q.a] < needed(int(left.sizes[i]), int(other.sizes[j]), percent):
                        continue
                    a, b = union.find(i), union.find(j + shift)
                    if a != b and linked(left.sets[i], other.sets[j], percent):
                        union.up[a] = b
                        out.append((i, j))
        elif q.parts is None or (p.parts is not None and p.b - p.a >= q.b - q.a):
            stack += [(x, q) for x in p.parts if right or x.a < q.b]
        else:
            stack += [(p, y) for y in q.parts if right or p.a < y.b]
    return out


def _verify(group: pa.Table, percent: int) -> pa.Table:
    """One chunk pair: rows key, text, side (0 left, 1 right, 2 both: the chunk with itself)."""
    keys, side = group.column("key").to_pylist(), group.column("side").to_pylist()
    sets = [shingles(t.as_py()) for t in group.column("text")]
    ends = []
    pick = lambda which: sorted((i for i, s in enumerate(side) if s == which), key=lambda i: (len(sets[i]), sets[i].tobytes()[:64]))
    if both := pick(2):
        tree = SignatureTree([sets[i] for i in both])
        ends = [(keys[both[a]], keys[both[b]]) for a, b in spanning_links(tree, None, percent)]
    elif (a_side := pick(0)) and (b_side := pick(1)):
        trees = SignatureTree([sets[i] for i in a_side]), SignatureTree([sets[i] for i in b_side])
        ends = [(keys[a_side[a]], keys[b_side[b]]) for a, b in spanning_links(*trees, percent)]
    return pa.table({"a": pa.array([e[0] for e in ends], pa.int64()), "b": pa.array([e[1] for e in ends], pa.int64())})


def _chunks(which: Column | None = None) -> Column:
    """Chunks that the rows (n: shingles) of a group make, or those of them for which the condition holds."""
    which = F.lit(True) if which is None else which
    return F.ceil(F.greatest(F.count_if(which) / CHUNK, F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / CHUNK_SHINGLES))


def _hub_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a hub key, b key) of members linked to their group's hub, its class of the smallest hash.

    The hub's text is one more row of its group, in front of the members it goes with: groups are dealt in parts
    of about CHUNK members, each part with a copy of the hub, and no text is repeated beside every member.
    """
    hubs = members.groupBy("grp").agg(F.min_by("key", F.xxhash64("key")).alias("hub"), _chunks().alias("parts"))
    m = members.join(hubs, "grp")
    own = m.where("key <> hub").select("grp", "hub", "key", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).alias("part"))
    fronts = hubs.select("grp", "hub", F.col("hub").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = own.unionByName(fronts).join(texts, "key")
    dealt = rows.repartition(2 * shuffle_parts(members.sparkSession), "grp", "part").sortWithinPartitions("grp", "part", F.col("key") != F.col("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = None
        for b in batches:
            ok = []
            for hub, key, text in zip(b.column("hub").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                s = shingles(text.as_py())
                if key == hub:
                    hub_set = s
                ok.append(key != hub and linked(hub_set, s, percent))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column("hub").take(at), b.column("key").take(at)], ["a", "b"])

    return dealt.select("hub", "key", "text").mapInArrow(run, "a long, b long")


def class_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(key, text): one text of each class, read by its doc_id; texts without a doc_id, or under a shared one, by their own hash."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    reps = members.select("key", "rep.doc_id", "rep.text_key")
    named = reps.where("doc_id is not null").join(d, ["doc_id", "text_key"])
    unnamed = reps.where("doc_id is null").drop("doc_id").join(d.where("doc_id is null").drop("doc_id"), "text_key")
    # repeated rows of one document are one text
    named, unnamed = (x.groupBy(*by).agg(F.min("key").alias("key"), F.min("text").alias("text")).select("key", "text") for x, by in ((named, ("doc_id", "text_key")), (unnamed, ("text_key",))))
    return named.unionAll(unnamed)


def class_links(docs: DataFrame, groups: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) keys: links that connect within each group exactly what all its links connect."""
    members = groups.join(classes.select("key", "rep", "n"), "key")
    texts = written(class_texts(docs, members), "texts")
    size = members.groupBy("grp").agg(_chunks().alias("size"))
    members = written(members.join(size, "grp").select("key", "grp", "n", "size"), "members")
    hub = written(_hub_links(members.where(F.col("size") > 1).select("key", "grp", "n"), texts, percent), "hubs")
    near = hub.select(F.col("b").alias("key")).unionAll(hub.select(F.col("a").alias("key"))).distinct().withColumn("near", F.lit(True))
    m = members.join(near, "key", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    # chunks of the members that the hub left over (0 .. far-1) and of the others (far .. far+near-1)
    sizes = m.groupBy("grp").agg(_chunks(~F.col("near")).alias("far_n"), _chunks(F.col("near")).alias("near_n"))
    m = m.join(sizes, "grp")
    h = F.xxhash64("key")
    chunk = F.when(F.col("near"), F.col("far_n") + F.pmod(h, F.col("near_n"))).otherwise(F.pmod(h, F.col("far_n")))
    m = m.withColumn("c", chunk.cast("int"))
    # a leftover chunk meets every chunk; a chunk near the hub meets leftover chunks only
    last = F.when(F.col("near"), F.col("far_n")).otherwise(F.col("far_n") + F.col("near_n")).cast("int")
    m = m.where(last > 0).withColumn("o", F.explode(F.sequence(F.lit(0), last - 1)))
    side = F.when(F.col("c") == F.col("o"), 2).when(F.col("c") < F.col("o"), 0).otherwise(1)
    m = m.select("key", "grp", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), side.alias("side"))
    found = m.join(texts, "key").groupBy("grp", "i", "j").applyInArrow(lambda t: _verify(t, percent), "a long, b long")
    return found.unionAll(hub)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; text_key and component name its row and its group (null: no shingles)."""
    sets = written(token_sets(docs, percent), "sets")
    rows = sets.count()
    sets, classes = set_classes(sets)
    classes = written(classes, "classes")
    groups = written(candidate_groups(sets, classes, rows, percent), "groups")
    links = class_links(docs, groups, classes, percent)
    joined = classes.select("key", "rep").join(components(links).toDF("key", "c"), "key", "left").withColumn("c", F.coalesce("c", "key"))
    names = joined.groupBy("c").agg(F.min("rep.doc_id").alias("component"))
    named = joined.join(names, "c").select("key", "component", "c")
    out = sets.select("doc_id", "text_key", "n", "key").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "text_key", F.col("c").alias("component"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s
  FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS tok FROM g),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o, any_value(a.n) AS nx, any_value(b.n) AS ny
      FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c WHERE 100 * o >= 80 * (nx + ny - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, m.c AS component_id
FROM g JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = g.doc_id
"""
