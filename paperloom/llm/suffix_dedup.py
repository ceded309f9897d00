"""Removal of repeated byte strings by column-wise suffix sorting of many documents at once.

A string of `LENGTH` bytes that also starts earlier in the collection is a repeat. Suffixes are sorted
column by column, as in multi-document constructions of the Burrows-Wheeler transform: each round takes one
symbol of every document from right to left, puts the documents in the order of their suffixes (a stable sort by
the new symbol of the order before), and updates the common prefixes of neighbours from those of the round before.
Documents here are short aligned blocks, for a whole text would need as many rounds as it has bytes:

1. Anchors. In each window of LENGTH bytes the GRAM-byte strings with the least hash are anchors. Equal windows
   have equal anchors at equal places, so a repeated window shows as a repeated anchor; anchors that occur once
   in the corpus go no further.
2. Blocks. Around each repeated anchor the block of bytes that covers the windows it stands for is cut out, aligned
   at the anchor, and dealt out by the anchor's hash. Of equal blocks in a task only the first goes on and the
   others are reported at once, so hot passages arrive as one block per task. Anchors that a sample finds in many
   documents are salted.
3. Columns. A task sorts its blocks as above, in batches. In each column, runs of neighbours with LENGTH common
   bytes are equal windows; all but the one that starts first are repeats.
4. Merge. Where an anchor's blocks were dealt to several batches, the windows that each batch leaves meet once more,
   dealt out by their 128-bit digests; again the one that starts first stays.
5. The repeats of a document, as intervals of window starts, meet its text again, and covered bytes go.

Tasks read rows that Spark has sorted (and can spill) and hold one batch of at most COLUMN_ROWS blocks. The order, the
transform's current column and the common prefixes of a batch are arrays in memory, read and written in sequence.

Defined results: null text is empty; texts shorter than LENGTH bytes have no repeats; repeated rows of one doc_id
are one document; different texts under one doc_id are that document's texts in the order of their hashes, and
no match crosses them; rows without a doc_id take no part and keep all; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, table, written

LENGTH, GRAM = 100, 24
#: Starts of grams within one window.
REACH = LENGTH - GRAM + 1
#: Columns of an aligned block: the anchor's gram is at column REACH - 1.
WIDTH = REACH - 1 + LENGTH
#: Documents in the sample that finds hot anchors, and what makes one hot.
SAMPLE_DOCS, HOT_SHARE, HOT_LEAST = 4_000, 0.01, 40
#: salts: 0, or in how many parts the anchor's blocks are dealt.
ANCHOR = "h long, doc_id long, pos long, salts int"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (24) bytes from each start: of 8 and of 16 bytes by doubling, then of both together."""
    h, span = data.astype(np.uint64) + np.uint64(1), 1
    for odd in _ODD[:4]:
        eight = h
        h = h[:-span] * odd + h[span:]
        h ^= h >> np.uint64(31)
        span *= 2
    h = h[:-8] * _ODD[4] + eight[16:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each run of `width` values, by doubling."""
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least gram of every window of LENGTH bytes (of equal ones, all)."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = sliding(h, REACH, np.minimum)
    pad = np.zeros(REACH - 1, np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), REACH, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, off) of rows with a doc_id. off is 0, but where a doc_id has several texts they follow each other."""
    d = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("t"))
    w = Window.partitionBy("doc_id").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    texts = d.select("doc_id", "t", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")).distinct()
    later = written(texts.select("doc_id", "t", F.sum("n").over(w).alias("off")).where("off > 0"), "texts")
    return d.join(later, ["doc_id", "t"], "left").select("doc_id", "text", F.coalesce("off", F.lit(0)).alias("off"))


def anchor_rows(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """ANCHOR rows of docs (doc_id, text, off); hot: sorted hashes that are known to repeat a lot, and their salts."""
    names, salts = np.append(hot[0], 0), np.append(hot[1], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, doc, pos, held = [], [], [], 0
            ids, off = b.column("doc_id").to_numpy(), b.column("off").to_numpy()
            for i, text in enumerate(b.column("text")):
                at, hash_ = anchors(_bytes(text))
                h.append(hash_.astype(np.int64))
                pos.append(at + off[i])
                doc.append(np.full(len(at), ids[i], np.int64))
                held += len(at)
                if held > 100_000 or i == b.num_rows - 1:
                    all_h = np.concatenate(h)
                    place = np.searchsorted(names[:-1], all_h)
                    found = np.where(names[place] == all_h, salts[place], 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(all_h), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos)), pa.array(found.astype(np.int32))], ["h", "doc_id", "pos", "salts"]
                    )
                    h, doc, pos, held = [], [], [], 0

    return docs.mapInArrow(run, ANCHOR)


def hot_anchors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that many documents of a bounded sample have, and the salts for each: the root of its likely count.

    They skip the counting shuffle; results don't depend on them.
    """
    rows = docs.count()
    m = max(1, rows // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = anchor_rows(sample, none).groupBy("h").count().where(F.col("count") >= max(HOT_LEAST, int(HOT_SHARE * rows / m))).toArrow()
    h, count = found.column("h").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], np.ceil(np.sqrt(count[order] * m)).astype(np.int64)


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """The anchors whose hash occurs at two places or more; hot ones pass through wherever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row so far, and the hash of the row before it
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            h, hot = t.column("h").to_numpy(), t.column("salts").to_numpy() > 0
            same = h[1:] == h[:-1]
            keep = np.concatenate([[h[0] == before], same]) | np.concatenate([same, [False]]) | hot
            before = h[-2] if len(h) > 1 else before
            again = bool(keep[-1])
            keep[-1] = False
            yield from t.filter(pa.array(keep)).to_batches()
            held = t.slice(len(h) - 1).to_batches()[0]
        if held is not None and again:
            yield held

    parts = 2 * shuffle_parts(rows.sparkSession)
    deal = F.when(F.col("salts") > 0, F.xxhash64("doc_id", "pos")).otherwise(F.col("h"))
    return rows.repartition(parts, deal).sortWithinPartitions("h").mapInArrow(run, ANCHOR)


BLOCK = "key long, doc_id long, lo int, hi int, pos long, block binary, salted boolean"


def blocks(docs: DataFrame, anchors_: DataFrame) -> DataFrame:
    """Blocks (key, doc_id, lo, hi, pos, block, salted) around repeated anchors of docs (doc_id, text, off).

    A block stands for the windows that start at pos + lo .. pos + hi (columns lo .. hi). Rows without a
    block report windows that a block of the same task has already: repeats for certain. The key is the
    anchor's hash, with a salt for hot ones.
    """
    # dealt as plain rows: partial lists would be larger, as a task has few anchors of any one document
    lists = anchors_.repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("pos", "h", "salts"))).alias("at"))
    joined = docs.join(lists, "doc_id").select("doc_id", "text", "off", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, off = b.column("doc_id").to_numpy(), b.column("off").to_numpy()
            lists_ = b.column("at")
            inner = lists_.flatten()
            all_pos, all_h, all_salts = (inner.field(c).to_numpy() for c in ("pos", "h", "salts"))
            ends = np.cumsum(lists_.value_lengths().to_numpy())
            first: dict[tuple[int, int, bytes], tuple[int, int, int, int, bool]] = {}
            again: set[tuple[int, int, int, int]] = set()
            for i, text in enumerate(b.column("text")):
                if not text.is_valid:
                    continue
                raw, doc = text.as_buffer().to_pybytes(), int(ids[i])
                a, z = ends[i - 1] if i else 0, ends[i]
                a, z = a + np.searchsorted(all_pos[a:z], [off[i], off[i] + len(raw)])  # anchors of this text of the document
                for p, lo, hi, h, salts in _windows(raw, all_pos[a:z] - off[i], all_h[a:z], all_salts[a:z]):
                    start = p - (REACH - 1)
                    if salts:
                        h = xxhash.xxh64_intdigest((doc % 2**64).to_bytes(8), h % 2**64) % salts + h
                    name, me = (h, lo, raw[start + lo : start + hi + LENGTH]), (doc, start + int(off[i]), lo, hi, salts > 0)
                    old = first.setdefault(name, me)
                    if old != me:
                        if me < old:
                            first[name], me = me, old
                        again.add(me[:4])
                if len(first) + len(again) > 100_000:
                    yield _block_batch(first, again)
                    first.clear()
                    again.clear()
            yield _block_batch(first, again)

    return joined.mapInArrow(run, BLOCK)


def least_places(h: np.ndarray) -> np.ndarray:
    """For each window, the first place of its least gram hash; by doubling."""
    at, span = np.arange(len(h)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[a] <= h[b], a, b)

    while span * 2 <= REACH:
        at = better(at[:-span], at[span:])
        span *= 2
    return better(at[: len(at) - (REACH - span)], at[REACH - span :]) if REACH > span else at


def _windows(raw: bytes, pos: np.ndarray, h: np.ndarray, salts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Per repeated anchor: place, first and last column of the windows whose first least gram it is, hash, salts.

    That gram depends on the window's bytes alone, so equal windows belong to equal anchors in equal columns.
    """
    if len(raw) < LENGTH:
        return iter(())
    owner = least_places(gram_hashes(np.frombuffer(raw, np.uint8)))
    lo, hi = np.searchsorted(owner, pos, side="left"), np.searchsorted(owner, pos, side="right") - 1
    ok = lo <= hi
    base = pos - (REACH - 1)
    return zip(pos[ok].tolist(), (lo - base)[ok].tolist(), (hi - base)[ok].tolist(), h[ok].tolist(), salts[ok].tolist(), strict=True)


def _block_batch(first: dict, again: set) -> pa.RecordBatch:
    """Blocks, and the windows that equal blocks have already, joined where they touch."""
    joined: list[list[int]] = []
    for doc, a, b in sorted((doc, start + lo, start + hi) for doc, start, lo, hi in again):
        if joined and joined[-1][0] == doc and a <= joined[-1][2] + 1:
            joined[-1][2] = max(b, joined[-1][2])
        else:
            joined.append([doc, a, b])
    # key, doc_id, pos, lo, hi, salted, block
    rows = [(k[0], *v, k[2]) for k, v in first.items()] + [(doc * 2654435761 + a * 40503, doc, a, 0, b - a, False, None) for doc, a, b in joined]
    column = lambda i, kind: pa.array([r[i] for r in rows], kind)
    key = [((r[0] + 2**63) % 2**64) - 2**63 for r in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), column(1, pa.int64()), column(3, pa.int32()), column(4, pa.int32()), column(2, pa.int64()), column(6, pa.binary()), column(5, pa.bool_())],
        ["key", "doc_id", "lo", "hi", "pos", "block", "salted"],
    )


def common_prefixes(lcp: np.ndarray, places: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Common prefixes of the new order from those of the old.

    lcp[i] is the common prefix of old neighbours i-1 and i; places are old places in the new order and symbols the new
    symbols in that order. Neighbours with one symbol share one byte more than the least value between their old
    places, which a table of minima over powers of two answers; others share nothing.
    """
    n = len(lcp)
    out = np.zeros(n, lcp.dtype)
    if n < 2:
        return out
    a, b = places[:-1] + 1, places[1:]
    same = np.flatnonzero(symbols[1:] == symbols[:-1])
    a, b = a[same], b[same]
    power = np.frexp(b - a + 1)[1] - 1  # floor of the binary logarithm
    least = np.empty(len(same), lcp.dtype)
    level, span = lcp, 1
    for k in range(int(power.max(initial=0)) + 1):
        at = np.flatnonzero(power == k)
        least[at] = np.minimum(level[a[at]], level[b[at] - span + 1])
        if 2 * span <= n:
            level = np.minimum(level[:-span], level[span:])
        span *= 2
    out[same + 1] = np.minimum(least, 250) + 1
    return out


def repeats(doc: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, column) of all windows that an earlier window equals.

    matrix: blocks x WIDTH symbols, aligned at the anchor. Blocks of other anchors never share LENGTH bytes in one column, as equal
    windows have equal anchors, so one sort serves all anchors of a batch.
    """
    n = len(doc)
    order = np.lexsort((pos, doc))  # equal suffixes stay in the order of the collection
    lcp = np.zeros(n, np.uint8)
    found_block, found_column = [], []
    for column in range(WIDTH - 1, -1, -1):
        # the transform's next column: in the order of the suffixes so far, the symbol before each
        bwt = matrix[order, column]
        places = np.argsort(bwt, kind="stable")  # where each symbol's suffix goes: those of one symbol keep their order
        lcp = common_prefixes(lcp, places, bwt[places])
        order = order[places]
        if column < REACH:
            valid = (lo[order] <= column) & (column <= hi[order])
            new_run = lcp < LENGTH
            run = np.cumsum(new_run)
            at = np.flatnonzero(valid)
            if len(at):
                # within a run of equal windows the earliest start stays
                first = np.lexsort((pos[order[at]], doc[order[at]], run[at]))
                at = at[first]
                head = np.concatenate([[True], run[at][1:] != run[at][:-1]])
                block, lead = order[at], order[at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]]
                block = block[(doc[block] != doc[lead]) | (pos[block] != pos[lead])]
                found_block.append(block)
                found_column.append(np.full(len(block), column))
    if not found_block:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_block), np.concatenate(found_column)


#: Blocks sorted together. A batch ends between two anchors, unless one anchor has more blocks than this.
COLUMN_ROWS = 20_000
#: An interval of window starts (key null), or a window that has to meet those of other batches (start only).
FOUND = "key long, tail long, doc_id long, start long, end long"


def _found(doc: np.ndarray, start: np.ndarray, end: np.ndarray | None = None, digest: list[bytes] | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) if digest is not None else None
    return pa.RecordBatch.from_arrays(
        [none if digest is None else pa.array(halves[:, 0]), none if digest is None else pa.array(halves[:, 1]), pa.array(doc), pa.array(start), none if end is None else pa.array(end)],
        ["key", "tail", "doc_id", "start", "end"],
    )


def _joined(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Window starts as intervals."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(doc))[: len(a)] - 1
    return _found(doc[a], start[a], start[b])


def _solve(part: pa.Table, open_key: int | None) -> Iterator[pa.RecordBatch]:
    """One batch of blocks. Those of salted anchors and of open_key, which other batches hold too, leave their windows to merge."""
    import xxhash

    key, doc, lo, hi, start, salted = (part.column(c).to_pylist() for c in ("key", "doc_id", "lo", "hi", "pos", "salted"))
    again: list[int] = []
    first: dict[tuple[int, int, bytes], int] = {}
    for i, content in enumerate(part.column("block").to_pylist()):
        if content is None:
            again.append(i)
            continue
        name = key[i], lo[i], content
        old = first.setdefault(name, i)
        if old != i:
            if (doc[i], start[i]) < (doc[old], start[old]):
                first[name], i, old = i, old, i
            if (doc[i], start[i]) != (doc[old], start[old]):
                again.append(i)
    if again:
        yield _found(np.array([doc[i] for i in again]), np.array([start[i] + lo[i] for i in again]), np.array([start[i] + hi[i] for i in again]))
    if not first:
        return
    at = list(first.values())
    matrix = np.zeros((len(first), WIDTH), np.uint8)
    for row, (_, left, content) in enumerate(first):
        matrix[row, left : left + len(content)] = np.frombuffer(content, np.uint8)
    d, s, a, z = (np.array([x[i] for i in at], np.int64) for x in (doc, start, lo, hi))
    block, column = repeats(d, s, a, z, matrix)
    if len(block):
        yield _joined(d[block], s[block] + column)
    meet = np.flatnonzero([salted[i] or key[i] == open_key for i in at])
    if len(meet):
        gone = np.zeros((len(at), REACH), bool)
        gone[block, column] = True
        for i in range(0, len(meet), 1000):
            left = [(m, c) for m in meet[i : i + 1000].tolist() for c in range(a[m], z[m] + 1) if not gone[m, c]]
            rows, columns = np.array(left, np.int64).reshape(-1, 2).T
            yield _found(d[rows], s[rows] + columns, digest=[xxhash.xxh3_128_digest(matrix[m, c : c + LENGTH].tobytes()) for m, c in left])


def sort_columns(rows: DataFrame) -> DataFrame:
    """FOUND rows of dealt blocks: repeats as intervals, and windows that are still to merge."""
    dealt = rows.repartition(2 * shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        open_key: int | None = None
        for b in batches:
            more = pa.Table.from_batches([b])
            held = more if held is None else pa.concat_tables([held, more])
            while held.num_rows >= COLUMN_ROWS:
                key = held.column("key").to_numpy()
                last = key[COLUMN_ROWS - 1]
                begin, end = np.searchsorted(key, last), np.searchsorted(key, last, side="right")
                cut = COLUMN_ROWS
                if end > cut or end == len(key):  # the batch would end within this anchor's blocks, as far as is known
                    if begin:
                        cut = int(begin)
                    else:
                        open_key = int(last)
                yield from _solve(held.slice(0, cut), open_key)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from _solve(held, open_key)

    return dealt.mapInArrow(run, FOUND)


def merged(found: DataFrame) -> DataFrame:
    """(doc_id, start, end): all repeats as intervals of window starts, both included."""
    deal = F.coalesce("key", F.xxhash64("doc_id", "start"))
    dealt = found.repartition(2 * shuffle_parts(found.sparkSession), deal).sortWithinPartitions("key", "tail", "doc_id", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "tail", "doc_id", "start")
        lead = None  # the first row of the run of equal windows so far
        for b in batches:
            whole = b.filter(pc.is_null(b.column("key")))
            if whole.num_rows:
                yield whole.select(["doc_id", "start", "end"])
            b = b.filter(pc.is_valid(b.column("key")))
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy() for c in names], axis=1)
            if lead is not None:
                rows = np.vstack([lead, rows])
            head = np.ones(len(rows), bool)
            head[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            leads = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
            again = rows[(rows[:, 2:] != leads[:, 2:]).any(axis=1)]
            lead = leads[-1:]
            if len(again):
                yield _joined(again[:, 2], again[:, 3]).select(["doc_id", "start", "end"])

    return dealt.mapInArrow(run, "doc_id long, start long, end long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes)."""
    # both joins read the texts dealt by doc_id in the same way, so one shuffle of them serves both
    named = placed(docs)
    found = repeated_anchors(anchor_rows(named, hot_anchors(named)))
    starts = merged(sort_columns(blocks(named, found)))
    lists = starts.repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at"))
    unnamed = docs.where("doc_id is null").select("doc_id", "text", F.lit(0).cast("long").alias("off"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("at"))
    joined = named.join(lists, "doc_id", "left").select("doc_id", "text", "off", "at").unionAll(unnamed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for text, at, off in zip(b.column("text"), b.column("at"), b.column("off").to_pylist(), strict=True):
                data = _bytes(text)
                n.append(len(data))
                if not at.is_valid:
                    removed.append(0)
                    spans.append(0)
                    kept.append(data.tobytes())
                    continue
                pairs = at.values
                a, z = pairs.field("start").to_numpy() - off, pairs.field("end").to_numpy() - off + LENGTH
                here = (a >= 0) & (a < len(data))  # a doc_id's other texts have intervals of their own
                a, z = a[here], z[here]
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, z, -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
