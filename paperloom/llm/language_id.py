"""Language identification by segmentation-marginalised unigram models.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a word is the
sum over all its segmentations into pieces, found by a forward pass; texts are scored by the product over their words.
Piece probabilities are fitted by expectation-maximisation: the expected piece counts of all segmentations
of a bounded training sample's words (at most TRAIN_DOCS documents a language, those with the smallest hash) are
computed in tasks by forward-backward passes and summed by Spark; only the table of pieces x languages,
bounded by the vocabulary, reaches the driver.

Words are runs of letters, lower-cased, of any length. A letter costs a fixed small probability in all languages when
no piece covers it. All words of a batch and all languages go through the passes together, and sums are scaled on the
way, so that long words do not underflow. Scores of distinct words are remembered within a task, in a table that
is emptied when full.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled training text all
texts are `und`; ties go to the first language by name; repeated rows are scored alike; texts of any
length are scored whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, shuffle_parts, table, written

LETTERS = re.compile(r"[^\W\d_]+")
TRAIN_DOCS = 1500
ROUNDS = 2
#: Probability of a letter that no piece covers, and the share of counts given to all pieces alike.
UNKNOWN, SMOOTH = 1e-7, 0.1
CACHE = 400_000
#: Letters after which sums are scaled anew: UNKNOWN ** (2 * RESCALE) must be a normal number.
RESCALE = 16
UND = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, without the word-start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).replace("▁", "") for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == p.lower() and LETTERS.fullmatch(p))


def words(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if not any(c.isalpha() for w in found for c in w):
        return []  # numerals such as one half count as word characters, but are no letters
    return found


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Pieces:
    """Finds all pieces inside words: prefixes of pieces by length, as sorted 64-bit hashes."""

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=0)
        self.hashes, self.ids = [], []
        for n in range(1, self.longest + 1):
            ids = {p[:n]: -1 for p in pieces if len(p) >= n} | {p: i for i, p in enumerate(pieces) if len(p) == n}
            h = np.zeros(len(ids), np.uint64)
            flat = letters("".join(ids)).reshape(-1, n)
            for k in range(n):
                h = self._next(h, flat[:, k])
            order = np.argsort(h)
            self.hashes.append(h[order])
            self.ids.append(np.array(list(ids.values()), np.int64)[order])

    @staticmethod
    def _next(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        h = (h + letter + np.uint64(1)) * _ODD
        return h ^ (h >> np.uint64(29))

    def spans(self, flat: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length 1, 2, ...: starts and piece ids. left: letters from each place to its word's end."""
        out, at, h = [], np.arange(len(flat)), np.zeros(len(flat), np.uint64)
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, h = at[inside], h[inside]
            h = self._next(h, flat[at + n - 1])
            place = np.minimum(np.searchsorted(self.hashes[n - 1], h), len(self.hashes[n - 1]) - 1)
            ok = self.hashes[n - 1][place] == h
            at, h, ids = at[ok], h[ok], self.ids[n - 1][place[ok]]
            out.append((at[ids >= 0], ids[ids >= 0]))
        return out


class Unigrams:
    """Sums over the segmentations of many words, for all languages at once. p: pieces x languages."""

    def __init__(self, pieces: Pieces, p: np.ndarray) -> None:
        self.pieces, self.n = pieces, p.shape[1]
        self.p = np.vstack([p, np.zeros((1, self.n))])  # the last row stands for no piece

    def _forward(self, start: np.ndarray, sizes: np.ndarray, spans: list, keep: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Words laid end to end, longest first: logs of the whole sums by word and, to keep, of the sums before each letter.

        The pass goes from letter to letter over all words that are long enough, which are the first ones.
        """
        n, total = len(sizes), int(sizes.sum())
        longest = int(sizes.max(initial=0))
        place = np.arange(total) - np.repeat(start, sizes)
        starts = []  # per length: the piece that starts at each letter
        fits: list[list[int]] = [[] for _ in range(longest + 1)]  # per end of a prefix: lengths of pieces that end there in some word
        for k, (at, ids) in enumerate(spans, 1):
            row = np.full(total, len(self.p) - 1, np.int32)
            row[at] = ids
            starts.append(row)
            for end in np.unique(place[at] + k).tolist():
                fits[end].append(k)
        active = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")
        window, scale = deque([np.ones((n, self.n))], max(1, len(spans))), np.zeros((n, self.n))
        whole, logs = np.zeros((n, self.n)), np.zeros((total if keep else 0, self.n))
        m = n
        for end in range(1, longest + 1):
            if active[end - 1] < m:
                m = active[end - 1]
                window, scale = deque([w[:m] for w in window], window.maxlen), scale[:m]
            here = start[:m] + end
            if keep:
                logs[here - 1] = np.log(window[-1]) + scale
            new = window[-1] * UNKNOWN
            for k in fits[end]:
                new += window[-k] * self.p[starts[k - 1][here - k]]
            window.append(new)
            if end % RESCALE == 0:
                window, scale = deque([w / new for w in window], window.maxlen), scale + np.log(new)
            if active[end] < m:
                whole[active[end] : m] = np.log(window[-1][active[end] :]) + scale[active[end] :]
        return whole, logs

    def _lay(self, found: list[str]) -> tuple:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        start = np.cumsum(sizes) - sizes
        flat = letters("".join(map(found.__getitem__, order.tolist())))
        return order, start, sizes, self.pieces.spans(flat, np.repeat(start + sizes, sizes) - np.arange(len(flat)))

    def log_probabilities(self, found: list[str]) -> np.ndarray:
        """words x languages: the log of the sum over all segmentations."""
        out = np.zeros((len(found), self.n))
        for a, b in passes(found):
            order, start, sizes, spans = self._lay(found[a:b])
            out[a + order] = self._forward(start, sizes, spans)[0]
        return out

    def expected(self, found: list[str], weight: np.ndarray) -> np.ndarray:
        """Pieces x languages: how often each piece is expected in the words' segmentations, words counted by weight."""
        return sum((self._expected(found[a:b], weight[a:b]) for a, b in passes(found)), np.zeros((len(self.p) - 1, self.n)))

    def _expected(self, found: list[str], weight: np.ndarray) -> np.ndarray:
        order, start, sizes, spans = self._lay(found)
        word = np.repeat(np.arange(len(sizes)), sizes)
        whole, ahead = self._forward(start, sizes, spans, keep=True)
        # the sums behind a place are those ahead of it in the word read backwards
        mirror = [(2 * start[word[at]] + sizes[word[at]] - at - k, ids) for k, (at, ids) in enumerate(spans, 1)]
        behind = self._forward(start, sizes, mirror, keep=True)[1]
        out = np.zeros((len(self.p) - 1, self.n))
        w = np.asarray(weight, float)[order]
        for (at, ids), (back, _) in zip(spans, mirror, strict=True):
            share = np.exp(ahead[at] + behind[back] - whole[word[at]]) * self.p[ids] * w[word[at], None]
            for k in range(self.n):
                out[:, k] += np.bincount(ids, weights=share[:, k], minlength=len(out))
        return out


#: Letters that go through a pass together, words that are looked up together, and bytes of text whose words a task holds.
LETTERS_AT_ONCE, WORDS_AT_ONCE, TEXT_BYTES = 300_000, 30_000, 4 << 20


def passes(found: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of words with at most LETTERS_AT_ONCE letters; a longer word is a run of its own."""
    start = held = 0
    for i, w in enumerate(found):
        if i > start and held + len(w) > LETTERS_AT_ONCE:
            yield start, i
            start, held = i, 0
        held += len(w)
    if found:
        yield start, len(found)


class Model(NamedTuple):
    langs: list[str]
    pieces: Pieces
    p: np.ndarray  # pieces x languages


def train(labelled: DataFrame, pieces: list[str], docs_per_language: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Per language, a probability for every piece. labelled: doc_id, text, lang."""
    spark = labelled.sparkSession
    d = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("k"))
    # per language the smallest hashes, found by aggregation: the sample is bounded, so is its collection
    kept = d.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not kept:
        return Model([], Pieces([]), np.zeros((0, 0)))
    edges = {r["lang"]: -(2**63) + int(2**64 * min(1.0, docs_per_language / r["n"])) - 1 for r in kept}
    inside = None
    for lang, edge in edges.items():
        c = (F.col("lang") == lang) & (F.col("k") <= edge)
        inside = c if inside is None else inside | c

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for w in words(text):
                    total[lang, w] += 1
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in total], "word": [k[1] for k in total], "n": pa.array(total.values(), pa.int64())})

    counted = d.where(inside).select("text", "lang").mapInArrow(count_words, "lang string, word string, n long")
    counted = written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words").repartition(shuffle_parts(spark))
    # start: a piece's probability falls with its length, alike in all languages
    first = 8.0 ** -np.fromiter(map(len, pieces), float, len(pieces))
    langs = sorted(edges)
    p = np.repeat((first / first.sum())[:, None], len(langs), axis=1)
    finder = Pieces(pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((finder, p))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder, p = shared.value
            total = np.zeros(p.shape)
            for b in batches:
                lang, word, n = b.column("lang").to_numpy(zero_copy_only=False), b.column("word").to_pylist(), b.column("n").to_numpy()
                for k, name in enumerate(langs):
                    at = np.flatnonzero(lang == name)
                    total[:, k] += Unigrams(finder, p[:, k : k + 1]).expected([word[i] for i in at], n[at])[:, 0]
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], ["piece", "k", "e"])

        got = counted.mapInArrow(expect, "piece long, k long, e double").groupBy("piece", "k").agg(F.sum("e").alias("e")).toArrow()
        p = np.full(p.shape, SMOOTH)
        p[got.column("piece").to_numpy(), got.column("k").to_numpy()] += got.column("e").to_numpy()
        p /= p.sum(axis=0)
        shared.unpersist()
    return Model(langs, finder, p)


def identify(docs: DataFrame, model: Model, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, then the predicted language and its posterior, in columns named by `into`."""
    names = model.langs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigrams = Unigrams(shared.value.pieces, shared.value.p)
        row_of: dict[str, int] = {}
        table_ = np.zeros((CACHE, max(1, len(names))))

        def totals(parts: list[list[str]]) -> np.ndarray:
            """Per list of words, the sum of their scores; words that are not in the table yet are scored first."""
            fresh = list({w for part in parts for w in part if w not in row_of})
            if len(row_of) + len(fresh) > CACHE:
                row_of.clear()
                fresh = list({w for part in parts for w in part})
            base = len(row_of)
            row_of.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            table_[base : base + len(fresh)] = unigrams.log_probabilities(fresh)
            return np.array([table_[[row_of[w] for w in part]].sum(axis=0) for part in parts])

        for b in (part for batch in batches for part in in_slices(batch, most=TEXT_BYTES)):
            found = [words(t.as_py()) if names else [] for t in b.column("text")]
            pieces_, owner = [], []
            for i, w in enumerate(found):
                for a in range(0, len(w), WORDS_AT_ONCE):
                    pieces_.append(w[a : a + WORDS_AT_ONCE])
                    owner.append(i)
            total, at = np.zeros((b.num_rows, max(1, len(names)))), 0
            while at < len(pieces_):  # as many lists at once as make a pass
                end, held = at, 0
                while end < len(pieces_) and (held == 0 or held + len(pieces_[end]) <= WORDS_AT_ONCE):
                    held += len(pieces_[end])
                    end += 1
                np.add.at(total, owner[at:end], totals(pieces_[at:end]))
                at = end
            best = total.argmax(axis=1)
            share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
            pred = [names[k] if w else UND for k, w in zip(best.tolist(), found, strict=True)]
            score = [x if w else 0.0 for x, w in zip(share.tolist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, *into]
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, `{into[0]}` string, `{into[1]}` double")


def held_out(mod: int, rest: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    import public_tokenizers

    pieces = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return train(docs.select("doc_id", "text", "lang").where(~held_out(4, 2)), pieces)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
