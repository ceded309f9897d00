"""Toxic spans by a linear-chain conditional random field over tokens.

Token labels come from the labelled documents: in a toxic document, tokens one of whose features (the word or its
first letters) occurs in toxic documents at least LIFT times as often as in clean ones are marked. A two-state
chain is trained on them: hashed features of the token give the emissions, four weights the transitions.
Forward-backward marginals give each token's probability; their sum and maximum give the document's score by
a small logistic fit, and runs of tokens above one half are the offending offsets.

Training rests on a bounded sample (at most TOXIC_DOCS and CLEAN_DOCS labelled documents, those with the
smallest hash). Each round sums the tasks' gradients. Scoring is one map over all whole texts. A document is one chain
of any length. For numpy it is laid out in slices of SLICE tokens side by side; each slice's product of
transfer matrices hands the forward and backward messages on to its neighbours, so no cut shows in the marginals.

Defined results: null and empty texts have no tokens and get the score of zero evidence; without labels of both
kinds every score is 0; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of, written
from .language_id import held_out

TOKEN = re.compile(r"[^\W\d_]+")
SLICE = 64
DIM = 1 << 17
TOXIC_DOCS, CLEAN_DOCS = 2000, 3000
#: A telling feature is in so many toxic documents, and in such a share of them, and so many times likelier there.
LEAST, SHARE, LIFT = 3, 0.01, 20.0
ROUNDS, STEP, RIDGE = 8, 1.0, 1e-3
SAMPLE_PARTS = 6
CACHE = 400_000
BIAS = 0


def features(word: str) -> tuple[str, ...]:
    """The word, its first four and five letters and its last three."""
    return ("w" + word, *(f"p{word[:n]}" for n in (4, 5) if len(word) > n), *(("s" + word[-3:],) if len(word) > 3 else ()))


def hashed(word: str) -> list[int]:
    ids = [1 + crc32(f.encode()) % (DIM - 1) for f in features(word)]
    return [BIAS, *ids, *[-1] * (4 - len(ids))]


class Chain:
    """Two states, 0 clean and 1 toxic; only ratios of state 1 to state 0 are carried along."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray) -> None:
        self.weights, self.transitions = weights, transitions

    def emission(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, self.weights[np.maximum(ids, 0)], 0.0).sum(axis=-1)

    def marginals(self, emission: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of `sizes` tokens laid end to end: P(state 1) of each token, and the forward and backward ratios."""
        if not len(emission):
            return emission, emission, emission
        t = np.exp(self.transitions)
        start, length, turn = slices(sizes)
        at = np.minimum(start + np.arange(SLICE)[:, None], len(emission) - 1)
        mask = np.arange(SLICE)[:, None] < length
        g = np.where(mask, np.exp(np.clip(emission, -30, 30))[at], 1.0)
        # the first token of a document comes from no state: all its transitions weigh alike
        first = turn == 0
        ahead_t = [np.where(first, 1.0, t[i, j]) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
        a, b, c, d = np.ones(len(start)), np.zeros(len(start)), np.zeros(len(start)), np.ones(len(start))
        for k in range(SLICE):  # products of the slices' transfer matrices, scaled
            if not mask[k].any():
                break
            t00, t01, t10, t11 = ahead_t if k == 0 else (t[0, 0], t[0, 1], t[1, 0], t[1, 1])
            new = (a * t00 + b * t10, (a * t01 + b * t11) * g[k], c * t00 + d * t10, (c * t01 + d * t11) * g[k])
            scale = np.maximum(np.maximum(new[0], new[1]), np.maximum(new[2], new[3]))
            a, b, c, d = (np.where(mask[k], x / scale, old) for x, old in zip(new, (a, b, c, d), strict=True))
        into, last = np.ones(len(start)), np.ones(len(start))
        by_turn = np.argsort(turn, kind="stable")
        edges = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
        for j in range(1, turn.max() + 1):
            here = by_turn[edges[j] : edges[j + 1]]
            before = here - 1
            into[here] = (b[before] + into[before] * d[before]) / (a[before] + into[before] * c[before])
        for j in range(turn.max(), 0, -1):
            here = by_turn[edges[j] : edges[j + 1]]
            last[here - 1] = (c[here] + d[here] * last[here]) / (a[here] + b[here] * last[here])
        ahead, behind, r, back = np.empty_like(g), np.empty_like(g), into, last
        for k in range(SLICE):
            t00, t01, t10, t11 = ahead_t if k == 0 else (t[0, 0], t[0, 1], t[1, 0], t[1, 1])
            r = ahead[k] = g[k] * (t01 + r * t11) / (t00 + r * t10)
        behind[SLICE - 1] = last
        for k in range(SLICE - 2, -1, -1):
            x = g[k + 1] * back
            back = behind[k] = np.where(k + 1 < length, (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), last)
        flat = lambda x: x.T[mask.T]  # noqa: E731  # in the order of the tokens
        ahead, behind = flat(ahead), flat(behind)
        odds = ahead * behind
        return odds / (1 + odds), ahead, behind


def slices(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of `sizes` tokens laid end to end: each slice's start, length and number in its document."""
    n = -(-sizes // SLICE)
    base = np.repeat(np.cumsum(sizes) - sizes, n)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = base + turn * SLICE
    return start, np.minimum(start + SLICE, np.repeat(np.cumsum(sizes), n)) - start, turn


def gradient(model: Chain, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, by weight and by transition."""
    e = model.emission(ids)
    p, ahead, behind = model.marginals(e, sizes)
    rest = labels - p
    ok = ids >= 0
    by_weight = np.bincount(ids[ok], weights=np.broadcast_to(rest[:, None], ids.shape)[ok], minlength=len(model.weights))
    inner = np.ones(len(e), bool)  # tokens with a next one in their document
    inner[np.cumsum(sizes[sizes > 0]) - 1] = False
    here = np.flatnonzero(inner)
    t = np.exp(model.transitions)
    x = np.exp(np.clip(e[here + 1], -30, 30)) * behind[here + 1]
    a, y, z = ahead[here], labels[here], labels[here + 1]
    cell = {(0, 0): t[0, 0] + 0 * a, (0, 1): t[0, 1] * x, (1, 0): a * t[1, 0], (1, 1): a * t[1, 1] * x}
    total = sum(cell.values())
    by_step = np.zeros((2, 2))
    for (i, j), v in cell.items():
        by_step[i, j] = ((y == i) & (z == j)).sum() - (v / total).sum()
    return by_weight, by_step


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of the bounded sample and how many labelled documents each sampled one stands for."""
    lab = labels.where("toxic is not null").where(~held_out(5, 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("k"))
    counts = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep, stands = None, {}
    for y, most in ((1, TOXIC_DOCS), (0, CLEAN_DOCS)):
        n = counts.get(y, 0)
        share = min(1.0, most / n) if n else 0.0
        stands[y] = 1 / share if share else 0.0
        c = (F.col("toxic") == y) & (F.col("k") <= -(2**63) + int(2**64 * share) - 1) if share else F.lit(False)
        keep = c if keep is None else keep | c
    # the sample's bound is the bound of this broadcast: it spares a shuffle of all texts
    found = docs.select("doc_id", "text").join(F.broadcast(lab.where(keep).select("doc_id", "toxic")), "doc_id")
    # one of each family of near copies (equal smallest 3-word hash): a family's own words would look telling
    w = words_of(F.col("text"))
    hashes = F.transform(F.array(w), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.xxhash64(x[i], x[i + 1], x[i + 2])))[0]
    family = F.when(F.size(w) >= 3, F.array_min(hashes)).otherwise(F.xxhash64("text"))
    return found.groupBy("toxic", family.alias("family")).agg(F.min("text").alias("text")).select("text", "toxic"), stands


def _telling(sample: DataFrame) -> set[str]:
    """Features (words and beginnings) that mark toxic documents."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for f in {f for w in {x.lower() for x in TOKEN.findall(text or "")} for f in features(w) if f[0] != "s"}:
                    counts.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_pydict({"f": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})

    sums = sample.mapInArrow(distinct, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    told = (F.col("toxic") >= max(LEAST, SHARE * n.get(1, 0))) & (F.col("toxic") / n.get(1, 1) > LIFT * (F.col("clean") + 0.5) / max(n.get(0, 1), 1))
    return {r["f"] for r in sums.where(told).select("f").collect()}


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """weights, transitions and the document fit; None without labels of both kinds."""
    spark = docs.sparkSession
    sample, stands = _sample(docs, labels)
    if not (stands[0] and stands[1]):
        return None
    sample = written(sample.repartition(SAMPLE_PARTS), "toxic").repartition(SAMPLE_PARTS)
    telling = _telling(sample)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], bool]] = {}
        for b in batches:
            ids, marks, ys = [], [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                row, mark = [], []
                for w in TOKEN.findall(text or ""):
                    if w not in known:
                        known[w] = hashed(w.lower()), any(f in telling for f in features(w.lower()))
                    row += known[w][0]
                    mark.append(int(y and known[w][1]))
                ids.append(row)
                marks.append(mark)
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int32())), pa.array(ys, pa.int32())], ["ids", "marks", "toxic"])

    data = written(sample.mapInArrow(sequences, "ids array<int>, marks array<int>, toxic int"), "toxic").coalesce(SAMPLE_PARTS)
    weights, steps = np.zeros(DIM), np.zeros((2, 2))
    weights[BIAS] = -5.0
    seen_w, seen_s = np.zeros(DIM), np.zeros((2, 2))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, steps))

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model, gw, gs = Chain(*shared.value), np.zeros(DIM), np.zeros((2, 2))
            for b in batches:
                ids, marks = b.column("ids"), b.column("marks")
                sizes = np.diff(marks.offsets.to_numpy())
                if sizes.sum():
                    a, c = gradient(model, ids.flatten().to_numpy().reshape(-1, 5).astype(np.int64), marks.flatten().to_numpy(), sizes.astype(np.int64))
                    gw += a
                    gs += c
            at = np.flatnonzero(gw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([at, DIM + np.arange(4)]).astype(np.int64)), pa.array(np.concatenate([gw[at], gs.ravel()]))], ["i", "g"]
            )

        got = data.mapInArrow(partial, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
        shared.unpersist()
        flat = np.zeros(DIM + 4)
        flat[got.column("i").to_numpy()] = got.column("g").to_numpy()
        gw, gs = flat[:DIM] - RIDGE * weights, flat[DIM:].reshape(2, 2)
        seen_w += gw**2
        seen_s += gs**2
        weights = weights + STEP * gw / np.sqrt(seen_w + 1e-6)
        steps = steps + 0.2 * STEP * gs / np.sqrt(seen_s + 1e-6)
    model = {"weights": weights, "transitions": steps, "fit": np.array([-4.0, 1.0, 4.0])}
    evidence = score(sample.select("text", "toxic"), model, names=("toxic",)).select("toxic", "mass", "peak").toArrow()
    x = _evidence(evidence.column("mass").to_numpy(), evidence.column("peak").to_numpy())
    y = evidence.column("toxic").to_numpy().astype(float)
    model["fit"] = _logistic(x, y, np.where(y == 1, stands[1], stands[0]))
    return model


def _evidence(mass: np.ndarray, peak: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(mass), np.log1p(mass), peak], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge-damped Newton steps; the sample is bounded, so this runs on the driver."""
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(b))
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - b), -2, 2)
    return b


def score(docs: DataFrame, model: dict, names: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The named columns, then mass and peak of the marginals, the document's score, n_spans and, if asked for, spans
    array<struct<start, end>> in characters of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        crf, fit = Chain(m["weights"], m["transitions"]), m["fit"]
        row_of: dict[str, int] = {}
        known = np.zeros(CACHE)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                tokens, start = [], at
                while at < whole.num_rows and at - start < 256 and sum(map(len, tokens[-1:])) < 50_000:
                    tokens.append(TOKEN.findall(whole.column("text")[at].as_py() or ""))
                    at += 1
                part = whole.slice(start, at - start)
                sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
                fresh = [w for w in set(chain.from_iterable(tokens)) if w not in row_of]
                if len(row_of) + len(fresh) > CACHE:
                    row_of.clear()
                    fresh = list(set(chain.from_iterable(tokens)))
                if len(fresh) > CACHE:
                    flat = crf.emission(np.array([hashed(w.lower()) for w in chain.from_iterable(tokens)]))
                else:
                    if fresh:
                        base = len(row_of)
                        row_of.update(zip(fresh, range(base, base + len(fresh)), strict=True))
                        known[base : base + len(fresh)] = crf.emission(np.array([hashed(w.lower()) for w in fresh]))
                    flat = known[np.fromiter(map(row_of.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))]
                p = crf.marginals(flat, sizes)[0]
                ends = np.cumsum(sizes)
                mass, peak, found = np.zeros(len(sizes)), np.zeros(len(sizes)), []
                if len(p):
                    full = sizes > 0
                    mass[full] = np.add.reduceat(p, (ends - sizes)[full])
                    peak[full] = np.maximum.reduceat(p, (ends - sizes)[full])
                for i in range(len(sizes)):
                    found.append(_runs(part.column("text")[i].as_py(), p[ends[i] - sizes[i] : ends[i]]) if peak[i] >= 0.5 else [])
                value = 1 / (1 + np.exp(-np.clip(_evidence(mass, peak) @ fit, -30, 30)))
                out = [*(part.column(n) for n in names), pa.array(mass), pa.array(peak), pa.array(value), pa.array([len(f) for f in found], pa.int32())]
                if spans:
                    out.append(pa.array([[{"start": a, "end": b} for a, b in f] for f in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(out, [*names, "mass", "peak", "score", "n_spans", *["spans"] * spans])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", mass double, peak double, score double, n_spans int" + ", spans array<struct<start:int,end:int>>" * spans
    return docs.select(*dict.fromkeys((*names, "text"))).mapInArrow(run, schema)


def _runs(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets of runs of tokens above one half."""
    out: list[tuple[int, int]] = []
    joined = False
    for token, hit in zip(TOKEN.finditer(text), p >= 0.5, strict=True):
        if hit:
            if joined:
                out[-1] = (out[-1][0], token.end())
            else:
                out.append(token.span())
        joined = bool(hit)
    return out


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("n_spans"))
    return score(docs, model)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans")
