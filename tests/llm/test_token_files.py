"""Token files: ids as the library gives them, grammars that expand to what they were made from, and files read back."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import token_files as tf

from .conftest import prose


@pytest.fixture(scope="module")
def coder():
    return tf.WordTokens(tf.public_words())


ODD = [
    "<|endoftext|> a<|startoftext|>B", "İstanbul ǅ ß ſ ŉ K Å", "a b c\x1cd\x85e", "don't THEY'LL 'they 12345 x1y2 ... !?a", "é ñ̃o", "", None, " \n ",
    "日本語 テスト Ünïcödé", "́ ́a", "ΣΑΣ, ΟΔΟΣ. aΣ. a, Σ", "a" * 5000, "<|endof text|>", "\x00 ﻿ a‍b", "a,, b.) c.\td?!x", "É.È, Œuvre", "<|ENDOFTEXT|> <|EndOfText|>",
]


def whole(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tf.public_words()).encode(text or "", add_special_tokens=False).ids, tf.END]


def test_ids_are_the_librarys(coder, monkeypatch):
    texts = [*ODD, prose(3, 500), prose(4, 200).title().replace(" ", ". "), *ODD]
    plain = [t for t in texts if "<|" not in (t or "")]  # also where no text may hold a special token
    for some in (texts, plain):
        ids, sizes = coder.encode(pa.array(some))
        assert np.split(ids, np.cumsum(sizes)[:-1]) and [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole(t) for t in some]
    monkeypatch.setattr(tf, "CACHE", 3)
    assert list(coder.encode(pa.array(texts))[0]) == [i for t in texts for i in whole(t)]
    assert [list(x) for x in coder.encode(pa.array([None, ""]))] == [[tf.END, tf.END], [1, 1]]


@pytest.mark.parametrize("base", [5, 300, 49_408, 100_000])
def test_grammar(base):
    rng = np.random.default_rng(base)
    words = [rng.integers(0, base, rng.integers(1, 9)) for _ in range(50)]
    for ids in (np.concatenate([words[i] for i in rng.integers(0, 50, 3000)]), np.full(4001, base - 1), np.zeros(0, int), np.array([base - 1]), rng.integers(0, base, 5000)):
        g = tf.re_pair(ids, base, least=3, rounds=30)
        assert all(max(r) < base + i for i, r in enumerate(g.rules.tolist()))  # rules refer to earlier ones
        file = io.BytesIO(b"before" + tf.pack(g))
        shard = tf.Shard(file, 6)
        assert np.array_equal(shard.ids(), ids)
        for a in rng.integers(0, len(ids) + 1, 20):
            b = int(rng.integers(a, len(ids) + 1))
            assert np.array_equal(shard.ids(int(a), b), ids[a:b])
    assert len(tf.re_pair(np.full(4096, 1), base, least=3, rounds=30).symbols) < 30  # runs of one id halve again and again


def test_frequent_pairs_go(coder):
    ids = coder.encode(pa.array([prose(1, 20_000)]))[0].astype(np.int64)
    g = tf.re_pair(ids, coder.size, rounds=50)
    assert len(g.symbols) < 0.7 * len(ids)
    pairs = g.symbols[:-1] * (1 << 20) + g.symbols[1:]
    assert np.unique(pairs, return_counts=True)[1].max() < 2 * tf.LEAST  # what is left overlaps itself or came up in the last round


def by_hand(docs):
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect()
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie)):
        ids = whole(r.text)
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_files(spark, edge_docs, tmp_path, small):
    if small:
        edge_docs = edge_docs.where("length(text) < 5000 or text is null")
    path = tmp_path.as_uri()
    tf.write_tokens(edge_docs, tf.public_words(), path, *([97, 8] if small else []))  # small shards end inside documents
    want = by_hand(edge_docs)
    assert sorted(map(tuple, tf.read_tokens(spark, path).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, tf.read_tokens(spark, path, ids=False).collect()), key=lambda r: r[1]) == [r[:4] for r in want]
    names = sorted(p for p in tmp_path.iterdir() if p.suffix == ".ids")
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    flat = [i for r in want for i in r[4]]
    first = 0
    for name in names:  # any range of a file, without reading the rest
        with name.open("rb") as file:
            stored = tf.TokenFile(file, name.stat().st_size)
            n = int(stored.sizes.sum())
            for a, b in ((0, n), (n // 3, n // 2), (n, n)):
                assert stored.ids(a, b).tolist() == flat[first + a : first + b]
        first += n


def test_hot_doc_id_is_dealt_to_several_files(spark):
    rows = [(5, f"text {i}") for i in range(300)] + [(None, f"null {i}") for i in range(300)] + [(i, "x") for i in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    deal, parts = tf.dealer(docs)
    rng = random.Random(1)
    ties = sorted(rng.getrandbits(64) - (1 << 63) for _ in range(400))
    for doc_id in (5, None):
        at = deal(pa.array([doc_id] * 400, pa.int64()), pa.array(ties, pa.int64()))
        assert (np.diff(at) >= 0).all() and at.max() < parts and len(set(at.tolist())) > 1


def test_empty(spark, no_docs, tmp_path):
    tf.write_tokens(no_docs, tf.public_words(), tmp_path.as_uri())
    assert tf.read_tokens(spark, tmp_path.as_uri()).count() == 0


def test_query(spark, sf, sf_docs):
    got = sorted(map(tuple, tf.op11_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert got == [r[:4] for r in by_hand(sf_docs)]
