from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import byte_bpe, mixing
from paperloom.llm.common import words_of

from .conftest import prose
from .test_operators import brute_join


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_edges_and_nothing(spark, sf, edge_docs, no_docs, name, stage):
    out = stage(spark, edge_docs, sf)
    assert stage(spark, no_docs, sf).count() == 0
    if name == "byte_bpe":
        assert out.count() == edge_docs.count()
        return
    assert out.columns == edge_docs.columns and out.dtypes == edge_docs.dtypes
    left = {r.doc_id for r in out.select("doc_id").collect()}
    everyone = {r.doc_id for r in edge_docs.select("doc_id").collect()}
    if name == "language_id":
        assert left == everyone - {1, 2, 3, 4}
    elif name == "exact_dedup":
        assert left == everyone - {2, 6, 7, 13} and out.count() == len(left)
    elif name == "ngram_join":
        assert left == everyone - {6, 7, 8, 9, 13}
    else:
        assert left <= everyone


def test_stages_keep_clean_documents(spark, sf, sf_docs):
    """On the driver's rows: nothing is rejected by language; each stage keeps one of each group by brute force."""
    docs = corpus_pipeline.language_id(spark, sf_docs, sf)
    assert docs.count() == sf_docs.count()
    exact = corpus_pipeline.exact_dedup(spark, docs, sf)
    norm = F.regexp_replace(F.col("text"), r"[\x20\x09-\x0D]+", " ")
    want = docs.groupBy(norm.alias("t")).agg(F.min("doc_id").alias("d"))
    assert {r.doc_id for r in exact.select("doc_id").collect()} == {r.d for r in want.collect()}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_exact_dedup_tells_rows_apart_by_text(spark, sf):
    rows = [(3, "a b", "en", "s", 1), (3, "c d", "en", "s", 1), (2, "a  b", "en", "s", 1), (None, "c\nd", "en", "s", 1), (None, "x", "en", "t", 2), (None, "x", "en", "s", 1), (4, "y", "fr", "s", 1), (4, "y", "en", "s", 1)]
    got = corpus_pipeline.exact_dedup(spark, spark.createDataFrame(rows, DOCS).repartition(3), sf).collect()
    assert Counter(map(tuple, got)) == Counter([rows[1], rows[2], rows[5], rows[7]])


def test_ngram_join_by_brute_force(spark, sf):
    """One row of each group stays, and every text that is linked with no other, also under a shared doc_id or none."""
    base = prose(1, 60).split()
    rows = [(i, " ".join([*base[:55], f"w{i}", *base[55:]]), "en", "s", i) for i in (9, 4, 7)]
    rows += [(4, prose(2, 50), "en", "s", 0), (None, prose(2, 50) + " x", "en", "s", 0), (None, prose(3, 50), "en", "s", 0), (11, None, "en", "s", 0), (12, "", "en", "s", 0), (5, prose(5, 50), "de", "s", 0), (5, prose(5, 50), "de", "s", 0)]
    got = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, DOCS).repartition(3), sf).collect()
    assert Counter(map(tuple, got)) == Counter(rows[i] for i in (1, 3, 5, 6, 7, 8))


def test_ngram_join_on_the_drivers_rows(spark, sf, sf_docs):
    want = {c for _, _, c in brute_join([(r.doc_id, r.text) for r in sf_docs.collect()])}
    got = [r.doc_id for r in corpus_pipeline.ngram_join(spark, sf_docs, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_mixing_by_brute_force(spark, sf, sf_docs):
    """Every row comes out as often as a plain version of the draw has it, and the sources' words near their targets."""
    extra = [(1, "other text under id one", "en", None, 1), (None, "no id here", "en", None, 1), (None, "no id here", "en", None, 1), (7, None, "en", None, 1)]
    docs = sf_docs.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).unionAll(spark.createDataFrame(extra, DOCS))
    got = Counter(map(tuple, corpus_pipeline.mixing(spark, docs.repartition(5), sf).collect()))
    key = F.concat_ws(":", F.xxhash64(*docs.columns).cast("string"), F.xxhash64(F.lit(1), *docs.columns).cast("string"))
    rows = docs.select("*", key.alias("k"), F.pmod(F.xxhash64(key), F.lit(mixing.BUCKETS)).alias("b"), F.size(words_of(F.col("text"))).alias("w")).collect()
    size = Counter()
    for r in rows:
        size[r.source] += r.w
    goal, want = mixing.targets(size), Counter()
    names = sorted(s for s in size if s is not None) + [None]
    for i, s in enumerate(names):
        mine = [r for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.b, r.k, r.w)) if r.w]
        n, quota, words = len(mine), round(goal[s] * len([r for r in mine]) / size[s]), 0
        for turn in range(2):
            place = turn * n + mixing.permute(np.arange(n), n, mixing.SEED + 7919 * i + turn)
            for r, p in zip(mine, place.tolist(), strict=True):
                if p < quota:
                    want[tuple(r)[:5]] += 1
                    words += r.w
        assert sum(v for r, v in want.items() if r[3] == s) == quota
    assert got == want and max(got.values()) <= 4


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).cache()
    assert out.count() > 0
    back = byte_bpe.decode_documents(out.select("doc_id", "token_ids"), byte_bpe.public_vocabulary()[0]).distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    assert back.join(docs, "doc_id").where("text_bytes <> raw").count() == 0
