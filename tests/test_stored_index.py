"""The stored BM25 index: loads and withdrawals equal a rebuild, pruned search equals the whole one and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.index import bm25_index, bm25_search
from paperloom.operators.stored_index import StoredIndex

QUERIES = [(1, "w1 w40 w41"), (2, "w3 w3 w90"), (3, "nothing here"), (4, ""), (5, "w0 w1 w2 w150 w151 w152")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.6)), 199)}" for _ in range(rng.randrange(1, 60)))) for i in range(600)]
    rows += [(600, ""), (601, None), (None, "w1 w2"), (602, "w1 " * 50), (602, "w1 " * 50)]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def rows(d):
    return sorted(tuple(r) for r in d.collect())


def expected(docs, asked, k=10):
    once = docs.where("id is not null").groupBy("id").agg(F.min("text").alias("text")).withColumn("text", F.coalesce("text", F.lit("")))
    ix = bm25_index(once, "id", F.col("text"))
    return rows(ix["df"].select("term", "df", F.round("idf", 6))), rows(bm25_search(ix, asked, k))


def check(ix, docs, asked):
    terms, found = expected(docs, asked)
    assert rows(ix.terms().select("term", "df", F.round("idf", 6))) == terms
    assert rows(ix.search(asked, 10)) == found
    pruned, counts = ix.pruned(asked, 10)
    assert rows(pruned) == found
    assert all(r.postings_read <= r.postings for r in counts.collect())
    return counts


def test_loads_withdrawals_and_compaction_equal_a_rebuild(spark, docs, asked, tmp_path):
    ix = StoredIndex(spark, f"{tmp_path.as_uri()}/ix", buckets=3)
    ix.load(docs.where("id % 2 = 0 or id is null"), "id", F.col("text"))
    check(ix, docs.where("id % 2 = 0"), asked)
    ix.load(docs, "id", F.col("text"))  # only what is new
    check(ix, docs, asked)
    ix.withdraw(docs.where("id % 3 = 0").select("id").union(spark.createDataFrame([(99_999,)], "id long")))
    check(ix, docs.where("id % 3 <> 0"), asked)
    changed = docs.where("id % 6 = 0").withColumn("text", F.concat_ws(" ", "text", F.lit("w5 new")))
    ix.load(changed, "id", F.col("text"))  # back with other words
    now = docs.where("id % 3 <> 0").unionByName(changed)
    check(ix, now, asked)
    ix.load(docs.limit(0), "id", F.col("text"))
    check(ix, now, asked)
    ix.compact()
    assert len(ix.commits()) == 1
    check(StoredIndex(spark, ix.path), now, asked)


def test_a_load_that_stopped_counts_for_nothing(spark, docs, asked, tmp_path):
    ix = StoredIndex(spark, f"{tmp_path.as_uri()}/ix", buckets=2)
    ix.load(docs.where("id < 300"), "id", F.col("text"))
    ix._commit = lambda row: None
    ix.load(docs, "id", F.col("text"))
    again = StoredIndex(spark, ix.path)
    check(again, docs.where("id < 300"), asked)
    again.load(docs, "id", F.col("text"))
    check(again, docs, asked)


def test_pruned_search_reads_less(spark, tmp_path):
    """Rare words decide: blocks without them cannot reach the best rows."""
    rng = random.Random(4)
    data = [(i, " ".join(["common"] * rng.randrange(1, 4) + [f"x{rng.randrange(500)}" for _ in range(20)]) + (" rare rare" if i % 200 == 7 else "")) for i in range(4000)]
    ix = StoredIndex(spark, f"{tmp_path.as_uri()}/ix", buckets=2)
    ix.load(spark.createDataFrame(data, "id long, text string"), "id", F.col("text"))
    q = spark.createDataFrame([(1, "common rare")], "query_id int, query string")
    pruned, counts = ix.pruned(q, 5)
    assert rows(pruned) == rows(ix.search(q, 5)) and pruned.count() == 5
    one = counts.first()
    assert one.postings == 4020 and one.postings_read < one.postings / 4


def test_empty(spark, docs, asked, tmp_path):
    ix = StoredIndex(spark, f"{tmp_path.as_uri()}/ix")
    ix.withdraw(docs.select("id"))
    assert not ix.commits() and ix.papers() is None
    ix.load(docs.limit(0), "id", F.col("text"))
    assert ix.terms().count() == 0 and ix.search(asked, 3).count() == 0 and ix.pruned(asked, 3)[0].count() == 0
