"""Rounds that go on where a run stopped, and checks that are counted on the way to the table."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import answers, quality


def test_rounds_go_on_without_searching_again(spark, tmp_path):
    asked = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "query_id long, query string")
    calls = []

    def search(q, i):
        calls.append((i, sorted(r.query for r in q.collect())))
        return q.select("query_id", F.concat(F.lit(f"r{i}-"), "query").alias("id"), (F.col("query_id") / 10 + i).alias("rrf"))

    judge = lambda r: r.groupBy("query_id").agg((F.max("rrf") > 0.25).alias("ok"))
    more = lambda q: q.withColumn("query", F.concat("query", F.lit("+")))
    want = [sorted(map(tuple, d.collect())) for d in answers.iterate(asked, search, judge, more, 3)]

    def stops_at(n):
        def f(q, i):
            if i == n:
                raise KeyboardInterrupt
            return search(q, i)

        return f

    for n in (1, 2):
        path = (tmp_path / str(n)).as_uri()
        rounds = answers.Rounds(spark, path)
        if n == 1:
            with pytest.raises(KeyboardInterrupt):
                rounds.run(asked, stops_at(n), judge, more, 3)
        calls.clear()
        got = [sorted(map(tuple, d.collect())) for d in answers.Rounds(spark, path).run(asked, search, judge, more, 3)]
        assert got == want
        assert [i for i, _ in calls] == ([1] if n == 1 else [0, 1])
        calls.clear()
        again = answers.Rounds(spark, path).run(asked, search, judge, more, 3)
        assert [sorted(map(tuple, d.collect())) for d in again] == want and not calls


def test_checks_are_counted_while_written(spark, tmp_path):
    rows = [("p::1", "p", "parent", "x" * 60, "T", "S", "2020", None), ("p::2", "p", "child", "", None, "S", "x", "p::1"), ("p::2", "p", "child", "short", "T", " ", "2020", "p::9"), (None, "p", "child", "##### 12345 " * 9, "T", "S", "1999", "")]
    seen = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, chunk_type string, text string, title string, section string, year string, parent_chunk_id string")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = quality.write_validated(chunks.mapInArrow(counted, chunks.schema), str(tmp_path / "chunks"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.validate(chunks).collect()))
    assert seen.value == len(rows)  # computed once
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 4
