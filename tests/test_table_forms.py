"""Tables that are one file and tables that are folders of files give the same streams; scores are rounded as SQL rounds them."""

import os
import shutil

import pyarrow.parquet as pq
import pytest

from paperloom.operators import evaluate
from paperloom.plans import retrieval_queries

from .conftest import TABLES, rows_of


@pytest.mark.parametrize("name", ["l2_stream_chunks", "l2_stream_tokens", "l1_first_seen_state"])
def test_streams_of_a_table_in_a_folder(name, spark, sf, duck, tmp_path):
    for t in TABLES.split():
        rows = pq.read_table(f"{sf}/{t}.parquet")
        if t in ("documents", "events"):
            os.mkdir(tmp_path / f"{t}.parquet")
            for i in range(2):
                pq.write_table(rows.slice(i * 77, 77 if i == 0 else None), tmp_path / f"{t}.parquet" / f"part-{i:04}.parquet")
        else:
            shutil.copy(f"{sf}/{t}.parquet", tmp_path)
    got = retrieval_queries.Q[name](spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(duck.sql(retrieval_queries.SQL[name]).df())


def test_top_results_round_as_sql(spark, duck):
    scores = [102.68775, 0.00145, 0.00465, 12.34565, 7.5]
    hits = spark.createDataFrame([(1, str(i), s, i) for i, s in enumerate(scores)], "query_id long, paper_id string, score double, rank int")
    papers = spark.createDataFrame([("0", "t")], "paper_id string, title string")
    got = [x.score for x in evaluate.top_results(hits, papers).first().top_results]
    assert got == [duck.sql(f"select round({s}::double, 4)").fetchall()[0][0] for s in scores]


def test_every_turn_is_judged(spark, sf, duck):
    """No answer is left out for its length or number, so each conversation has contexts."""
    got = {r.query_id for r in retrieval_queries.Q["j10_judge_contexts"](spark, sf).select("query_id").distinct().collect()}
    assert got == {r[0] for r in duck.sql("select distinct conv_id from conversations").fetchall()}


def test_judged_answers(spark):
    rows = [(1, "x" * 100, ["p"]), (2, " " + "x" * 99 + " ", ["p"]), (3, "x" * 100, []), (4, None, ["p"]), (5, "x" * 200, None)]
    d = spark.createDataFrame(rows, "query_id long, answer string, citations array<string>")
    assert [r.query_id for r in evaluate.judged_answers(d).collect()] == [1]
