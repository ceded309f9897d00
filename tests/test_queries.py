"""Every query with SQL equals DuckDB on the smallest tables; the others give rows."""

import pytest

from paperloom.plans import corpus_queries, retrieval_queries

from .conftest import rows_of

QUERIES = corpus_queries.Q | retrieval_queries.Q
SQL = corpus_queries.SQL | retrieval_queries.SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(duck.sql(SQL[name]).df())
    else:
        assert len(got.columns)
