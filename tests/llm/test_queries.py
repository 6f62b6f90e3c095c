"""The SQL of the text queries against the queries, on the smallest tables."""

import os

import duckdb
import pytest

from ledgerline.llm import queries

DATA = os.environ.get("LEDGERLINE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
    assert rows or name == "op13_collocations"  # few words are frequent there
