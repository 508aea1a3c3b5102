"""Queries with SQL give DuckDB's rows."""

import duckdb
import pytest

from quarrylog.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for view in ("documents", "labels"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    columns = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(theirs)
