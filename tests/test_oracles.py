"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from quarrylog.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(r[k], 9) if isinstance(r[k], float) and math.isfinite(r[k]) else r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    mine = rows(df.columns, [tuple(r) for r in df.collect()]) if name in ORACLES else df.count()
    if name in ORACLES:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        cur = con.execute(ORACLES[name])
        theirs = rows([c[0] for c in cur.description], cur.fetchall())
        assert sorted(df.columns) == sorted(c[0] for c in cur.description)
        assert list(map(repr, mine)) == list(map(repr, theirs))
    else:
        assert mine > 0
