"""Queries against their SQL, over the smallest tables."""

import duckdb
import pytest

from amplispark import catalog, catalog_outputs

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.QUERIES | catalog_outputs.QUERIES, catalog.ORACLE_SQL | catalog_outputs.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(columns).collect())
    want = con.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({SQL[name]})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)
