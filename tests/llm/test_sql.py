"""Queries of the package that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from colscan.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name, size):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/{size}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries()[name](spark, f"/root/testdata/{size}")
    assert sorted(df.columns) == sorted(columns)
    rows = want.fetchall()
    assert rows and sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(rows, key=str)
