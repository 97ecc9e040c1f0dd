"""Every query with SQL against DuckDB on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from colscan import catalogue

SIZES = ("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def duck():
    out = {}
    for size in SIZES:
        out[size] = con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for f in glob.glob(f"/root/testdata/{size}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return out


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{v:.9g}" if type(v).__name__ == "Decimal" and v % 1 else str(int(v)) if type(v).__name__ == "Decimal" else str(v)


#: Queries that write files first are many and alike; the smaller size is enough for them.
CASES = [(n, s) for n in sorted(catalogue.oracle_sql()) for s in SIZES if s == SIZES[0] or not n.startswith(("pages_", "writer_"))]


@pytest.mark.parametrize(("name", "size"), CASES)
def test_query(spark, duck, name, size):
    df = catalogue.queries()[name](spark, f"/root/testdata/{size}")
    want = duck[size].execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_all_have_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
