"""Pages decoded where the rows are many more than the files' sizes tell."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colscan import catalogue
from colscan.sources import decode


@pytest.fixture
def table(tmp_path):
    """Two files of several row groups and pages; pages of the two columns end at different rows."""
    wide = [None if i % 7 == 0 or i < 900 else f"text {i}" * 9 for i in range(6000)]
    t = pa.table({"k": pa.array(range(6000), pa.int64()), "v": wide, "l": [[i] * (i % 3) for i in range(6000)]})
    for n, part in enumerate((t.slice(0, 3500), t.slice(3500))):
        pq.write_table(part, f"{tmp_path}/{n}.parquet", row_group_size=1300, data_page_size=2048, write_batch_size=100, use_dictionary=False)
    return str(tmp_path), t


def test_columns_side_by_side(spark, table):
    path, t = table
    df = decode.columns_by_pages(spark, path, {"k": "INT64", "v": "BYTE_ARRAY"})
    assert sorted((r.k, r.v and bytes(r.v).decode()) for r in df.collect()) == list(zip(t["k"].to_pylist(), t["v"].to_pylist(), strict=True))
    with pytest.raises(Exception, match="lists among"):
        decode.columns_by_pages(spark, path, {"l.list.element": "INT64"}).collect()


def test_rows_entries_and_pages(spark, table):
    path, t = table
    rows = decode.column_by_pages(spark, path, "l.list.element", "INT64").collect()
    for name, begin, end in (("0.parquet", 0, 3500), ("1.parquet", 3500, 6000)):
        mine = sorted((r.entry, r.row, r.rep, r.value) for r in rows if r.file.endswith(name))
        want = [(i - begin, min(j, 1), i if i % 3 else None) for i in range(begin, end) for j in range(max(1, i % 3))]
        assert mine == [(n, *w) for n, w in enumerate(want)]
        assert len({r.page for r in rows if r.file.endswith(name) and r.row_group == 0}) > 1
        assert {r.row // 1300 - r.row_group for r in rows if r.file.endswith(name)} == {0}


def test_entries_are_not_broadcast(spark, table):
    path, _ = table
    k = decode.column_by_pages(spark, path, "k", "INT64").select("file", "row", "value")
    v = decode.column_by_pages(spark, path, "v", "BYTE_ARRAY").groupBy("file", "row").count()
    assert "BroadcastHashJoin" not in k.join(v, ["file", "row"])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pages_bool_snappy_v1_dictionary", "pages_string_gzip_v2_dictionary"])
def test_paged_queries_join_nothing(spark, name):
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_page_index_by_page(spark, tmp_path):
    """Each page is looked up by its place, not by a scan of all pages for each row; keys may be negative or missing."""
    keys = [None if i % 5 == 0 or i < 600 else i % 91 - 45 for i in range(1700)]
    pq.write_table(pa.table({"o_orderkey": pa.array(range(1700), pa.int64()), "o_custkey": pa.array(keys, pa.int64())}), f"{tmp_path}/orders.parquet")
    df = catalogue.queries()["page_index_facts"](spark, str(tmp_path))
    assert df.collect() == [(1700, 0, True)]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
