"""Filters and dictionaries of columns with more different values than one filter or first page takes."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from colscan import catalogue
from colscan.sources import blooms
from colscan.sources.writer import WriteOptions, write


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Each of 60,000 customers twice, far from each other, and one order without."""
    path = str(tmp_path_factory.mktemp("t"))
    keys = np.concatenate([np.random.default_rng(n).permutation(60_000) for n in (1, 2)]).tolist()
    pq.write_table(pa.table({"o_orderkey": pa.array(range(120_001), pa.int64()), "o_custkey": pa.array([*keys, None], pa.int64())}), f"{path}/orders.parquet")
    return path


def test_bloom_probe(spark, orders):
    rows = catalogue.queries()["bloom_probe"](spark, orders).collect()
    assert len(rows) == 60_001 and {(r.held, r.true_rate) for r in rows} == {(True, True)}


def test_values_are_probed_in_their_own_row_group(spark, tmp_path):
    path = f"{tmp_path}/t"
    write(spark.range(0, 4000, 1, 1), path, WriteOptions(blooms={"id": (1000, 0.01)}, rows_per_group=1000))
    assert blooms.held_by_own(spark, path, "id", "INT64").where("held").count() == 4000
    assert blooms.held_by_chance(spark, path, np.arange(7, dtype=np.uint64)).count() == 4
    write(spark.range(9), f"{path}2")
    assert {r.held for r in blooms.held_by_own(spark, f"{path}2", "id", "INT64").collect()} == {None}


def test_dictionary_of_many_values_is_kept(spark, orders):
    rows = catalogue.queries()["writer_dictionary_and_bloom"](spark, orders)
    assert rows.count() == 120_001
    assert [tuple(r) for r in rows.select("dictionaries", "blooms").distinct().collect()] == [("o_custkey=dictionary o_orderkey=plain", "o_custkey=none o_orderkey=bloom")]
