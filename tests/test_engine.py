"""Byte codecs, writers, footers, adaptive filters and edge cases that SQL does not show."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colscan.functions import codecs, crypto, encodings
from colscan.operators import adaptive, dictionary, masks, ordered, stats
from colscan.sources.scan import footers, scan
from colscan.sources.writer import WriteOptions, write


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 40)), max_size=12))
def test_hybrid_round_trip(runs):
    values = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    data = codecs.hybrid_encode(values, 5)
    assert (codecs.hybrid_decode(data, 5, len(values)) == values).all()


def test_hybrid_of_long_runs_is_short():
    assert len(codecs.hybrid_encode(np.repeat([1, 2, 3], 10_000), 2)) < 20


@pytest.mark.parametrize("kind", ["float", "double", "int32", "int64"])
def test_stream_split_and_plain(kind):
    v = np.arange(17).astype(codecs.TYPES[kind])
    assert (codecs.stream_split_decode(codecs.stream_split_encode(v), kind) == v).all()
    assert (codecs.plain_decode(v.tobytes(), kind) == v).all()
    with pytest.raises(ValueError):
        codecs.plain_decode(v.tobytes()[:-1], kind)


def test_delta_page_of_a_file(tmp_path):
    want = np.r_[np.arange(1000) * 17 - 100, [2**62, -(2**62), 5]]
    path = tmp_path / "t.parquet"
    pq.write_table(pa.table({"v": pa.array(want)}, schema=pa.schema([pa.field("v", pa.int64(), nullable=False)])), path, column_encoding={"v": "DELTA_BINARY_PACKED"}, use_dictionary=False, compression="none", store_schema=False)
    chunk = pq.read_metadata(path).row_group(0).column(0)
    raw = path.read_bytes()[chunk.data_page_offset : chunk.data_page_offset + chunk.total_compressed_size]
    at = raw.index(codecs.varint(len(want)))  # the header has block size, blocks and count
    at -= next(n for n in (3, 4) if codecs.read_varint(raw, at - n)[0] % 128 == 0 and codecs.read_varint(raw, at - n)[0])
    assert (codecs.delta_decode(raw[at:]) == want).all()


def test_bytes_and_bools():
    assert codecs.plain_decode_bytes(b"\x02\0\0\0ab\0\0\0\0") == [b"ab", b""]
    assert codecs.plain_decode_bool(np.packbits([1, 0, 1, 1, 0, 0, 1, 0, 1], bitorder="little").tobytes(), 9).tolist() == [True, False, True, True, False, False, True, False, True]
    assert codecs.plain_decode_fixed(b"abcdef", 3) == [b"abc", b"def"]
    with pytest.raises(ValueError):
        codecs.plain_decode_bytes(b"\x09\0\0\0ab")


@pytest.mark.parametrize("codec", ["snappy", "zstd", "gzip", "brotli", "lz4_raw"])
def test_compression(codec):
    data = b"abc" * 1000
    assert codecs.decompress(codecs.compress(data, codec), codec, len(data)) == data


def test_bloom():
    keys = np.array([codecs.parquet_hash(i * 31 + 7) for i in range(2000)], np.uint64)
    bloom = codecs.BlockBloom(stats.bloom_blocks(2000, 0.01))
    bloom.add(keys)
    assert len(bloom.words) == 128 and bloom.has(keys).all()
    absent = np.array([codecs.parquet_hash(-i - 1) for i in range(2000)], np.uint64)
    assert bloom.has(absent).mean() < 0.05


def test_row_groups_and_footers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write(spark.range(0, 4096).select((F.col("id") * 3 - 7).alias("v"), "id").coalesce(1), path, WriteOptions(codec="zstd", rows_per_group=1024, dictionary={"v": False}))
    rows = footers(spark, path).where("name = 'v'").orderBy("row_group").collect()
    assert [(r.row_group, r.n_rows, r.row_base, r.codec) for r in rows] == [(i, 1024, 1024 * i, "ZSTD") for i in range(4)]
    assert [int(r.lo) for r in rows] == [1024 * 3 * i - 7 for i in range(4)]
    assert {r.id for r in scan(spark, path, ["id"], [1, 3]).collect()} == {*range(1024, 2048), *range(3072, 4096)}


def test_pyarrow_writer(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    write(spark.range(100).withColumn("s", F.lit("x")), path, WriteOptions(codec="snappy", codecs={"s": "brotli"}))
    table = pq.read_table(tmp_path / "t")
    assert sorted(table.column("id").to_pylist()) == list(range(100))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write(spark.range(1), path, WriteOptions(codec="brotli"))


def test_adaptive(spark):
    df, seen = spark.range(65_536).select("id", (F.col("id") % 256).alias("v")), []
    low = adaptive.adaptive_filter(df, "v", lambda c: c < 4, "id", telemetry=seen.append)
    high = adaptive.adaptive_filter(df, "v", lambda c: c < 192, "id", telemetry=seen.append)
    assert [p.dispatch for p in seen] == ["mask", "values"] and seen[0].pages == 3
    assert low.rows.where("mask").count() == low.values().count() == 1024 and high.rows.count() == 49_152
    empty = adaptive.adaptive_filter(df.limit(0), "v", lambda c: c < 4, "id")
    assert empty.probe.selectivity == 0.0 and empty.probe.dispatch == "mask"


def test_ordered_over_many_blocks(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i // 5) for i in range(0, 300, 3)], "k long, v long")
    got = {r.k: r for r in ordered.previous(ordered.row_index(df, "k", span=10), "v", "k", "b", span=10).collect()}
    before = None
    for n, i in enumerate(range(0, 300, 3)):
        assert got[i].row_index == n and got[i].b == before
        before = None if i % 7 == 0 else i // 5


def test_runs_with_nulls(spark):
    df = spark.createDataFrame(list(enumerate([None, None, 1, 1, None, 2])), "k long, v int")
    assert sorted((r.run, r.value, r.n) for r in encodings.runs(df, "v", "k").collect()) == [(1, None, 2), (2, 1, 2), (3, None, 1), (4, 2, 1)]


def test_levels(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 5])], "k long, v array<int>")
    assert sorted((r.k, r.at, r.rep, r["def"], r.value or 0) for r in encodings.levels(df, "v", "k").collect()) == [(1, 0, 0, 0, 0), (2, 0, 0, 1, 0), (3, 0, 0, 2, 0), (3, 1, 1, 3, 5)]


def test_stats_of_nan_and_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (None,), (2.0,)], "v double")
    r = stats.chunk_stats(df, "v").first()
    assert str(r.lo) == "-0.0" and r.hi == 2.0 and r.nulls == 1 and r.n_rows == 4


def test_dictionary_limits(spark):
    df = spark.range(300).select("id", F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError):
        dictionary.encode(df, "v", "id", small=True)
    one = spark.range(5).select("id", F.lit("x").alias("v"))
    assert {r.code for r in dictionary.encode(one, "v", "id").collect()} == {0}
    with pytest.raises(Exception, match="code out of range"):
        dictionary.decode(spark.createDataFrame([(1, 9)], "id long, code long"), dictionary.dictionary(one, "v", "id"), "id", "v").collect()


def test_ranges(spark):
    with pytest.raises(ValueError):
        masks.between(spark.range(3), "id", 2, 1)


def test_modules():
    assert crypto.module_aad(b"p", b"u", "data_page", 1, 2, 3) == b"pu\x02\x01\0\x02\0\x03\0"
    body = bytes(40)
    assert crypto.unframe(crypto.frame(body)) == body
    with pytest.raises(ValueError):
        crypto.unframe(crypto.frame(body)[:-1])
    with pytest.raises(ValueError):
        crypto.check_key(bytes(24))
