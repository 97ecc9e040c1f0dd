"""Metadata, pages, byte codecs, Bloom filters, writers and modules, against files that pyarrow and Spark have written."""

import datetime as dt
import decimal
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colscan.functions import codecs, crypto, encodings, pages, thrift
from colscan.jobs import Cancelled, CancellationToken, ReadOptions, read_columns
from colscan.operators import adaptive, masks, ordered, stats
from colscan.sources import encrypted, metadata
from colscan.sources.scan import footers, scan
from colscan.sources.writer import WriteOptions, write
from colscan.streaming import stream


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """A file with many types, sorted, with page indexes, several row groups and pages."""
    n = 5000
    r = random.Random(2)
    table = pa.table(
        {
            "i": pa.array(range(n), pa.int64()),
            "n": pa.array([None if i % 5 == 0 else i for i in range(n)], pa.int32()),
            "f": pa.array([i / 7 for i in range(n)], pa.float64()),
            "s": pa.array([f"value {r.randrange(300):04d}" for i in range(n)], pa.string()),
            "b": pa.array([i % 3 == 0 for i in range(n)]),
            "d": pa.array([decimal.Decimal(i) / 100 for i in range(n)], pa.decimal128(9, 2)),
            "t": pa.array([dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i) for i in range(n)], pa.timestamp("us", tz="UTC")),
            "u": pa.array([i % 250 for i in range(n)], pa.uint8()),
            "x": pa.array([i.to_bytes(5, "big") for i in range(n)], pa.binary(5)),
            "l": pa.array([None if i % 11 == 0 else [] if i % 7 == 0 else [None, i] for i in range(n)], pa.list_(pa.int64())),
        }
    )
    path = str(tmp_path_factory.mktemp("files") / "t.parquet")
    how = {"data_page_size": 2048, "write_batch_size": 100, "write_page_index": True, "compression": "zstd", "use_dictionary": ["s"], "store_schema": False, "sorting_columns": [pq.SortingColumn(0), pq.SortingColumn(1, descending=True, nulls_first=True)]}
    with pq.ParquetWriter(path, table.schema, **how) as w:
        w.write_table(table, row_group_size=2000)
        w.add_key_value_metadata({"who": "test"})
    return path, table


# Thrift and metadata


def test_files(spark, made):
    path, table = made
    r = metadata.files(spark, path).first()
    assert (r.file_size, r.n_rows, r.n_row_groups, r.footer_encrypted) == (os.path.getsize(path), 5000, 3, False)
    raw = open(path, "rb").read()
    assert raw[r.footer_offset : -8] == bytes(r.footer) and r.key_values["who"] == "test" and set(r.column_orders) == {"TYPE_ORDER"}
    assert r.created_by == pq.read_metadata(path).created_by and r.version == 2


def test_footer_is_written_as_it_was_read(made):
    raw = metadata.File(made[0]).trailer()[1]
    meta, end = thrift.read(raw, thrift.FILE)
    assert end == len(raw)
    again = thrift.write(meta, thrift.FILE)
    assert thrift.read(again, thrift.FILE)[0] == meta
    assert again == raw


@pytest.mark.parametrize("bad", [b"", b"PAR1", b"PAR1" + b"\0" * 20 + b"PAR2", b"PAR1\xff\xff\xff\x7fPAR1", b"XXXX" + b"\0" * 12 + b"PAR1"])
def test_bad_files(tmp_path, bad):
    p = tmp_path / "x.parquet"
    p.write_bytes(bad)
    with metadata.File(f"file://{p}") as f, pytest.raises(thrift.FormatError):
        f.metadata()


def test_encrypted_footer_is_told(spark, tmp_path):
    context = crypto.ModuleContext(b"k" * 16, b"unique", b"prefix")
    about = {"encryption_algorithm": {"AES_GCM_V1": {"aad_file_unique": b"unique", "supply_aad_prefix": True}}, "key_metadata": b"kf"}
    framed = spark.range(1).select(crypto.encrypt_footer(F.lit(b"the footer"), context).alias("m")).first().m
    trailer = crypto.join_encrypted_footer(about, bytes(framed))
    body = b"PARE" + trailer + len(trailer).to_bytes(4, "little") + b"PARE"
    (tmp_path / "e.parquet").write_bytes(body)
    r = metadata.files(spark, f"file://{tmp_path}/e.parquet").first()
    assert r.footer_encrypted and r.algorithm == "AES_GCM_V1" and r.n_rows is None
    with metadata.File(f"file://{tmp_path}/e.parquet") as f, pytest.raises(thrift.FormatError, match="encrypted"):
        f.metadata()
    told, module = crypto.split_encrypted_footer(trailer)
    assert told == about
    assert spark.range(1).select(crypto.decrypt_footer(F.lit(module), context).alias("p")).first().p == b"the footer"


def test_schema_elements(spark, made):
    rows = {r.path: r for r in metadata.schema_elements(spark, made[0]).collect()}
    assert rows["s"].logical == "STRING" and rows["s"].type == "BYTE_ARRAY" and rows["s"].column == 3
    assert (rows["d"].logical, rows["d"].scale, rows["d"].precision) == ("DECIMAL(9, 2)", 2, 9)
    assert rows["t"].logical == "TIMESTAMP(utc, MICROS)" and rows["u"].logical == "INTEGER(8, unsigned)"
    assert rows["x"].type == "FIXED_LEN_BYTE_ARRAY" and rows["x"].type_length == 5
    leaf = next(r for p, r in rows.items() if p.startswith("l.") and r.column is not None)
    assert (leaf.max_rep, leaf.max_def, leaf.depth, leaf.column) == (1, 3, 3, 9)
    assert rows["l"].logical == "LIST" and rows["n"].repetition_type == "OPTIONAL" and rows[""].num_children == 10


def test_row_groups_and_sorting(spark, made):
    rows = metadata.row_groups(spark, made[0]).orderBy("row_group").collect()
    assert [(r.n_rows, r.row_base) for r in rows] == [(2000, 0), (2000, 2000), (1000, 4000)]
    assert [tuple(s) for s in rows[0].sorting] == [(0, False, False), (1, True, True)]


def test_chunks_against_pyarrow(spark, made):
    meta = pq.read_metadata(made[0])
    for r in metadata.chunks(spark, made[0]).collect():
        k = meta.row_group(r.row_group).column(r.column)
        assert (r.path, r.type, r.codec, r.num_values, r.total_compressed_size, r.data_page_offset) == (k.path_in_schema, k.physical_type, k.compression, k.num_values, k.total_compressed_size, k.data_page_offset)
        assert r.dictionary_page_offset == k.dictionary_page_offset and set(r.encodings) == set(k.encodings)
        assert r.null_count == k.statistics.null_count
        if r.path == "i":
            assert int.from_bytes(r.min_value, "little") == k.statistics.min
        assert sum(p["count"] for p in r.pages) >= 1


def test_pages_and_page_index(spark, made):
    table = made[1]
    headers = metadata.pages(spark, made[0]).where("type <> 'DICTIONARY_PAGE'").collect()
    index = metadata.page_index(spark, made[0]).collect()
    assert {(r.row_group, r.column, r.offset) for r in headers} == {(r.row_group, r.column, r.offset) for r in index}
    assert sum(r.n_values for r in headers if r.column == 0) == 5000 and len([r for r in headers if r.column == 0]) > 10
    starts = {0: 0, 1: 2000, 2: 4000}
    for r in index:
        if r.column == 0:
            assert int.from_bytes(r.min_value, "little") == starts[r.row_group] + r.first_row and r.boundary_order == "ASCENDING"
    assert sum(r.null_count for r in index if r.column == 1) == table.column("n").null_count


def test_read_ranges(spark, made):
    raw = open(made[0], "rb").read()
    file = metadata.file_list(spark, made[0]).first().file
    wanted = spark.createDataFrame([(file, 0, 4), (file, 100, 50), (file, len(raw) - 4, 4), (file, 7, 0)], "file string, offset long, length long")
    assert {(r.offset, bytes(r.bytes)) for r in metadata.read_ranges(wanted).collect()} == {(0, b"PAR1"), (100, raw[100:150]), (len(raw) - 4, b"PAR1"), (7, b"")}
    with pytest.raises(Exception, match="no 10 bytes"):
        metadata.read_ranges(spark.createDataFrame([(file, len(raw) - 4, 10)], "file string, offset long, length long")).collect()


@pytest.mark.parametrize("version", ["1.0", "2.0"])
@pytest.mark.parametrize("codec", ["none", "snappy", "zstd", "gzip", "brotli", "lz4"])
def test_chunks_decoded_from_bytes(tmp_path, made, version, codec):
    """Every column of a file from its bytes alone: pages, levels, codecs and encodings."""
    table = made[1]
    path = f"{tmp_path}/t.parquet"
    encoding = {"i": "DELTA_BINARY_PACKED", "f": "BYTE_STREAM_SPLIT", "n": "PLAIN", "b": "PLAIN", "d": "PLAIN", "t": "PLAIN", "u": "PLAIN", "x": "PLAIN", "l.list.element": "PLAIN"}
    for texts in ("DELTA_LENGTH_BYTE_ARRAY", "DELTA_BYTE_ARRAY", "dictionary"):
        if texts != "dictionary" and codec not in ("none", "zstd"):
            continue
        how = {"use_dictionary": ["s"], "column_encoding": encoding} if texts == "dictionary" else {"use_dictionary": False, "column_encoding": encoding | {"s": texts}}
        pq.write_table(table, path, compression=codec, data_page_version=version, data_page_size=4096, row_group_size=3000, store_schema=False, **how)
        with metadata.File(f"file://{path}") as f:
            meta = f.metadata()
            nodes = {n["column"]: n for n in metadata.leaves(meta["schema"]) if n["column"] is not None}
            got = {c: [] for c in nodes}
            levels = {c: [] for c in nodes}
            for g in meta["row_groups"]:
                for c, chunk in enumerate(g["columns"]):
                    _, data = metadata.chunk_bytes(f, chunk["meta_data"])
                    rep, define, values = pages.decode_chunk(data, chunk["meta_data"], nodes[c]["max_def"], nodes[c]["max_rep"], nodes[c].get("type_length", 0))
                    got[c] += values
                    levels[c] += list(zip(rep.tolist(), define.tolist(), strict=True))
        cols = {n: table.column(n).drop_null().to_pylist() for n in table.column_names}
        assert got[0] == cols["i"] and got[1] == cols["n"] and got[2] == cols["f"]
        assert [v.decode() for v in got[3]] == cols["s"] and got[4] == cols["b"]
        width = nodes[5].get("type_length", 0)
        raw_d = got[5] if width == 0 else [int.from_bytes(v, "big", signed=True) for v in got[5]]
        assert raw_d == [int(v * 100) for v in cols["d"]]
        assert got[6] == [int(v.timestamp() * 1_000_000) for v in cols["t"]] and got[7] == cols["u"] and got[8] == cols["x"]
        assert got[9] == [x for v in cols["l"] for x in v if x is not None]
        want = []
        for v in table.column("l").to_pylist():
            want += [(0, 0)] if v is None else [(0, 1)] if not v else [(int(j > 0), 2 if x is None else 3) for j, x in enumerate(v)]
        assert levels[9] == want


def test_page_walker_limits(made):
    with metadata.File(f"file://{made[0]}") as f:
        m = f.metadata()["row_groups"][0]["columns"][3]["meta_data"]
        _, data = metadata.chunk_bytes(f, m)
    walker = pages.PageWalker(data)
    header, body = walker.next_page()
    assert header["type"] == "DICTIONARY_PAGE" and walker.position > len(body)
    first = walker.position
    assert len(list(pages.PageWalker(data, first))) == 1 and len(list(walker)) >= 1 and walker.next_page() is None
    with pytest.raises(thrift.FormatError):
        list(pages.PageWalker(data, first + 40))
    # a header that is written reads the same
    assert thrift.read(thrift.write(header, thrift.PAGE_HEADER), thrift.PAGE_HEADER)[0] == header


def test_rare_structures():
    """Those that no writer here makes: written and read again, unknown fields left out."""
    for kind, value in (
        (thrift.COLUMN_CRYPTO, {"ENCRYPTION_WITH_COLUMN_KEY": {"path_in_schema": [b"a", b"b"], "key_metadata": b"k"}}),
        (thrift.FILE_CRYPTO, {"encryption_algorithm": {"AES_GCM_CTR_V1": {"aad_prefix": b"p", "aad_file_unique": b"u", "supply_aad_prefix": False}}}),
        (thrift.SCHEMA_ELEMENT, {"name": b"g", "type": "BYTE_ARRAY", "logical_type": {"GEOGRAPHY": {"crs": b"EPSG:1", "algorithm": "VINCENTY"}}}),
        (thrift.COLUMN_INDEX, {"null_pages": [True, False] * 9, "min_values": [b""] * 18, "max_values": [b"x"] * 18, "boundary_order": "DESCENDING", "null_counts": [-1] * 18}),
        (thrift.OFFSET_INDEX, {"page_locations": [{"offset": 1 << 40, "compressed_page_size": 5, "first_row_index": 0}]}),
        (thrift.COLUMN, {"type": "INT96", "encodings": ["PLAIN", 77], "path_in_schema": [b"v"], "codec": "LZO", "num_values": 1, "total_uncompressed_size": 2, "total_compressed_size": 3, "data_page_offset": 4, "encoding_stats": [{"page_type": "INDEX_PAGE", "encoding": "RLE", "count": 1}], "size_statistics": {"definition_level_histogram": [1, 2]}}),
    ):
        data = thrift.write(value, kind)
        assert thrift.read(data, kind) == (value, len(data))
        assert thrift.read(data, thrift.Struct({}))[0] == {}
        for cut in range(len(data)):
            with pytest.raises(thrift.FormatError):
                thrift.read(data[:cut], kind)
    names = [("TIME", {"is_adjusted_to_utc": False, "unit": {"NANOS": {}}}, "TIME(local, NANOS)"), ("INTEGER", {"bit_width": 16, "is_signed": True}, "INTEGER(16, signed)"), ("VARIANT", {"specification_version": 1}, "VARIANT(1)"), ("GEOMETRY", {}, "GEOMETRY"), ("UUID", {}, "UUID")]
    for name, about, text in names:
        assert thrift.logical_name(thrift.read(thrift.write({"name": b"v", "logical_type": {name: about}}, thrift.SCHEMA_ELEMENT), thrift.SCHEMA_ELEMENT)[0]) == text
    with pytest.raises(thrift.FormatError):
        thrift.write({"nonsense": 1}, thrift.KEY_VALUE)
    with pytest.raises(thrift.FormatError):
        thrift.write({"value": b"x"}, thrift.KEY_VALUE)


# Byte codecs


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_delta_round_trip(values):
    data = codecs.delta_encode(np.array(values, np.int64))
    out, end = codecs.delta_read(data + b"tail")
    assert out.tolist() == values and end == len(data)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=60))
def test_delta_bytes_round_trip(values):
    assert codecs.delta_length_decode(codecs.delta_length_encode(values)) == values
    assert codecs.delta_bytes_decode(codecs.delta_bytes_encode(sorted(values))) == sorted(values)


def test_delta_bytes_errors():
    good = codecs.delta_bytes_encode([b"abc", b"abd"])
    with pytest.raises(ValueError):
        codecs.delta_bytes_decode(good[:-1])
    with pytest.raises(ValueError):
        codecs.delta_bytes_decode(codecs.delta_encode(np.array([2])) + codecs.delta_length_encode([b"x"]))
    with pytest.raises(ValueError):
        codecs.delta_bytes_decode(codecs.delta_encode(np.array([0, 0])) + codecs.delta_length_encode([b"x"]))


def test_int96(spark, tmp_path):
    nanos = [0, -1, 1_600_000_000_123_456_789, -(10**18)]
    assert codecs.plain_decode_int96(b"".join(map(codecs.int96, nanos))).tolist() == nanos
    with pytest.raises(ValueError):
        codecs.plain_decode_int96(b"x" * 13)
    path = f"{tmp_path}/t.parquet"
    times = [dt.datetime(2001, 2, 3, 4, 5, 6, 7), None, dt.datetime(1950, 1, 1)]
    pq.write_table(pa.table({"t": pa.array(times, pa.timestamp("us"))}), path, use_deprecated_int96_timestamps=True)
    assert metadata.schema_elements(spark, path).where("path = 't'").first().type == "INT96"
    assert scan(spark, path, ["t"]).collect() == [(t,) for t in times]
    with metadata.File(f"file://{path}") as f:
        m = f.metadata()["row_groups"][0]["columns"][0]["meta_data"]
        _, _, values = pages.decode_chunk(metadata.chunk_bytes(f, m)[1], m, 1)
    assert [v // 1000 for v in values] == [int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times if t]


def test_fixed_length_columns(spark, made):
    assert [bytes(r.x) for r in scan(spark, made[0], ["x"]).collect()] == made[1].column("x").to_pylist()


def test_levels_of_bytes():
    levels = np.array([0, 1, 1, 2, 2, 2, 0, 1] * 9)
    body = codecs.hybrid_encode(levels, 2)
    got, used = pages.decode_levels(len(body).to_bytes(4, "little") + body + b"rest", 2, 72)
    assert (got == levels).all() and used == 4 + len(body)
    assert pages.decode_levels(b"", 0, 5)[0].tolist() == [0] * 5
    with pytest.raises(thrift.FormatError):
        pages.decode_levels((99).to_bytes(4, "little") + body, 2, 72)
    with pytest.raises(thrift.FormatError):
        pages.decode_levels(codecs.hybrid_encode(np.array([3] * 9), 2), 2, 9, prefixed=False)
    assert [pages.bit_width(n) for n in (0, 1, 2, 3, 4, 255, 256)] == [0, 1, 2, 2, 3, 8, 9]


def test_values_at_a_mask():
    """Sparse decoding of every physical type (E9-E11, E15, E16), and of codes."""
    n, mask = 40, np.arange(40) % 3 == 1
    for kind in codecs.TYPES:
        v = np.arange(n).astype(codecs.TYPES[kind])
        assert (codecs.plain_at(v.tobytes(), kind, mask) == v[mask]).all()
    texts = [b"x" * (i % 5) for i in range(n)]
    page = b"".join(len(t).to_bytes(4, "little") + t for t in texts)
    assert codecs.plain_at(page, "byte_array", mask) == [t for t, m in zip(texts, mask, strict=True) if m]
    with pytest.raises(ValueError):
        codecs.plain_at(page[:-1], "byte_array", mask)
    assert codecs.plain_at(bytes(range(80)), "fixed_len_byte_array", mask, 2) == [bytes([2 * i, 2 * i + 1]) for i in range(n) if mask[i]]
    assert codecs.plain_at(np.packbits(mask, bitorder="little").tobytes(), "boolean", mask).all()
    begin, data = codecs.offsets_of(codecs.plain_at(page, "byte_array", mask))
    assert begin[-1] == len(data) and len(begin) == mask.sum() + 1
    for width in (1, 3, 8, 12, 17, 20):
        codes = np.arange(n) * 7 % (1 << width)
        entries = np.arange(1 << width) * 10
        assert (codecs.unpack_lookup(codecs.bit_pack(codes, width), width, n, entries) == codes * 10).all()
        assert (codecs.lookup_at(entries, codes, mask) == codes[mask] * 10).all()
        bits = codecs.predicate_bitmap(codecs.hybrid_encode(codes, width), width, n, entries % 20 == 0)
        assert (np.unpackbits(bits, bitorder="little")[:n] == (codes % 2 == 0)).all()


def test_one_packed_run():
    values = np.array([1, 5, 7, 0, 2, 2, 2, 3, 6])
    data = codecs.packed_run(values, 3)
    assert data[0] == 5 and len(data) == 7 and (codecs.hybrid_decode(data, 3, 9) == values).all()
    assert codecs.packed_run(np.zeros(0), 3) == b""
    with pytest.raises(ValueError):
        codecs.packed_run(values, 2)


def test_dictionary_codes_as_bytes():
    assert codecs.small_codes(np.array([0, 255]), 8).dtype == np.uint8
    with pytest.raises(ValueError):
        codecs.small_codes(np.array([0]), 9)
    with pytest.raises(ValueError):
        codecs.lookup([b"a"], np.array([1]))


# Hashes and Bloom filters


def test_hash_widths(spark):
    rows = [(1, 2, 1.5, 2.5, "é", b"\0", True, dt.date(2000, 1, 2)), (None,) * 8]
    df = spark.createDataFrame(rows, "a int, b long, c float, d double, e string, f binary, g boolean, h date")
    want = {"a": (1).to_bytes(4, "little"), "b": (2).to_bytes(8, "little"), "c": np.float32(1.5).tobytes(), "d": np.float64(2.5).tobytes(), "e": "é".encode(), "f": b"\0", "g": b"\1", "h": (10958).to_bytes(4, "little")}
    for c, raw in want.items():
        for seed in (0, 9):
            got = {r.h_ for r in codecs.with_hash(df, c, "h_", seed=seed).collect()}
            assert got == {None, int(np.uint64(xxhash.xxh64_intdigest(raw, seed)).astype(np.int64))}, c
    assert codecs.parquet_hash(1, "int32") == xxhash.xxh64_intdigest(b"\1\0\0\0") and codecs.parquet_hash(True) == xxhash.xxh64_intdigest(b"\1")


def test_bloom_bytes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(3000).select((F.col("id") * 3).alias("v"), F.concat(F.lit("k"), F.col("id")).alias("s")).coalesce(1)
    write(df, path, WriteOptions(blooms={"v": (3000, 0.01), "s": (3000, 0.01)}))
    rows = {r.column: r for r in metadata.bloom_filters(spark, path).collect()}
    assert {(r.algorithm, r.hash, r.compression) for r in rows.values()} == {("BLOCK", "XXHASH", "UNCOMPRESSED")}
    numbers, texts = codecs.BlockBloom.from_bytes(rows[0]["filter"]), codecs.BlockBloom.from_bytes(rows[1]["filter"])
    assert numbers.num_blocks == rows[0].n_blocks
    assert numbers.has(np.array([codecs.parquet_hash(3 * i) for i in range(3000)], np.uint64)).all()
    assert texts.has_bytes([b"k%d" % i for i in range(3000)]).all()
    assert numbers.has(np.array([codecs.parquet_hash(3 * i + 1) for i in range(3000)], np.uint64)).mean() < 0.05
    assert numbers.to_bytes()[-32 * numbers.num_blocks :] == bytes(rows[0]["filter"])[-32 * numbers.num_blocks :]
    mine = codecs.BlockBloom(numbers.num_blocks)
    mine.add(np.array([codecs.parquet_hash(3 * i) for i in range(3000)], np.uint64))
    assert (mine.words == numbers.words).all()
    assert (codecs.BlockBloom.from_bytes(mine.to_bytes()).words == mine.words).all()
    for bad in (mine.to_bytes()[:-1], thrift.write({"num_bytes": 31, "algorithm": {"BLOCK": {}}, "hash": {"XXHASH": {}}, "compression": {"UNCOMPRESSED": {}}}, thrift.BLOOM_HEADER) + b"\0" * 31):
        with pytest.raises(thrift.FormatError):
            codecs.BlockBloom.from_bytes(bad)


def test_bloom_sizes():
    assert stats.bloom_blocks(0, 0.01) == 1
    assert stats.bloom_blocks(1000, 0.0) == stats.bloom_blocks(1000, 1e-12)
    assert stats.bloom_blocks(1000, 1.0) == stats.bloom_blocks(1000, 0.5)


# Writers


def test_pyarrow_writer_modes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    options = WriteOptions(codec="brotli")
    ids = lambda: sorted(r.id for r in spark.createDataFrame(pq.read_table(tmp_path / "t").to_pandas()).collect())
    write(spark.range(100), path, options)
    write(spark.range(100, 200), path, options, mode="append")
    assert ids() == list(range(200))
    write(spark.range(7), path, options, mode="ignore")
    assert ids() == list(range(200))
    write(spark.range(5), path, options, mode="overwrite")
    assert ids() == list(range(5))
    with pytest.raises(FileExistsError):
        write(spark.range(1), path, options)
    with pytest.raises(ValueError):
        write(spark.range(1), path, options, mode="other")
    write(spark.range(0), path, options, mode="overwrite")
    assert pq.read_table(tmp_path / "t").num_rows == 0
    assert not [n for n in os.listdir(tmp_path / "t") if "draft" in n]


def test_levels_of_codecs_reach_both_writers(spark, tmp_path):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("s")).coalesce(1)
    for codec, low, high in (("zstd", 1, 19), ("gzip", 1, 9), ("brotli", 0, 9)):
        sizes = []
        for level in (low, high):
            out = f"file://{tmp_path}/{codec}{level}"
            write(df, out, WriteOptions(codec=codec, level=level, dictionary_default=False))
            sizes.append(footers(spark, out).agg(F.sum("packed_bytes")).first()[0])
        assert sizes[1] < sizes[0]


def test_scan_of_row_groups_reads_only_these(spark, tmp_path):
    for n in range(3):
        pq.write_table(pa.table({"v": pa.array(range(n * 1000, n * 1000 + 1000)), "t": pa.array([dt.datetime(2020, 1, 1)] * 1000)}), f"{tmp_path}/p{n}.parquet", row_group_size=300)
    rows = scan(spark, str(tmp_path), ["v", 1], [1], row_index=True).collect()
    assert sorted((r.v, r.row_index) for r in rows) == [(n * 1000 + i, i) for n in range(3) for i in range(300, 600)]
    assert {r.t for r in rows} == {dt.datetime(2020, 1, 1)}
    assert scan(spark, str(tmp_path), ["v"], [9]).count() == 0


# Order, masks, adaptive filters, streams


def test_sparse_keys_have_few_blocks(spark):
    r = random.Random(5)
    keys = sorted(r.randrange(-(2**62), 2**62) for _ in range(500))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, v long")
    span, blocks = ordered.layout(df, "k")
    assert blocks <= 3
    assert [x.row_index for x in ordered.row_index(df, "k").orderBy("k").collect()] == list(range(500))


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ONE_TASK", 4)
    monkeypatch.setattr(ordered, "UPPER", 3)
    df = spark.createDataFrame([(i * 7 - 400, None if i % 6 == 0 else i) for i in range(150)], "k long, v long")
    rows = {x.k: x for x in ordered.previous(ordered.running_sum(df, F.coalesce("v", F.lit(1)), "k", "s", 10, 110), "v", "k", "b", 10, 110).collect()}
    total, before = 0, None
    for i in range(150):
        v = None if i % 6 == 0 else i
        total += 1 if v is None else v
        assert (rows[i * 7 - 400].s, rows[i * 7 - 400].b) == (total, before)
        before = v


def test_masked_offsets(spark):
    df = spark.createDataFrame([(1, "é"), (2, "abc"), (3, None), (4, "x")], "k long, s string")
    assert sorted(map(tuple, encodings.masked_offsets(df, "s", "k", F.col("k") != 2).collect())) == [(1, 0, 2), (3, 2, 2), (4, 2, 3)]


def test_common_prefix(spark):
    pairs = [("", ""), ("a", "a"), ("ab", "ac"), ("éàx", "éày"), ("abc", "abcdef"), ("x" * 999 + "a", "x" * 999 + "b"), (None, "a"), ("q", "a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", encodings.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()
    for r in rows:
        assert r.n == (0 if r.a is None else len(os.path.commonprefix([r.a, r.b])))


@pytest.mark.parametrize("kind", ["int", "long", "double", "string"])
def test_adaptive_kinds(spark, kind):
    """One filter for every type (F11-F16), over values and over a dictionary."""
    df = spark.range(20_000).select("id", (F.col("id") % 100).cast(kind).alias("v"))
    few, most = (lambda c: c.cast("int") < 3), (lambda c: c.cast("int") < 60)
    for test, dispatch, n in ((few, "mask", 600), (most, "values", 12_000)):
        plain = adaptive.adaptive_filter(df, "v", test, "id", 1000)
        assert plain.probe.dispatch == dispatch and plain.values().count() == n
        by_entry = adaptive.adaptive_dictionary_filter(df, "v", test, "id", 1000)
        assert (by_entry.probe.rows_in, by_entry.probe.rows_passed) == (plain.probe.rows_in, plain.probe.rows_passed)
        assert by_entry.kind == dispatch
        assert (by_entry.rows.where("mask") if dispatch == "mask" else by_entry.rows).count() == n
    coded = adaptive.adaptive_dictionary_filter(df, "v", most, "id", 1000, codes=True)
    assert coded.kind == "codes" and coded.rows.select("code").distinct().count() == 60 and coded.dictionary.count() == 100


def test_probe_of_sparse_keys(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id") * 1000).alias("k"), F.col("id").alias("v"))
    p = adaptive.adaptive_filter(df, "v", lambda c: c < 50, "k", 100).probe
    assert (p.rows_in, p.rows_passed) == (300, 50)


def test_gather_by_several_bits_of_a_key(spark):
    mask = spark.createDataFrame([(1, True), (1, False), (2, False)], "id long, mask boolean")
    assert [r.id for r in masks.gather_by(spark.range(4), mask, "id", ["id"]).collect()] == [1]


def test_windowed_counts(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1, 0, m), m % 2) for m in (0, 1, 2, 11, 12, 25)]
    spark.createDataFrame(rows, "t timestamp, k int").write.parquet(f"{tmp_path}/in")
    counts = stream.windowed_counts(stream.file_stream(spark, f"{tmp_path}/in"), "t", "10 minutes", "1 hour", "k")
    query = counts.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination()
    got = {(r.window.start.minute, r.k): r["count"] for r in spark.table("windowed").collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (10, 1): 1, (10, 0): 1, (20, 1): 1}


# Cancellation


def test_cancellation(spark):
    token = CancellationToken(spark)
    assert not token.is_cancelled
    with token.running():
        assert token.tag in spark.sparkContext.getJobTags()
    assert token.tag not in spark.sparkContext.getJobTags()
    assert read_columns([spark.range(n) for n in (3, 1, 2)], lambda df: df.count(), ReadOptions(2, token)) == [3, 1, 2]
    assert read_columns([], lambda df: df.count()) == []
    token.cancel()
    assert token.is_cancelled
    with pytest.raises(Cancelled):
        read_columns([spark.range(1)], lambda df: df.count(), ReadOptions(1, token))
    other = CancellationToken(spark)

    def fail(df):
        if df.count() == 2:
            raise ValueError("two")
        return df.selectExpr("sum(id)").collect()

    with pytest.raises(ValueError, match="two"):
        read_columns([spark.range(1), spark.range(2), spark.range(3)], fail, ReadOptions(1, other))
    assert other.is_cancelled


# Modules (X1-X27)


def test_framed_modules(spark):
    key, other = b"0" * 16, b"1" * 32
    keys = crypto.StaticKeys().set_footer(key).set_column("a.b", other)
    assert keys.column_key("a.b") == other and keys.column_key("c") == key
    with pytest.raises(KeyError):
        crypto.StaticKeys().footer_key()
    context = crypto.ModuleContext(keys.column_key("a.b"), b"u", b"p", 1, 2, crypto.CountedNonces(b"abcd", 5))
    df = spark.createDataFrame([(0, b"page zero"), (1, b"")], "n long, plain binary")
    sealed = df.withColumn("m", crypto.encrypt_module(F.col("plain"), context, "data_page", 3, F.col("n")))
    for r in sealed.collect():
        m = bytes(r.m)
        assert int.from_bytes(m[:4], "little") == len(m) - 4 == crypto.NONCE + crypto.TAG + len(r.plain)
        assert m[4:16] == b"abcd" + (5 + r.n).to_bytes(8, "little") and crypto.unframe(m) == m[4:]
    opened = sealed.select("plain", crypto.decrypt_module(F.concat("m", F.lit(b"next")), context, "data_page", 3).alias("d")).collect()
    assert all(bytes(r.d.plain) == bytes(r.plain) and r.d.used == 4 + 28 + len(r.plain) for r in opened)
    for wrong in (crypto.ModuleContext(other, b"x", b"p", 1, 2), crypto.ModuleContext(b"2" * 32, b"u", b"p", 1, 2)):
        with pytest.raises(Exception):  # noqa: B017
            sealed.select(crypto.decrypt_module(F.col("m"), wrong, "data_page", 3)).collect()
    with pytest.raises(Exception, match="truncated"):
        sealed.select(crypto.decrypt_module(F.expr("substring(m, 1, 20)"), context, "data_page", 3)).collect()
    with pytest.raises(ValueError):
        context.aad("data_page")
    assert context.aad("column_meta") == b"pu\x01\x01\0\x02\0" and crypto.ModuleContext(key, b"u").aad("footer") == b"u\0"
    assert crypto.has_page_ordinal("data_page_header") and not crypto.has_page_ordinal("dictionary_page")
    assert len(crypto.random_bytes(12)) == 12
    with pytest.raises(ValueError):
        crypto.CountedNonces(b"abc")


# Encrypted files


@pytest.mark.parametrize("footer", encrypted.FOOTER_MODES)
def test_encrypted_files(spark, tmp_path, footer, monkeypatch):
    monkeypatch.setattr(encrypted, "PAGE_ROWS", 100)
    monkeypatch.setattr(encrypted, "GROUP_ROWS", 250)
    keys = crypto.StaticKeys().set_footer(b"f" * 16).set_column("s", b"s" * 32)
    schema = "i int, n bigint, d double, b boolean, s string"
    rows = [(i, None if i % 4 == 0 else i * 10**10, i / 3, i % 3 == 0, None if i % 7 == 0 else f"secret é {i}") for i in range(900)]
    df = spark.createDataFrame(rows, schema).repartition(2)
    path = f"file://{tmp_path}/e"
    encrypted.write_encrypted(df, path, keys, footer)
    raw = b"".join((tmp_path / "e" / n).read_bytes() for n in os.listdir(tmp_path / "e"))
    assert b"secret" not in raw and not [n for n in os.listdir(tmp_path / "e") if "draft" in n]
    assert sorted(map(tuple, encrypted.scan_encrypted(spark, path, keys, schema).collect())) == sorted(rows)
    about = metadata.files(spark, path).collect()
    assert {(r.footer_encrypted, r.algorithm) for r in about} == {(footer == "encrypted", "AES_GCM_V1")}
    # without the key of one column the others can be read, and that one cannot
    part = crypto.StaticKeys().set_footer(b"f" * 16)
    assert sorted(r.i for r in encrypted.scan_encrypted(spark, path, part, schema, ["i"]).collect()) == list(range(900))
    for bad in (part, crypto.StaticKeys().set_footer(b"x" * 16).set_column("s", b"s" * 32)):
        with pytest.raises(Exception):  # noqa: B017
            encrypted.scan_encrypted(spark, path, bad, schema).collect()
    with pytest.raises(FileExistsError):
        encrypted.write_encrypted(df, path, keys, footer)
    with pytest.raises(ValueError):
        encrypted.write_encrypted(df, f"{path}2", keys, "other")
