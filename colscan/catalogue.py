"""The queries of the engine's own operators and their DuckDB equivalents."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs, crypto, encodings
from .operators import adaptive, dictionary, masks, ordered, stats
from .plans.tpch import promo_share
from .session import shared_dir
from .sources import blooms, decode, metadata
from .sources.scan import footers, scan
from .sources.writer import WriteOptions, evenly, write
from .streaming import stream

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
KEY, AAD = b"0123456789abcdef", crypto.module_aad(b"tab", b"file", "data_page", 0, 1, 2)


def query(sql: str | None = None, name: str | None = None):
    """Registers a query and its DuckDB form."""

    def add(f):
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, sf_dir: str, name: str, columns: list[str | int] | None = None) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet", columns)


# Plans and scans


@query("""select round(100 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue
from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1995-09-01' and l_shipdate < timestamp '1995-10-01'""")
def q14_promo(spark, d):
    return promo_share(spark, d)


for _name, _table, _column in (("scan_i64", "lineitem", "l_orderkey"), ("scan_i32", "lineitem", "l_linenumber"), ("scan_f64", "lineitem", "l_extendedprice"), ("scan_string", "documents", "text"), ("scan_timestamp", "lineitem", "l_shipdate")):
    query(f"select {_column} from {_table}", _name)(lambda s, d, t=_table, c=_column: _t(s, d, t, [c]))
query("select o_orderkey, o_totalprice from orders", "scan_by_ordinal")(lambda s, d: _t(s, d, "orders", [0, 3]))


@query("select vec_id, i - 1 as at, embedding[i] as value from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def scan_nested_float(spark, d):
    return _t(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", F.posexplode("embedding").alias("at", "value")).withColumn("at", F.col("at").cast("long"))


@query("select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as place from orders")
def row_address(spark, d):
    return ordered.row_index(_t(spark, d, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", "place")


# Filters, masks, late materialisation


@query("select event_id, user_id, value from events where event_type = 'click' and value > 50")
def late_mat_project(spark, d):
    return masks.gather(_t(spark, d, "events"), F.expr("event_type = 'click' and value > 50"), ["event_id", "user_id", "value"])


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def masked_by_other(spark, d):
    big = _t(spark, d, "orders", ["o_custkey", "o_totalprice"]).select(F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice") > 300000).alias("mask"))
    return masks.gather_by(_t(spark, d, "customer"), big, "c_custkey", ["c_custkey", "c_name"])


@query("select event_id, coalesce(value < 10, false) as mask from events")
def row_mask(spark, d):
    return masks.with_mask(_t(spark, d, "events", ["event_id", "value"]), F.col("value") < 10).select("event_id", "mask")


@query("""select (event_id // 32768) + 1 as bucket, count(*) as set_bits from events where value < 10 group by 1""")
def packed_mask(spark, d):
    return masks.pack_mask(masks.with_mask(_t(spark, d, "events", ["event_id", "value"]), F.col("value") < 10), "event_id").select("bucket", "set_bits")


@query("select count(*) as n from events where value < 10 and event_id < 5000")
def popcount_prefix(spark, d):
    return masks.popcount_prefix(masks.with_mask(_t(spark, d, "events", ["event_id", "value"]), F.col("value") < 10), "event_id", 5000)


@query("select " + ", ".join(f"count(*) filter (where event_id % {k} = 0) as n_{k}" for k in (1, 2, 10, 100, 1000)) + ", 0 as n_none from events")
def mask_selectivity_sweep(spark, d):
    return _t(spark, d, "events", ["event_id"]).agg(*[F.count_if(F.col("event_id") % k == 0).alias(f"n_{k}") for k in (1, 2, 10, 100, 1000)], F.count_if(F.lit(False)).cast("int").alias("n_none"))


@query("select o_orderkey, o_totalprice from orders where o_orderkey between 4000 and 5500")
def range_between_i64(spark, d):
    return masks.between(_t(spark, d, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 4000, 5500)


@query("select l_orderkey, l_shipdate from lineitem where l_shipdate between timestamp '1996-01-01' and timestamp '1996-03-31'")
def range_between_ts(spark, d):
    return _t(spark, d, "lineitem", ["l_orderkey", "l_shipdate"]).where("l_shipdate between timestamp_ntz '1996-01-01' and timestamp_ntz '1996-03-31'")


@query("select count(*) as n from lineitem where l_quantity > 25 and l_discount < 0.05")
def count_matching(spark, d):
    return masks.count_matching(_t(spark, d, "lineitem", ["l_quantity", "l_discount"]), F.expr("l_quantity > 25 and l_discount < 0.05"))


_PAGES = "with r as (select *, (row_number() over (order by o_orderkey) - 1) // 1000 as page from orders), z as (select page, min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as n_rows, count(*) filter (where o_totalprice is null) as nulls from r group by page) "


def _orders(spark, d):
    return _t(spark, d, "orders", ["o_orderkey", "o_totalprice"])


@query(_PAGES + "select page, lo, hi, n_rows, nulls from z")
def zone_map(spark, d):
    return masks.zone_map(_orders(spark, d), "o_totalprice", "o_orderkey", 1000)


@query(_PAGES + "select page, hi >= 499000 and lo <= 600000 as keep from z")
def page_keep_mask(spark, d):
    return masks.page_keep_mask(masks.zone_map(_orders(spark, d), "o_totalprice", "o_orderkey", 1000), 499000.0, 600000.0).select("page", "keep")


@query(_PAGES + "select o_orderkey, o_totalprice from r join z using (page) where hi >= 499000 and lo <= 600000")
def pruned_superset(spark, d):
    return masks.pruned_superset(_orders(spark, d), "o_totalprice", "o_orderkey", 499000.0, 600000.0, 1000).select("o_orderkey", "o_totalprice")


# Adaptive filters


@query("select event_id, value, 'values' as shape from events where value >= 0")
def adaptive_high(spark, d):
    found = adaptive.adaptive_filter(_t(spark, d, "events", ["event_id", "value"]), "value", lambda c: c >= 0, "event_id", 1024)
    return found.rows.select("event_id", "value", F.lit(found.probe.dispatch).alias("shape"))


@query("select event_id, coalesce(value < 0.5, false) as mask, 'mask' as shape from events")
def adaptive_low(spark, d):
    found = adaptive.adaptive_filter(_t(spark, d, "events", ["event_id", "value"]), "value", lambda c: c < 0.5, "event_id", 1024)
    return found.rows.select("event_id", "mask", F.lit(found.probe.dispatch).alias("shape"))


@query("select count(*) as rows_in, count(*) filter (where value < 20) as rows_passed, round(avg((value < 20)::int), 6) as selectivity, case when avg((value < 20)::int) > 0.1 then 'values' else 'mask' end as dispatch from (select * from events order by event_id limit 1536)")
def selectivity_probe(spark, d):
    p = adaptive.adaptive_filter(_t(spark, d, "events", ["event_id", "value"]), "value", lambda c: c < 20, "event_id", 512).probe
    return spark.range(1).select(F.lit(p.rows_in).cast("long").alias("rows_in"), F.lit(p.rows_passed).cast("long").alias("rows_passed"), F.round(F.lit(p.selectivity), 6).alias("selectivity"), F.lit(p.dispatch).alias("dispatch"))


for _kind in ("int", "bigint", "double", "string"):
    for _shape, _op, _rows in (("mask", "<", "true"), ("values", ">=", "e.v >= 5")):
        _v = f"cast(event_id % 100 as {'varchar' if _kind == 'string' else _kind})"
        _test = f"cast(e.v as bigint) {_op} 5"

        @query(f"select event_id, {'e.v as value' if _shape == 'values' else f'{_test} as mask'}, '{_shape}' as shape from (select event_id, {_v} as v from events) e" + (f" where {_test}" if _shape == "values" else ""), f"adaptive_{_kind}_{_shape}")
        def _adaptive(spark, d, kind=_kind, shape=_shape):
            e = _t(spark, d, "events", ["event_id"]).withColumn("value", (F.col("event_id") % 100).cast(kind))
            found = adaptive.adaptive_filter(e, "value", (lambda c: c.cast("bigint") < 5) if shape == "mask" else (lambda c: c.cast("bigint") >= 5), "event_id", 1000)
            return found.rows.withColumn("shape", F.lit(found.probe.dispatch))


@query("select event_id, event_type as value, 'values' as shape, (select least(1536, count(*)) from events)::int as probed from events where event_type in ('click', 'view', 'purchase')")
def adaptive_dictionary_values(spark, d):
    found = adaptive.adaptive_dictionary_filter(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", lambda c: c.isin("click", "view", "purchase"), "event_id", 512)
    return found.rows.select("event_id", F.col("event_type").alias("value"), F.lit(found.kind).alias("shape"), F.lit(found.probe.rows_in).cast("int").alias("probed"))


@query("select event_id, event_type = 'nothing' as mask, 'mask' as shape from events")
def adaptive_dictionary_mask(spark, d):
    found = adaptive.adaptive_dictionary_filter(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", lambda c: c == "nothing", "event_id", 512)
    return found.rows.select("event_id", "mask", F.lit(found.kind).alias("shape"))


# Dictionaries

_DICT = "with f as (select event_type as value, min(event_id) as first from events group by 1), k as (select row_number() over (order by first) - 1 as code, value, first from f) "


@query(_DICT + "select code, value, first from k")
def dict_first_occurrence(spark, d):
    return dictionary.dictionary(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", "event_id")


@query(_DICT + "select event_id, code from events join k on event_type = k.value")
def dict_codes(spark, d):
    return dictionary.encode(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", "event_id")


@query(_DICT + "select event_id, code from events join k on event_type = k.value where event_type <> 'click'")
def adaptive_dictionary_codes(spark, d):
    """Passing rows by the code of their entry, without their values."""
    return adaptive.adaptive_dictionary_filter(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", lambda c: c != "click", "event_id", 512, codes=True).rows


@query("select l_orderkey, l_returnflag, l_quantity from lineitem where upper(l_returnflag) <> 'R'")
def expensive_predicate_on_dictionary(spark, d):
    return dictionary.by_dictionary(_t(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]), "l_returnflag", lambda c: F.upper(c) != "R", expensive=True)


@query(_DICT + "select event_id, code::smallint as code from events join k on event_type = k.value")
def dict_codes_small(spark, d):
    return dictionary.encode(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", "event_id", small=True)


@query("select event_id, event_type from events")
def dict_decode(spark, d):
    e = _t(spark, d, "events", ["event_id", "event_type"])
    return dictionary.decode(dictionary.encode(e, "event_type", "event_id"), dictionary.dictionary(e, "event_type", "event_id"), "event_id", "event_type")


@query("select l_orderkey, l_returnflag, l_quantity from lineitem where l_returnflag in ('A', 'N')")
def predicate_on_dictionary(spark, d):
    return dictionary.by_dictionary(_t(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]), "l_returnflag", lambda c: c.isin("A", "N"))


@query("select count(distinct p_brand) as ndv, case when count(distinct p_brand) <= 1 then 0 else length(bin(count(distinct p_brand) - 1)) end::int as bits from part")
def dict_bit_width(spark, d):
    n = F.count_distinct("p_brand")
    return _t(spark, d, "part", ["p_brand"]).agg(n.alias("ndv"), dictionary.bit_width(n).alias("bits"))


# Encodings

_RUNS = "with c as (select event_id, event_type, case when lag(event_type) over (order by event_id) is not distinct from event_type and event_id <> (select min(event_id) from events) then 0 else 1 end as s from events), g as (select *, sum(s) over (order by event_id) as run from c), runs as (select run::bigint as run, any_value(event_type) as value, count(*) as n from g group by run) "


def _runs(spark, d):
    return encodings.runs(_t(spark, d, "events", ["event_id", "event_type"]), "event_type", "event_id")


query(_RUNS + "select run, value, n from runs", "rle_runs")(_runs)
query(_RUNS + "select run, value, n from runs where n >= 3", "rle_threshold")(lambda s, d: _runs(s, d).where("n >= 3"))
query(_RUNS + "select run, value, unnest(range(1, n + 1)) as at from runs", "rle_expand")(lambda s, d: encodings.expand(_runs(s, d)))

_DELTA = "with e as (select o_orderkey, o_custkey - coalesce(lag(o_custkey) over (order by o_orderkey), 0) as delta, row_number() over (order by o_orderkey) - 1 as i from orders) "


def _deltas(spark, d):
    return encodings.deltas(_t(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", "o_orderkey")


query(_DELTA + "select o_orderkey, delta from e", "delta_encode")(_deltas)
query("select o_orderkey, o_custkey from orders", "delta_decode")(lambda s, d: encodings.undelta(_deltas(s, d), "o_orderkey", "o_custkey"))


@query(_DELTA + "select (i - 1) // 128 as block, min(delta) as min_delta, case when max(delta) = min(delta) then 0 else length(bin(max(delta) - min(delta))) end::int as max_bits from e where i > 0 group by 1")
def delta_block_min(spark, d):
    return encodings.delta_blocks(_t(spark, d, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", "o_orderkey")


@query("""with p as (select c_custkey, c_name, lag(c_name) over (order by c_custkey) as b from customer), l as (select c_custkey, c_name,
coalesce(list_max(list_filter(range(0, least(length(c_name), length(b)) + 1), lambda i: c_name[1:i] = b[1:i])), 0)::int as prefix from p) select c_custkey, prefix, substr(c_name, prefix + 1) as suffix from l""")
def prefix_lengths(spark, d):
    return encodings.prefixes(_t(spark, d, "customer", ["c_custkey", "c_name"]), "c_name", "c_custkey")


@query("select doc_id, (sum(octet_length(encode(text))) over (order by doc_id) - octet_length(encode(text)))::bigint as begin_offset, (sum(octet_length(encode(text))) over (order by doc_id))::bigint as end_offset from documents")
def byte_array_offsets(spark, d):
    return encodings.offsets(_t(spark, d, "documents", ["doc_id", "text"]), "text", "doc_id")


@query("select doc_id, (sum(octet_length(encode(text))) over (order by doc_id) - octet_length(encode(text)))::bigint as begin_offset, (sum(octet_length(encode(text))) over (order by doc_id))::bigint as end_offset from documents where doc_id % 3 = 1")
def masked_byte_array_offsets(spark, d):
    return encodings.masked_offsets(_t(spark, d, "documents", ["doc_id", "text"]), "text", "doc_id", F.col("doc_id") % 3 == 1)


# Pages decoded from their bytes, as the files' metadata describes them

#: name: (value in Spark, value in SQL, physical type, value of the bytes)
_PAGED = {
    "i32": ("cast(o_orderkey % 1000 as int)", "cast(o_orderkey % 1000 as int)", "INT32", "value"),
    "i64": ("o_orderkey * 7 - 3", "o_orderkey * 7 - 3", "INT64", "value"),
    "f32": ("cast(cast(o_orderkey as double) / 8 as float)", "cast(cast(o_orderkey as double) / 8 as float)", "FLOAT", "value"),
    "f64": ("o_totalprice", "o_totalprice", "DOUBLE", "value"),
    "bool": ("o_orderkey % 3 = 0", "o_orderkey % 3 = 0", "BOOLEAN", "value"),
    "string": ("concat(o_orderpriority, o_orderkey % 400)", "concat(o_orderpriority, o_orderkey % 400)", "BYTE_ARRAY", "cast(value as string)"),
    "nulls": ("case when o_orderkey % 5 > 0 then o_orderkey end", "case when o_orderkey % 5 > 0 then o_orderkey end", "INT64", "value"),
    "int96": ("timestamp_millis(o_orderkey * 1000003)", "o_orderkey * 1000003 * 1000000", "INT96", "value"),
    "flba": ("cast(o_orderkey as decimal(20,2))", "o_orderkey * 100", "FIXED_LEN_BYTE_ARRAY", "cast(conv(hex(value), 16, 10) as bigint)"),
}
for _name, (_value, _same, _physical, _seen) in _PAGED.items():
    for _codec, _version, _dict in (("uncompressed", 1, False), ("snappy", 1, True), ("zstd", 2, False), ("gzip", 2, True), ("lz4_raw", 1, False), ("brotli", 1, True)):
        if _codec in ("gzip", "lz4_raw", "brotli") and _name not in ("i64", "string"):
            continue

        @query(f"select o_orderkey as k, {_same} as v from orders", f"pages_{_name}_{_codec}_v{_version}{'_dictionary' if _dict else ''}")
        def _paged(spark, d, value=_value, physical=_physical, seen=_seen, codec=_codec, version=_version, with_dict=_dict):
            """Written by Spark (brotli: by pyarrow), decoded page by page from the bytes of the files."""
            out, base = shared_dir(spark), spark.conf.get("spark.sql.parquet.outputTimestampType")
            rows = _t(spark, d, "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"]).selectExpr("o_orderkey as k", f"{value} as v")
            spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
            try:
                write(rows, out, WriteOptions(codec=codec, page_version=version, dictionary_default=with_dict, rows_per_group=4000))
            finally:
                spark.conf.set("spark.sql.parquet.outputTimestampType", base)
            return decode.columns_by_pages(spark, out, {"k": "INT64", "v": physical}).withColumnRenamed("v", "value").selectExpr("k", f"{seen} as v")


@query("select vec_id as k, i - 1 as at, embedding[i] as v from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def pages_of_lists(spark, d):
    """Repetition levels part the rows of a list column; it is the second of its table."""
    out = shared_dir(spark)
    write(_t(spark, d, "embeddings", ["vec_id", "embedding"]), out)
    leaf = metadata.schema_elements(spark, out).where("max_rep = 1 and column is not null").first()
    k = decode.column_by_pages(spark, out, "vec_id", "INT64").select("file", "row", F.col("value").alias("k"))
    v = decode.column_by_pages(spark, out, leaf.path, leaf.type).groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("entry", "value")))["value"].alias("v"))
    return k.join(v, ["file", "row"]).select("k", F.posexplode("v").alias("at", "v")).withColumn("at", F.col("at").cast("long"))


def _written(spark, d, **how):
    out = shared_dir(spark)
    write(_t(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]).coalesce(1), out, WriteOptions(**how))
    return out


@query("select count(*) as n_rows, 1 as n_files, true as marks, true as sized, 'colscan' as who, 4 as columns from orders")
def file_facts(spark, d):
    out = _written(spark, d)
    f = metadata.files(spark, out)
    ends = f.select("file", F.explode(F.array(F.lit(0).cast("long"), F.col("file_size") - 4)).alias("offset"), F.lit(4).alias("length"))
    marks = metadata.read_ranges(ends).agg(F.bool_and(F.col("bytes").cast("string") == "PAR1")).first()[0]
    n = metadata.schema_elements(spark, out).where("column is not null").count()
    sized = F.bool_and(F.col("footer_offset") + F.octet_length("footer") + 8 == F.col("file_size"))
    return f.agg(F.sum("n_rows").alias("n_rows"), F.count("*").cast("int").alias("n_files"), F.lit(marks).alias("marks"), sized.alias("sized"), F.lit("colscan").alias("who"), F.lit(n).alias("columns"))


@query("select * from (values ('o_orderkey', 'INT64', 'OPTIONAL', null, 0), ('o_custkey', 'INT64', 'OPTIONAL', null, 1), ('o_totalprice', 'DOUBLE', 'OPTIONAL', null, 2), ('o_orderpriority', 'BYTE_ARRAY', 'OPTIONAL', 'STRING', 3)) t(path, type, repetition_type, logical, ordinal)")
def schema_facts(spark, d):
    return metadata.schema_elements(spark, _written(spark, d)).where("column is not null").select("path", "type", "repetition_type", "logical", F.col("column").alias("ordinal"))


#: Row groups of 1,000 orders in a file, so that no footer grows with the table.
FILE_GROUPS = 500


def _grouped(spark, d, columns):
    """Orders in order of their keys as row groups of 1,000, dealt over files that are named by their place."""
    out = shared_dir(spark)
    orders = _t(spark, d, "orders", columns)
    files = max(1, math.ceil(orders.count() / (FILE_GROUPS * 1000)))
    rows = ordered.row_index(orders, "o_orderkey").repartitionById(files, F.expr(f"cast(row_index div {FILE_GROUPS * 1000} as int)"))
    write(rows.sortWithinPartitions("row_index").select(*columns), out, WriteOptions(rows_per_group=1000))
    return out


def _part():
    """A file's place among those of ``_grouped``, by the number that Spark's writer puts into its name."""
    return F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")


def _group():
    return (_part() * FILE_GROUPS + F.col("row_group")).cast("int")


@query("with r as (select *, (row_number() over (order by o_orderkey) - 1) // 1000 as g from orders) select g::int as row_group, count(*) as n_rows, min(g * 1000) as row_base from r group by g")
def row_group_facts(spark, d):
    out = _grouped(spark, d, ["o_orderkey"])
    return metadata.row_groups(spark, out).select(_group().alias("row_group"), "n_rows", (_part() * FILE_GROUPS * 1000 + F.col("row_base")).alias("row_base"))


@query("with r as (select *, (row_number() over (order by o_orderkey) - 1) // 1000 as g from orders) select g::int as row_group, min(o_custkey) as lo, max(o_custkey) as hi, count(*) filter (where o_custkey is null) as null_count, count(*) as num_values, 'SNAPPY' as codec from r group by g")
def chunk_facts(spark, d):
    out = _grouped(spark, d, ["o_orderkey", "o_custkey"])
    number = lambda c: F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(c), F.lit("(..)"))), ""), 16, 10).cast("long")
    return metadata.chunks(spark, out).where("path = 'o_custkey'").select(_group().alias("row_group"), number("min_value").alias("lo"), number("max_value").alias("hi"), "null_count", "num_values", "codec")


@query("select count(*) as n_rows, 0 as wrong, true as several from orders")
def page_index_facts(spark, d):
    """The bounds and null counts that a column index gives for each page are those of the page's rows."""
    out = shared_dir(spark)
    _t(spark, d, "orders", ["o_orderkey", "o_custkey"]).orderBy("o_orderkey").write.option("parquet.page.row.count.limit", "500").option("parquet.enable.dictionary", "false").parquet(out)
    number = lambda c: F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(c), F.lit("(..)"))), ""), 16, -10).cast("long")
    place = ["file", "row_group", "page"]
    index = metadata.page_index(spark, out).where("column = 1").select(*place, "first_row", number("min_value").alias("lo"), number("max_value").alias("hi"), "null_count")
    rows = decode.column_by_pages(spark, out, "o_custkey", "INT64")
    real = rows.groupBy(place).agg(F.min("row").alias("first"), F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"))
    real = real.withColumn("first", F.col("first") - F.min("first").over(Window.partitionBy("file", "row_group")))  # the index counts from the row group's first row
    same = [F.col(x).eqNullSafe(F.col(y)) for x, y in (("first", "first_row"), ("a", "lo"), ("b", "hi"), ("nulls", "null_count"))]
    return real.join(index, place, "full").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(~reduce(and_, same)).cast("int").alias("wrong"), (F.count("*") > 1).alias("several"))


@query("select count(*) as n_values, 'PLAIN' as encoding, 'DATA_PAGE' as type from orders")
def page_header_facts(spark, d):
    return metadata.pages(spark, _written(spark, d, dictionary_default=False)).where("column = 0").groupBy("encoding", "type").agg(F.sum("n_values").alias("n_values"))


@query("select vec_id, i - 1 as at, case when i > 1 then 1 else 0 end as rep, 3 as def, embedding[i] as value from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)", "list_levels")
def list_levels(spark, d):
    return encodings.levels(_t(spark, d, "embeddings", ["vec_id", "embedding"]), "embedding", "vec_id")


# Statistics and Bloom filters

for _name, _column in (("chunk_stats_double", "value"), ("chunk_stats_int", "user_id"), ("chunk_stats_string", "event_type")):
    query(f"select event_id // 1000 as chunk, min({_column}) as lo, max({_column}) as hi, count(*) filter (where {_column} is null) as nulls, count(*) as n_rows from events group by 1", _name)(lambda s, d, c=_column: stats.chunk_stats(_t(s, d, "events", ["event_id", c]), c, F.floor(F.col("event_id") / 1000)))


@query("select ndv, pow(2, ceil(log2(greatest(1, ceil(-8 * ndv / ln(1 - pow(0.01, 1.0 / 8)) / 256)))))::bigint as blocks from (select count(distinct o_custkey) as ndv from orders)")
def bloom_blocks(spark, d):
    n = F.count_distinct("o_custkey")
    return _t(spark, d, "orders", ["o_custkey"]).agg(n.alias("ndv")).select("ndv", stats.bloom_blocks_column(F.col("ndv"), 0.01).alias("blocks"))


# Writers: what is written is read again


def _facts(spark, out: str, wanted) -> dict[str, str]:
    """What the files' footers and page headers say of how they were written, as far as it is asked for."""
    wanted = set(wanted)
    c = metadata.chunks(spark, out)
    by_column = lambda what: F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "path", what))), " ")
    dictionary = F.when(F.col("dictionary_page_offset").isNotNull() | F.array_contains("encodings", "RLE_DICTIONARY"), "dictionary").otherwise("plain")
    bloom = F.when(F.col("bloom_filter_offset").isNotNull(), "bloom").otherwise("none")
    facts = c.agg(by_column(F.col("codec")).alias("codecs"), by_column(dictionary).alias("dictionaries"), by_column(bloom).alias("blooms")).first().asDict()
    if "rows_most" in wanted:
        facts |= metadata.row_groups(spark, out).agg(F.max("n_rows").cast("string").alias("rows_most")).first().asDict()
    if "pages" in wanted:
        facts |= metadata.pages(spark, out).where("type <> 'DICTIONARY_PAGE'").agg(F.array_join(F.array_sort(F.collect_set("type")), " ").alias("pages")).first().asDict()
    return facts


def _round_trip(name: str, table: str, columns: list[str], options: WriteOptions, **facts: str) -> None:
    """The rows that were written, each with some facts of the files beside what they ought to be."""

    @query(f"select {', '.join(columns)}, {', '.join(f'{v!r} as {k}' for k, v in facts.items())} from {table}", name)
    def run(spark, d):
        out = shared_dir(spark)
        write(_t(spark, d, table, columns), out, options)
        found = _facts(spark, out, facts)
        return spark.read.parquet(out).select(*columns, *[F.lit(found[k]).alias(k) for k in facts])


for _codec in ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw"):
    _round_trip(f"writer_codec_{_codec}", "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"], WriteOptions(codec=_codec), codecs=f"o_orderkey={_codec.upper()} o_orderpriority={_codec.upper()} o_totalprice={_codec.upper()}")
_round_trip("writer_per_column_codec", "orders", ["o_orderkey", "o_totalprice", "o_orderpriority"], WriteOptions(codec="snappy", codecs={"o_orderkey": "zstd", "o_orderpriority": "gzip"}), codecs="o_orderkey=ZSTD o_orderpriority=GZIP o_totalprice=SNAPPY")
_round_trip("writer_brotli", "orders", ["o_orderkey", "o_custkey"], WriteOptions(codec="snappy", codecs={"o_orderkey": "gzip"}, level=9, page_version=2), codecs="o_custkey=SNAPPY o_orderkey=GZIP", pages="DATA_PAGE_V2")
_round_trip("writer_v1", "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"], WriteOptions(), pages="DATA_PAGE")
_round_trip("writer_v2", "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"], WriteOptions(page_version=2), pages="DATA_PAGE_V2")
_round_trip("writer_dictionary", "lineitem", ["l_returnflag", "l_linestatus"], WriteOptions(dictionary={"l_returnflag": True}, dictionary_default=False), dictionaries="l_linestatus=plain l_returnflag=dictionary")
_round_trip("writer_row_groups", "orders", ["o_orderkey", "o_custkey"], WriteOptions(rows_per_group=1000), rows_most="1000")
_round_trip("writer_dictionary_and_bloom", "orders", ["o_orderkey", "o_custkey"], WriteOptions(dictionary={"o_custkey": True, "o_orderkey": False}, blooms={"o_orderkey": (20_000, 0.01)}, order=("o_custkey", "o_orderkey")), dictionaries="o_custkey=dictionary o_orderkey=plain", blooms="o_custkey=none o_orderkey=bloom")


@query("select doc_id, text, true as smaller from documents")
def writer_zstd_level(spark, d):
    """A high level makes smaller files than a low one."""
    outs, sizes, rows = [shared_dir(spark), shared_dir(spark)], [], _t(spark, d, "documents", ["doc_id", "text"])
    n_bytes = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    rows = evenly(rows, n_bytes).sortWithinPartitions("doc_id")  # the same pages at both levels
    for out, level in zip(outs, (1, 19), strict=True):
        write(rows, out, WriteOptions(codec="zstd", level=level, dictionary_default=False))
        sizes.append(metadata.chunks(spark, out).agg(F.sum("total_compressed_size")).first()[0] or 0)
    return spark.read.parquet(outs[1]).withColumn("smaller", F.lit(sizes[1] < sizes[0]))


for _kind, _type in (("i64", "bigint"), ("i32", "int"), ("f64", "double"), ("bool", "boolean"), ("string", "string")):
    _cast = f"cast(o_orderkey % {2 if _kind == 'bool' else 50} as {_type if _type != 'string' else 'varchar'})"
    for _codec, _dictionary, _bloom in (("uncompressed", False, False), ("zstd", False, False), ("snappy", True, False), ("snappy", False, True)):
        if _kind == "bool" and (_dictionary or _bloom):
            continue
        _how = "_".join([_codec, *["dictionary"] * _dictionary, *["bloom"] * _bloom])

        @query(f"select {_cast} as v, 'v={_codec.upper()}' as codecs, '{'v=dictionary' if _dictionary else 'v=plain'}' as dictionaries, '{'v=bloom' if _bloom else 'v=none'}' as blooms from orders", f"writer_{_kind}_{_how}")
        def _column_writer(spark, d, kind=_type, most=2 if _kind == "bool" else 50, codec=_codec, dictionary=_dictionary, bloom=_bloom):
            out = shared_dir(spark)
            v = (F.col("o_orderkey") % most).cast(kind)
            options = WriteOptions(codec=codec, dictionary_default=dictionary, blooms={"v": (20_000, 0.01)} if bloom else {})
            write(_t(spark, d, "orders", ["o_orderkey"]).select(v.alias("v")), out, options)
            found = _facts(spark, out, ())
            return spark.read.parquet(out).select("v", *[F.lit(found[k]).alias(k) for k in ("codecs", "dictionaries", "blooms")])


@query("select o_custkey, true as held, true as true_rate from orders group by 1")
def bloom_probe(spark, d):
    """Every value is held by its file's Bloom filter, and few others are. Values are dealt over files, so that each filter has the values it was sized for."""
    out, room = shared_dir(spark), 20_000
    orders = _t(spark, d, "orders", ["o_orderkey", "o_custkey"])
    n = orders.agg(F.count_distinct("o_custkey")).first()[0]
    write(orders.repartition(math.ceil(max(n, 1) / (0.8 * room)), "o_custkey"), out, WriteOptions(blooms={"o_custkey": (room, 0.01)}))
    others = codecs.hashed(pa.array(range(1 << 40, (1 << 40) + 5000), pa.int64()), "int64").to_numpy().view("u8")
    rate = blooms.held_by_chance(spark, out, others).agg(F.sum("held") / F.sum("n")).first()[0] or 0
    own = blooms.held_by_own(spark, out, "o_custkey", "INT64").groupBy(F.col("value").alias("o_custkey"))
    return own.agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held")).withColumn("true_rate", F.lit(rate < 0.02))


@query("select g as row_group, count(*) as n_rows, min(o_orderkey) as lo, max(o_orderkey) as hi from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 1000 as g from orders) group by g")
def row_group_slices(spark, d):
    rows = ordered.row_index(_t(spark, d, "orders", ["o_orderkey"]), "o_orderkey")
    return rows.groupBy(F.floor(F.col("row_index") / 1000).alias("row_group")).agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("select count(*) as n_rows from orders")
def footers_summary(spark, d):
    out = shared_dir(spark)
    write(_t(spark, d, "orders", ["o_orderkey"]), out, WriteOptions(rows_per_group=1000))
    return footers(spark, out).agg(F.sum("n_rows").alias("n_rows"))


# Batches, streams, encryption


@query("select (row_number() over (order by event_id) - 1) // 777 as batch, event_id from events")
def batches(spark, d):
    return stream.batches(_t(spark, d, "events", ["event_id"]), "event_id", 777).select("batch", "event_id")


@query("select count(*) as n, sum(user_id)::bigint as v from events")
def arrow_batches(spark, d):
    import pyarrow.compute as pc

    e = _t(spark, d, "events", ["user_id"])
    parts = stream.map_batches(e, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([pc.sum(b.column(0)).as_py()], pa.int64())], names=["n", "v"]), "n long, v long", 1000)
    return parts.agg(F.sum("n").alias("n"), F.sum("v").alias("v"))


@query("select event_id, user_id, event_type from events")
def stream_scan(spark, d):
    source = shared_dir(spark)
    _t(spark, d, "events", ["event_id", "user_id", "event_type"]).write.parquet(source)
    return stream.drain(stream.file_stream(spark, source), shared_dir(spark), shared_dir(spark))


@query("select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n from events group by all")
def stream_windowed(spark, d):
    """Counts of a stream in windows of a day, with late rows allowed for."""
    source, out = shared_dir(spark), f"windows_{uuid.uuid4().hex}"
    _t(spark, d, "events", ["ts", "event_type"]).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    counts = stream.windowed_counts(stream.file_stream(spark, source), "ts", "1 day", "400 days", "event_type")
    counts.writeStream.format("memory").queryName(out).outputMode("complete").option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", F.col("count").alias("n"))


@query("select o_orderkey, o_orderpriority, octet_length(encode(o_orderpriority)) + 32 as used from orders")
def module_roundtrip(spark, d):
    """Values framed as modules of a page each, with counted nonces, and opened again."""
    context = crypto.ModuleContext(KEY, b"file", b"tab", 0, 1, crypto.CountedNonces(b"nnnn"))
    rows = _t(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    sealed = rows.select("o_orderkey", crypto.encrypt_module(F.col("o_orderpriority"), context, "data_page", 2, F.col("o_orderkey")).alias("m"))
    opened = sealed.select("o_orderkey", crypto.decrypt_module(F.col("m"), context, "data_page", 2).alias("p"))
    return opened.select("o_orderkey", F.col("p.plain").cast("string").alias("o_orderpriority"), F.col("p.used").alias("used"))


@query("select o_orderkey, o_orderpriority from orders")
def aes_roundtrip(spark, d):
    sealed = _t(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).withColumn("o_orderpriority", crypto.encrypt(F.col("o_orderpriority"), KEY, AAD))
    return sealed.withColumn("o_orderpriority", crypto.decrypt(F.col("o_orderpriority"), KEY, AAD).cast("string"))


@query("select o_orderkey, o_orderpriority as fresh, null::varchar as old from orders")
def key_rotation(spark, d):
    new = KEY[::-1]
    sealed = _t(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).withColumn("o_orderpriority", crypto.encrypt(F.col("o_orderpriority"), KEY, AAD))
    turned = crypto.rotate(sealed, "o_orderpriority", KEY, new, AAD)
    return turned.select("o_orderkey", crypto.decrypt(F.col("o_orderpriority"), new, AAD).cast("string").alias("fresh"), crypto.try_decrypt(F.col("o_orderpriority"), KEY, AAD).cast("string").alias("old"))
