"""Row masks, late materialisation, zone maps and range pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import row_index


def with_mask(df: DataFrame, predicate: Column, name: str = "mask") -> DataFrame:
    """``df`` with a boolean mask; a null predicate is false."""
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))


def gather(df: DataFrame, predicate: Column, columns: list[str]) -> DataFrame:
    """Late-materialised projection: ``columns`` of the rows that pass."""
    return df.where(predicate).select(*columns)


def gather_by(df: DataFrame, mask: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The same for a mask made elsewhere: the keys of ``mask`` whose bit is set. A key that stands there several times is set
    if any of its bits is."""
    return df.join(mask.where("mask").select(key), key, "left_semi").select(*columns)


def count_matching(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def pack_mask(df: DataFrame, index: str, mask: str = "mask") -> DataFrame:
    """(bucket, bitmap, set_bits): the mask as bitmaps, bit i of a bucket for its i-th row, lowest bit first."""
    set_ = df.where(mask)
    at = F.col(index) + 1
    return set_.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).withColumn("set_bits", F.bitmap_count("bitmap"))


def popcount_prefix(df: DataFrame, index: str, n: int, mask: str = "mask", name: str = "n") -> DataFrame:
    """Set bits among the first ``n`` rows."""
    return df.agg(F.count_if(F.col(mask) & (F.col(index) < n)).alias(name))


def check_range(lo, hi) -> None:
    if lo > hi:
        raise ValueError(f"empty range: {lo} > {hi}")


def between(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """Rows in the closed range; pushed to the Parquet scan, where statistics and page indexes prune."""
    check_range(lo, hi)
    return df.where(F.col(column).between(lo, hi))


def zone_map(df: DataFrame, column: str, key: str, page_rows: int) -> DataFrame:
    """(page, lo, hi, rows, nulls) for logical pages of ``page_rows`` rows in order of ``key``."""
    return zones(row_index(df, key).withColumn("page", F.floor(F.col("row_index") / page_rows)), column)


def zones(pages: DataFrame, column: str) -> DataFrame:
    """Bounds and counts of rows that have a page."""
    return pages.groupBy("page").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("nulls"))


def page_keep_mask(zones: DataFrame, lo, hi) -> DataFrame:
    """``zones`` with keep: not all null, and overlapping the closed range."""
    check_range(lo, hi)
    return zones.withColumn("keep", F.coalesce((F.col("hi") >= lo) & (F.col("lo") <= hi), F.lit(False)))


def pruned_superset(df: DataFrame, column: str, key: str, lo, hi, page_rows: int) -> DataFrame:
    """All rows of the pages that may hold a value in range: a superset of ``between``."""
    rows = row_index(df, key).withColumn("page", F.floor(F.col("row_index") / page_rows))
    keep = page_keep_mask(zones(rows, column), lo, hi).where("keep").select("page")
    return rows.join(keep, "page", "left_semi")
