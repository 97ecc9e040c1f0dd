"""Dictionary encoding as relations: a dictionary, codes, and predicates decided once for each entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import row_index

#: Entries of a dictionary that is broadcast to its codes' rows.
ENTRIES = 100_000


def dictionary(df: DataFrame, column: str, key: str) -> DataFrame:
    """(code, value, first): the distinct values in order of their first row; nulls have no code.

    Only the distinct values are put in order, not the rows: up to ``ENTRIES`` of them in one task.
    """
    return entries(df, column, key)[0]


def entries(df: DataFrame, column: str, key: str) -> tuple[DataFrame, bool]:
    """(``dictionary``, whether it has at most ``ENTRIES`` entries); one job finds out."""
    found = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(key).alias("first"))
    few = found.limit(ENTRIES + 1).count() <= ENTRIES
    placed = found.withColumn("code", F.row_number().over(Window.orderBy("first")) - 1) if few else row_index(found, "first", "code")
    return placed.select(F.col("code").cast("long").alias("code"), "value", "first"), few


def small_enough(entries: DataFrame) -> DataFrame:
    """``entries``, to be broadcast if they are no more than ``ENTRIES``; else both sides are shuffled, and AQE splits
    what is frequent."""
    return F.broadcast(entries) if entries.limit(ENTRIES + 1).count() <= ENTRIES else entries


def encode(df: DataFrame, column: str, key: str, small: bool = False) -> DataFrame:
    """(key, code). ``small`` gives 16-bit codes and fails over 256 distinct values."""
    codes, few = entries(df, column, key)
    if small:
        if not few or codes.limit(257).count() > 256:
            raise ValueError("over 256 distinct values")
        codes = codes.withColumn("code", F.col("code").cast("smallint"))
    codes = codes.select("code", "value")
    codes = F.broadcast(codes) if few else codes
    return df.join(codes, df[column] == codes["value"], "left").select(df[key], "code")


def decode(codes: DataFrame, entries: DataFrame, key: str, name: str) -> DataFrame:
    """Codes back to values; a code that the dictionary lacks is an error."""
    out = codes.join(small_enough(entries.select("code", F.col("value").alias(name))), "code", "left")
    return out.withColumn("__ok", F.assert_true(F.col("code").isNull() | F.col(name).isNotNull(), F.lit("code out of range"))).where("__ok is null").select(key, name)


def by_dictionary(df: DataFrame, column: str, predicate: Callable[[Column], Column], expensive: bool = False) -> DataFrame:
    """Rows whose value passes. An ``expensive`` predicate runs once for each distinct value; any other is pushed to the scan,
    where Parquet's own dictionaries and statistics decide."""
    if not expensive:
        return df.where(predicate(F.col(column)))
    keep = df.select(F.col(column).alias("__value")).distinct().where(predicate(F.col("__value")))
    return df.join(keep, df[column] == keep["__value"], "left_semi")


def bit_width(n: Column) -> Column:
    """Bits of a code among ``n`` values: 0 for one value."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
