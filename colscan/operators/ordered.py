"""Row order as a relation: running sums, previous values and row numbers without a single-task window.

Rows are cut into blocks of consecutive integer keys, about ``ROWS`` rows each: the keys' extent and number are looked up
first, so sparse keys have as few blocks as dense ones. What a window needs from other blocks (a sum, a last value) is
aggregated to one row for each block. These rows are put in order the same way, in blocks of blocks, until ``ONE_TASK`` or
fewer are left for one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on average, blocks of a block of blocks, and rows that one task orders.
ROWS, UPPER, ONE_TASK = 1 << 16, 1 << 12, 1 << 16


def layout(df: DataFrame, key: str) -> tuple[int, int]:
    """(keys of a block, number of blocks) for the rows of ``df``; one small job."""
    n, lo, hi = df.agg(F.count(key), F.min(key), F.max(key)).first()
    if not n:
        return 1, 1
    span = max(1, math.ceil((int(hi) - int(lo) + 1) / max(1, math.ceil(n / ROWS))))
    return span, int(hi) // span - int(lo) // span + 1


def _block(key: str, span: int) -> Column:
    # integers only: a quotient of doubles would put large keys into a wrong block
    k = F.col(key).cast("long")
    return F.expr(f"(`{key}` - pmod(`{key}`, {span}L)) div {span}L").cast("long") if span > 1 else k


def running_sum(df: DataFrame, value: Column, key: str, name: str, span: int | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one in order of the unique ``key``."""
    if span is None:
        span, blocks = layout(df, key)
    rows = df.withColumns({"__block": _block(key, span), "__value": value})
    sums = rows.groupBy("__block").agg(F.sum("__value").alias("__sum"))
    if blocks is None or blocks <= ONE_TASK:
        before = F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
        base = sums.select("__block", F.coalesce(before, F.lit(0)).alias("__base"))
    else:
        upper = running_sum(sums.withColumnsRenamed({"__block": "__b", "__sum": "__s"}), F.col("__s"), "__b", "__upto", UPPER, blocks // UPPER + 2)
        base = upper.select(F.col("__b").alias("__block"), (F.col("__upto") - F.col("__s")).alias("__base"))
    inner = F.sum("__value").over(Window.partitionBy("__block").orderBy(key))
    return rows.withColumn("__inner", inner).join(base, "__block").withColumn(name, F.col("__inner") + F.col("__base")).drop("__block", "__value", "__inner", "__base")


def row_index(df: DataFrame, key: str, name: str = "row_index", span: int | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in order of the unique ``key``."""
    return running_sum(df, F.lit(1), key, name, span, blocks).withColumn(name, F.col(name) - 1)


def previous(df: DataFrame, value: str, key: str, name: str, span: int | None = None, blocks: int | None = None) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in order of the unique ``key``; null in the first row."""
    if span is None:
        span, blocks = layout(df, key)
    rows = df.withColumn("__block", _block(key, span))
    last = rows.groupBy("__block").agg(F.max_by(F.struct(value), key).alias("__last"))
    if blocks is None or blocks <= ONE_TASK:
        last = last.select("__block", F.lag("__last").over(Window.orderBy("__block")).alias("__last"))
    else:
        upper = previous(last.withColumnsRenamed({"__block": "__b", "__last": "__l"}), "__l", "__b", "__before", UPPER, blocks // UPPER + 2)
        last = upper.select(F.col("__b").alias("__block"), F.col("__before").alias("__last"))
    w = Window.partitionBy("__block").orderBy(key)
    rows = rows.withColumns({"__first": F.row_number().over(w) == 1, "__lag": F.lag(value).over(w)})
    return rows.join(last, "__block").withColumn(name, F.when(F.col("__first"), F.col(f"__last.{value}")).otherwise(F.col("__lag"))).drop("__block", "__first", "__lag", "__last")
