"""Chunk statistics and Bloom filter sizing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def chunk_stats(df: DataFrame, column: str, chunk: Column | None = None) -> DataFrame:
    """(chunk, lo, hi, nulls, n_rows): NaN is left out of the bounds, a zero lower bound is -0.0 and an upper one 0.0."""
    value = F.col(column)
    floats = isinstance(df.schema[column].dataType, DoubleType | FloatType)
    if floats:
        value = F.when(~F.isnan(value), value)
    lo, hi = F.min(value), F.max(value)
    if floats:
        lo, hi = F.when(lo == 0, F.lit(-0.0)).otherwise(lo), F.when(hi == 0, F.lit(0.0)).otherwise(hi)
    return df.groupBy((chunk if chunk is not None else F.lit(0)).alias("chunk")).agg(lo.alias("lo"), hi.alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls"), F.count("*").alias("n_rows"))


def clamped(fpp: float) -> float:
    """A false-positive rate that a filter can have."""
    return min(0.5, max(1e-12, fpp))


def bloom_blocks(ndv: int, fpp: float) -> int:
    """256-bit blocks of a split-block Bloom filter, a power of two: m = -8 n / ln(1 - p^(1/8)) bits; one without values."""
    bits = -8 * max(1, ndv) / math.log(1 - clamped(fpp) ** (1 / 8))
    return 1 << max(0, math.ceil(math.log2(max(1.0, math.ceil(bits / 256)))))


def bloom_blocks_column(ndv: Column, fpp: float) -> Column:
    bits = -8 * F.greatest(ndv, F.lit(1)) / F.log(F.lit(1 - clamped(fpp) ** (1 / 8)))
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.ceil(bits / 256))))).cast("long")
