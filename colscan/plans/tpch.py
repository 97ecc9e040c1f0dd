"""Whole plans over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import scan


def promo_share(spark: SparkSession, sf_dir: str, first: str = "1995-09-01", after: str = "1995-10-01") -> DataFrame:
    """Promotion share of revenue in a span of ship dates: the filter and four columns reach the lineitem scan."""
    lineitem = scan(spark, f"{sf_dir}/lineitem.parquet", ["l_partkey", "l_extendedprice", "l_discount", "l_shipdate"])
    part = scan(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_type"])
    shipped = lineitem.where(F.expr(f"l_shipdate >= timestamp_ntz '{first}' and l_shipdate < timestamp_ntz '{after}'"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    promo = F.when(F.col("p_type").startswith("PROMO"), revenue).otherwise(0.0)
    return shipped.join(part, F.col("l_partkey") == F.col("p_partkey")).agg(F.round(100 * F.sum(promo) / F.sum(revenue), 6).alias("promo_revenue"))
