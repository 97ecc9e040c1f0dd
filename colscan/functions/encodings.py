"""Column encodings in relational form: runs, deltas, shared prefixes, offsets and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import layout, previous, row_index, running_sum


def runs(df: DataFrame, column: str, key: str) -> DataFrame:
    """(run, value, n): maximal runs of equal values in order of ``key``; nulls equal nulls."""
    at = layout(df, key)
    rows = previous(df.select(key, column, F.struct(column).alias("__own")), "__own", key, "__before", *at)
    starts = F.when(F.col("__before").isNull() | ~F.col(column).eqNullSafe(F.col(f"__before.{column}")), 1).otherwise(0)
    return running_sum(rows.select(key, column, starts.alias("__start")), F.col("__start"), key, "run", *at).groupBy("run").agg(F.first(column).alias("value"), F.count("*").alias("n"))


def expand(run_table: DataFrame) -> DataFrame:
    """Runs back to rows: (run, value, at)."""
    return run_table.select("run", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("at"))


def deltas(df: DataFrame, column: str, key: str, at: tuple[int, int] | None = None) -> DataFrame:
    """(key, delta): the first value itself, then differences."""
    return previous(df.select(key, column), column, key, "__before", *(at or layout(df, key))).select(key, (F.col(column) - F.coalesce("__before", F.lit(0))).alias("delta"))


def undelta(encoded: DataFrame, key: str, name: str) -> DataFrame:
    return running_sum(encoded, F.col("delta"), key, name).select(key, name)


def delta_blocks(df: DataFrame, column: str, key: str, size: int = 128) -> DataFrame:
    """(block, min_delta, max_bits): the least difference of each block of ``size`` and the bits of the others over it."""
    at = layout(df, key)
    rows = row_index(deltas(df, column, key, at), key, "row_index", *at).where("row_index > 0").withColumn("block", F.floor((F.col("row_index") - 1) / size))
    out = rows.groupBy("block").agg(F.min("delta").alias("min_delta"), F.max("delta").alias("__max"))
    spread = F.col("__max") - F.col("min_delta")
    return out.select("block", "min_delta", F.when(spread == 0, 0).otherwise(F.length(F.bin(spread))).alias("max_bits"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix in characters."""
    # Bisected: 31 steps suffice for any string, and stop changing once both ends meet.
    n = F.least(F.length(a), F.length(b))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        same = F.substring(a, F.lit(1), mid) == F.substring(b, F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(F.greatest(s["lo"], mid - 1)).alias("hi"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda s: s["lo"])
    return F.when(a.isNull() | b.isNull(), 0).otherwise(found)


def prefixes(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, prefix, suffix): characters shared with the value before, and the rest."""
    rows = previous(df.select(key, column), column, key, "__before").withColumn("prefix", common_prefix(F.col("__before"), F.col(column)))
    return rows.select(key, "prefix", F.expr(f"substring(`{column}`, prefix + 1)").alias("suffix"))


def offsets(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, begin, end): place of each value's bytes in the column's concatenation."""
    n = F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    sizes = df.select(key, n.alias("__n"))  # the bytes themselves do not move
    return running_sum(sizes, F.col("__n"), key, "end_").select(key, (F.col("end_") - F.col("__n")).alias("begin_offset"), F.col("end_").alias("end_offset"))


def masked_offsets(df: DataFrame, column: str, key: str, mask: Column) -> DataFrame:
    """``offsets`` of the rows that pass, as if only they were there; a null mask is false."""
    return offsets(df.where(mask).select(key, column), column, key)


def levels(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, rep, def, value) of a list column: rep 0 starts a list; def 0 null list, 1 empty, 2 null element, 3 value."""
    rows = df.select(key, F.col(column).isNull().alias("__none"), F.posexplode_outer(column).alias("__pos", "value"))
    defined = F.when(F.col("__none"), 0).when(F.col("__pos").isNull(), 1).when(F.col("value").isNull(), 2).otherwise(3)
    return rows.select(key, F.coalesce(F.col("__pos"), F.lit(0)).cast("long").alias("at"), F.when(F.col("__pos") > 0, 1).otherwise(0).alias("rep"), defined.alias("def"), "value")
