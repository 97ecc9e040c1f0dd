"""Adaptive filtering: probe the selectivity, then give a mask or the values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .dictionary import dictionary, small_enough

#: The share above which values are given, and the pages that are probed.
THRESHOLD, PROBE_PAGES = 0.10, 3


@dataclass
class Probe:
    pages: int
    rows_in: int
    rows_passed: int
    threshold: float = THRESHOLD

    @property
    def selectivity(self) -> float:
        return self.rows_passed / self.rows_in if self.rows_in else 0.0

    @property
    def dispatch(self) -> str:
        return "values" if self.selectivity > self.threshold else "mask"


@dataclass
class Filtered:
    """Either ``rows`` (key, mask) or ``rows`` (key, value), as ``probe.dispatch`` says; ``values()`` is always the latter."""

    probe: Probe
    rows: DataFrame
    source: DataFrame
    predicate: Column
    key: str
    column: str

    def values(self) -> DataFrame:
        return self.source.where(self.predicate).select(self.key, self.column)


def adaptive_filter(df: DataFrame, column: str, predicate: Callable[[Column], Column], key: str, page_rows: int = 8192, threshold: float = THRESHOLD, probe_pages: int = PROBE_PAGES, telemetry: Callable[[Probe], None] | None = None) -> Filtered:
    """Probes the first pages (rows of lowest ``key``), reports once, then plans one lazy result.

    The probe looks below a key that is sure to be beyond the pages if keys are dense, so that the scan prunes; only where
    it finds too few rows there does it order the whole table by key.
    """
    test = F.coalesce(predicate(F.col(column)), F.lit(False))
    need = page_rows * probe_pages

    def probed(rows: DataFrame):
        return rows.select(key, column).orderBy(key).limit(need).agg(F.count("*").alias("n"), F.count_if(test).alias("hit")).first()

    r = None
    if isinstance(df.schema[key].dataType, IntegralType):
        lowest = df.agg(F.min(key)).first()[0]
        r = probed(df.where(F.col(key) < lowest + 4 * need)) if lowest is not None else None
    if r is None or r.n < need:
        r = probed(df)
    probe = Probe(-(-r.n // page_rows), r.n, r.hit, threshold)
    if telemetry:
        telemetry(probe)
    rows = df.where(test).select(key, column) if probe.dispatch == "values" else df.select(key, test.alias("mask"))
    return Filtered(probe, rows, df, test, key, column)


@dataclass
class DictionaryFiltered:
    """What an adaptive filter gives: ``probe``, and ``rows`` as values, as a mask of row keys, or as codes of ``dictionary``."""

    probe: Probe
    kind: str
    rows: DataFrame
    dictionary: DataFrame


def adaptive_dictionary_filter(df: DataFrame, column: str, predicate: Callable[[Column], Column], key: str, page_rows: int = 8192, threshold: float = THRESHOLD, probe_pages: int = PROBE_PAGES, codes: bool = False) -> DictionaryFiltered:
    """An adaptive filter whose predicate runs once for each distinct value.

    Entries that pass are found first; the probe and the rows then look values up. ``codes`` gives (key, code) of passing
    rows instead of values, so that long values do not move.
    """
    entries = dictionary(df, column, key)
    test = F.coalesce(predicate(F.col("value")), F.lit(False))
    keep = small_enough(entries.withColumn("__pass", test))
    known = df.join(keep, df[column] == keep["value"], "left").select(df[key], df[column], F.col("code"), F.coalesce("__pass", F.lit(False)).alias("__pass"))
    probe = adaptive_filter(known.select(key, "__pass"), "__pass", lambda c: c, key, page_rows, threshold, probe_pages).probe
    if probe.dispatch == "mask":
        return DictionaryFiltered(probe, "mask", known.select(key, F.col("__pass").alias("mask")), entries)
    kept = known.where("__pass")
    return DictionaryFiltered(probe, "codes" if codes else "values", kept.select(key, "code" if codes else column), entries)
