"""Queries of the training-data operators and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import leaks, leaks_sql
from .fmindex import dedup_words, words_sql
from .forest import judged
from .mixing import plan
from .ordinal import grades, scores, train
from .pii import personal_data
from .sharding import shards, shards_sql
from .simhash import near_duplicates
from .suffixlog import bytes_sql, dedup_bytes
from .urlfilter import filtered


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(table(spark, sf_dir, "documents")).drop("kept")


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = table(spark, sf_dir, "labels").select("doc_id", grades(F.col("quality"), F.col("toxic")).alias("grade"))
    return scores(docs, train(docs, rated))


def op5_suffixlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversize")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_fmindex": words_sql(), "op5_suffixlog": bytes_sql(), "op6_sharding": shards_sql(), "op7_decontaminate": leaks_sql()}
