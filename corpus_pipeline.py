"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscan.llm.common import drop_staged, quoted, staged, table
from colscan.llm.decontaminate import clean
from colscan.llm.mixing import in_order, mixed
from colscan.llm.ordinal import grades, select, train
from colscan.llm.sharding import shards
from colscan.llm.simhash import keep_one


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier grades as good and not toxic."""
    rated = table(spark, sf_dir, "labels").select("doc_id", grades(F.col("quality"), F.col("toxic")).alias("grade"))
    return select(docs, train(docs, rated))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources repeated up to the limit, in the mixed order of blocks and ranks.

    The stage's columns are those of documents, so the order is that of the rows in the written files.
    """
    return in_order(mixed(docs), docs.count()).select(*[quoted(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard."""
    return shards(docs)


STAGES = [("quality classifier", classify), ("near duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and deleted when the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitting and fingerprints have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
