"""Shared pieces: reading tables, cutting lineage, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscan.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_all(tables: Iterable[DataFrame]) -> None:
    for t in tables:
        drop_staged(t)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, without a copy, so that a worker holds few texts as objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def filtered_rows(docs: DataFrame, keep) -> DataFrame:
    """``docs`` through ``keep``, which gives batches of some of the rows; columns go by place, so they may have any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def text_of(name: str) -> Column:
    """A text column as string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows at ``each`` rows, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def connected(edges: DataFrame) -> DataFrame:
    """Roots of the connected components of ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder, until a round
    changes nothing. Nodes that stand in no edge do not appear. The minima are taken with map-side
    aggregation, and the join that hands them back is a plain equi-join that AQE can split, so a
    node with very many neighbours is no single task.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).where("a <> b").distinct()
        after = staged(small)
        drop_staged(now)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        mark = tuple(seen)
