"""Batched and streaming reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import row_index


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with batch: consecutive runs of ``size`` rows in order of ``key``; the last may be shorter."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return row_index(df, key).withColumn("batch", F.floor(F.col("row_index") / size)).drop("row_index")


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size: int) -> DataFrame:
    """``f`` over the Arrow batches of ``df``, none over ``size`` rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, size):
                yield f(b.slice(at, size))

    return df.mapInArrow(run, schema)


def file_stream(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """Parquet files under ``path`` as a stream, some files a micro-batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Everything that the stream has now, written once to Parquet under ``out`` and read again."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts in tumbling event-time windows, with rows up to ``late`` behind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()
