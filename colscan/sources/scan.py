"""Parquet scans by name or ordinal, footers, and logical row groups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .metadata import File, file_list

FOOTER = "file string, row_group int, ordinal int, name string, kind string, codec string, encodings string, n_rows long, n_values long, lo string, hi string, nulls long, packed_bytes long, bytes long, row_base long"


def scan(spark: SparkSession, path: str, columns: list[str | int] | None = None, row_groups: list[int] | None = None, row_index: bool = False) -> DataFrame:
    """Columns (names or ordinals) of a Parquet path, of some row groups only if asked for.

    A projection reaches the scan. Of row groups that are asked for, and only of these, the columns' bytes are read: a
    task takes some of them, which the footers name.
    """
    df = spark.read.parquet(path)
    names = [df.columns[c] if isinstance(c, int) else c for c in columns] if columns is not None else df.columns
    index = F.col("_metadata.row_index")
    if row_groups is None:
        return df.select(*names, *([index.alias("row_index")] if row_index else []))
    schema = df.select(*names, F.lit(0).cast("long").alias("row_index")).schema
    kinds = to_arrow_schema(schema)
    wanted = footers(spark, path).where(F.col("row_group").isin(row_groups) & (F.col("ordinal") == 0)).select("file", "row_group", "row_base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for file, group, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with File(file) as f:
                    for part in pq.ParquetFile(f.handle).iter_batches(row_groups=[group], columns=names):
                        columns = [part.column(n) for n in names] + [pa.array(range(base, base + part.num_rows), pa.int64())]
                        yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)
                        base += part.num_rows

    out = wanted.mapInArrow(read, schema)
    return out if row_index else out.select(*names)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, row group and column chunk: codec, encodings, counts, bounds, sizes.

    Files are listed by Spark and their footers read in tasks, through pyarrow's file systems.
    """
    files = file_list(spark, path).select("file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for file in b["file"]:
                with File(file) as f:
                    meta = pq.read_metadata(f.handle)
                base = 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        k = group.column(c)
                        s = k.statistics
                        bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        out.append((file, g, c, k.path_in_schema, k.physical_type, k.compression, ",".join(sorted(set(k.encodings))), group.num_rows, k.num_values, *bounds, s.null_count if s is not None else None, k.total_compressed_size, k.total_uncompressed_size, base))
                    base += group.num_rows
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FOOTER.split(", ")])

    return files.mapInPandas(read, FOOTER)
