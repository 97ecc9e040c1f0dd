"""Bloom filters of files, probed in tasks: each value by the filter of its own chunk, absent ones by every filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import codecs
from .decode import SPARK_TYPES, column_by_pages
from .metadata import File, bloom_filters, chunk_bloom, leaves


def held_by_own(spark: SparkSession, path: str, column: str, kind: str) -> DataFrame:
    """(value, held) of every entry of a leaf column of physical type ``kind``: whether its chunk's filter holds it.

    Nulls, which no filter has, count as held; nothing is known (null) of the values of a chunk without a filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, groups, n, at, bloom = None, [], 0, None, None
        for b in batches:
            files, places = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            held = np.zeros(b.num_rows, object)
            hashes = codecs.hashed(b.column(2), kind.lower()).fill_null(0).to_numpy().view("u8")
            keys = files.indices.to_numpy().astype(np.int64) << 32 | places
            for key in np.unique(keys).tolist():
                file, group = files.dictionary[key >> 32].as_py(), key & 0xFFFFFFFF
                if (file, group) != at:
                    with File(file) as f:
                        if file != name:
                            meta = f.metadata()
                            name, groups = file, meta["row_groups"]
                            n = next(x["column"] for x in leaves(meta["schema"]) if x["column"] is not None and x["path"] == column)
                        found = chunk_bloom(f, groups[group]["columns"][n]["meta_data"])
                    at, bloom = (file, group), found and codecs.BlockBloom.from_bytes(found[1])
                mine = keys == key
                held[mine] = bloom.has(hashes[mine]) if bloom else None
            held[b.column(2).is_null().to_numpy(zero_copy_only=False)] = True
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(held, pa.bool_())], names=["value", "held"])

    return column_by_pages(spark, path, column, kind).select("file", "row_group", "value").mapInArrow(run, f"value {SPARK_TYPES[kind]}, held boolean")


def held_by_chance(spark: SparkSession, path: str, hashes: np.ndarray) -> DataFrame:
    """(file, row_group, column, n, held): how many of ``n`` hashes, of values that no file has, each filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [int(codecs.BlockBloom.from_bytes(x).has(hashes).sum()) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(hashes)] * len(held), pa.int64()), pa.array(held, pa.int64())], names=["file", "row_group", "column", "n", "held"])

    return bloom_filters(spark, path).select("file", "row_group", "column", "filter").mapInArrow(run, "file string, row_group int, column int, n long, held long")
