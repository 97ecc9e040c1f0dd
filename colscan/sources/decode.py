"""A column read through its pages' bytes: for files whose encodings Spark's reader lacks, and to look into pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.pages import decode_pages
from ..functions.thrift import FormatError
from .metadata import File, _table, chunk_bytes, leaves

#: Spark types of physical ones; INT96 gives nanoseconds since 1970.
SPARK_TYPES = {"BOOLEAN": "boolean", "INT32": "int", "INT64": "bigint", "INT96": "bigint", "FLOAT": "float", "DOUBLE": "double", "BYTE_ARRAY": "binary", "FIXED_LEN_BYTE_ARRAY": "binary"}
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}


#: Tasks for each core. They take row groups one after the other, so their number need not grow with the files.
TASKS = 3
_CHUNK = "codec:string,data_page_offset:long,dictionary_page_offset:long,total_compressed_size:long,entry_base:long,max_def:int,max_rep:int,type_length:int"


def _row_groups(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """(file, row_group, row_base, chunks): where the columns' chunks are and what decoding them takes, dealt out over tasks."""

    def rows(f: File) -> Iterator[dict]:
        meta, base, nodes = f.metadata(), 0, []
        for column, kind in columns.items():
            node = next((n for n in leaves(meta["schema"]) if n["column"] is not None and n["path"] == column), None)
            if node is None or node["type"] != kind:
                raise ValueError(f"{f.name} has no {kind} column {column}")
            nodes.append(node)
        entries = [0] * len(nodes)
        for g, group in enumerate(meta["row_groups"]):
            found = []
            for i, node in enumerate(nodes):
                m = group["columns"][node["column"]]["meta_data"]
                places = {k: m.get(k) for k in ("data_page_offset", "dictionary_page_offset", "total_compressed_size")}
                found.append(places | {"codec": str(m["codec"]), "entry_base": entries[i], "max_def": node["max_def"], "max_rep": node["max_rep"], "type_length": node.get("type_length") or 0})
                entries[i] += m["num_values"]
            yield {"row_group": g, "row_base": base, "chunks": found}
            base += group["num_rows"]

    found = _table(spark, path, f"file string, row_group int, row_base long, chunks array<struct<{_CHUNK}>>", rows)
    return found.repartition(TASKS * spark.sparkContext.defaultParallelism, "file", "row_group").sortWithinPartitions("file", "row_group")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[File, dict]]:
    """Each row with its file, which stays open while rows of the same one come."""
    f, given = None, None
    try:
        for b in batches:
            for row in b.to_pylist():
                if given != row["file"]:
                    if f is not None:
                        f.__exit__()
                    f, given = File(row["file"]), row["file"]
                yield f, row
    finally:
        if f is not None:
            f.__exit__()


def _pages(f: File, chunk: dict, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(repetition levels, definition levels, values with nulls in their places) of each page of a chunk."""
    arrow = _ARROW[SPARK_TYPES[kind]]
    for rep, define, values in decode_pages(chunk_bytes(f, chunk)[1], chunk | {"type": kind}, chunk["max_def"], chunk["max_rep"], chunk["type_length"]):
        there, found = define == chunk["max_def"], pa.array(values, arrow)
        yield rep, define, found if there.all() else found.take(pa.array(np.cumsum(there) - 1, mask=~there))


def column_by_pages(spark: SparkSession, path: str, column: str, kind: str) -> DataFrame:
    """(file, row, entry, rep, def, value, row_group, page) of every entry of one leaf column, which has the physical type ``kind`` in all files.

    A null has a definition level below the highest and no value; of a list column an entry that starts a row has
    repetition level 0; ``row`` numbers the rows of a file, ``entry`` the entries and ``page`` the data pages of a row group.
    Row groups are decoded in tasks, page by page. Spark takes the size of the files' list for that of the entries, so joins
    are told not to broadcast them.
    """

    def run(batches):
        for f, group in _opened(batches):
            chunk = group["chunks"][0]
            row, entry = group["row_base"] - 1, chunk["entry_base"]
            for page, (rep, define, values) in enumerate(_pages(f, chunk, kind)):
                n, rows = len(values), np.cumsum(rep == 0) + row
                yield pa.RecordBatch.from_arrays([pa.repeat(group["file"], n), pa.array(rows), pa.array(np.arange(entry, entry + n)), pa.array(rep.astype(np.int32)), pa.array(define.astype(np.int32)), values, pa.repeat(pa.scalar(group["row_group"], pa.int32()), n), pa.repeat(pa.scalar(page, pa.int32()), n)], names=["file", "row", "entry", "rep", "def", "value", "row_group", "page"])
                row, entry = (rows[-1] if n else row), entry + n

    return _row_groups(spark, path, {column: kind}).mapInArrow(run, f"file string, row long, entry long, rep int, def int, value {SPARK_TYPES[kind]}, row_group int, page int").hint("merge")


def columns_by_pages(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """The rows of some columns without lists (name: physical type), each decoded as in ``column_by_pages``.

    A task reads the chunks of a row group side by side, so rows need no join; it holds a page of each column beside the
    chunks' bytes.
    """
    names = list(columns)

    def run(batches):
        for f, group in _opened(batches):
            if any(c["max_rep"] for c in group["chunks"]):
                raise ValueError(f"lists among {', '.join(names)} of {f.name}")
            streams = [_pages(f, c, kind) for c, kind in zip(group["chunks"], columns.values(), strict=True)]
            held: list[pa.Array | None] = [pa.array([])] * len(names)
            while True:
                for i, stream in enumerate(streams):
                    while held[i] is not None and not len(held[i]):
                        held[i] = next((values for _, _, values in stream), None)
                if all(h is None for h in held):
                    break
                if any(h is None for h in held):
                    raise FormatError(f"chunks of different lengths in row group {group['row_group']} of {f.name}")
                n = min(map(len, held))
                yield pa.RecordBatch.from_arrays([h.slice(0, n) for h in held], names=names)
                held = [h.slice(n) for h in held]

    return _row_groups(spark, path, columns).mapInArrow(run, ", ".join(f"`{c}` {SPARK_TYPES[kind]}" for c, kind in columns.items())).hint("merge")
