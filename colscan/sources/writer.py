"""Parquet writing with options for the table and for single columns."""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SPARK_CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4_raw")


@dataclass
class WriteOptions:
    codec: str = "snappy"
    level: int | None = None
    codecs: dict[str, str] = field(default_factory=dict)
    page_version: int = 1
    rows_per_group: int | None = None
    dictionary: dict[str, bool] = field(default_factory=dict)
    dictionary_default: bool = True
    blooms: dict[str, tuple[int, float]] = field(default_factory=dict)
    #: Rows are put in order of these columns. Spark's writer keeps a dictionary only if it saves bytes on a chunk's first page, which it does where equal values stand together.
    order: tuple[str, ...] = ()

    def spark(self) -> dict[str, str]:
        """Options of Spark's own writer."""
        out = {"compression": self.codec, "parquet.writer.version": f"v{self.page_version}", "parquet.enable.dictionary": str(self.dictionary_default).lower()}
        if self.level is not None:
            out["parquet.compression.codec.zstd.level"] = str(self.level)
        if self.rows_per_group:
            out["parquet.block.row.count.limit"] = str(self.rows_per_group)
        # A chunk whose values are all in its dictionary gets no Bloom filter, so a column with one has none unless told.
        out |= {f"parquet.enable.dictionary#{c}": str(v).lower() for c, v in (dict.fromkeys(self.blooms, False) | self.dictionary).items()}
        for c, (ndv, fpp) in self.blooms.items():
            out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(ndv), f"parquet.bloom.filter.fpp#{c}": str(fpp)}
        return out


#: Bytes of rows that a task takes where compressing them is slow, and those below which it would only make small pages.
TASK_BYTES, LEAST_BYTES = 16 << 20, 1 << 20


def evenly(df: DataFrame, n_bytes: int) -> DataFrame:
    """The rows, ``n_bytes`` in all, dealt evenly over tasks, of which each core has three at least if there is enough for them.

    Spark reads a row group in one task, so tables of few or uneven ones leave cores idle while the largest is compressed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(n_bytes / TASK_BYTES), min(3 * cores, n_bytes // LEAST_BYTES)))


#: Modes of writing.
MODES = ("append", "overwrite", "ignore", "errorifexists", "error")


def write(df: DataFrame, path: str, options: WriteOptions | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    """Writes ``df``. Codecs for single columns, and brotli, go through pyarrow, one file for each partition.

    The pyarrow way writes to file systems that pyarrow reaches and has no Bloom filters. Every job has file names of its
    own. A task attempt writes a draft of its own, which a reader does not see, and the driver names those of the attempts
    that succeeded when all have; with ``overwrite`` what was there is deleted only then.
    """
    options = options or WriteOptions()
    df = df.repartitionByRange(*options.order).sortWithinPartitions(*options.order) if options.order else df
    df = df.coalesce(1) if single else df
    if mode not in MODES:
        raise ValueError(f"mode {mode}")
    if not options.codecs and options.codec in SPARK_CODECS and (options.level is None or options.codec == "zstd"):
        df.write.mode(mode).options(**options.spark()).parquet(path)
        return
    if options.blooms:
        raise ValueError("no Bloom filters with codecs for single columns, brotli or levels of other codecs than zstd")
    import pyarrow.fs

    names, job = df.columns, uuid.uuid4().hex
    uri = path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    there = fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound
    if there and mode == "ignore":
        return
    if there and mode in ("errorifexists", "error"):
        raise FileExistsError(f"{path} already exists")
    fs.create_dir(root, recursive=True)
    old = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(root))] if mode == "overwrite" else []
    codecs = {c: options.codecs.get(c, options.codec) for c in names}
    codecs = {c: "none" if k == "uncompressed" else "lz4" if k == "lz4_raw" else k for c, k in codecs.items()}
    levels = {c: options.level for c in names if codecs[c] in ("zstd", "gzip", "brotli")} if options.level is not None else None

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        draft = posixpath.join(root, f"_draft-{job}-{task.partitionId():05d}-{task.taskAttemptId()}")
        writer, n = None, 0
        for b in batches:
            if writer is None:
                writer = pq.ParquetWriter(draft, b.schema, filesystem=fs, compression=codecs, compression_level=levels, data_page_version=f"{options.page_version}.0", use_dictionary=[c for c in names if options.dictionary.get(c, options.dictionary_default)])
            writer.write_batch(b, row_group_size=options.rows_per_group)
            n += b.num_rows
        if writer is not None:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([draft if writer is not None else None], pa.string()), pa.array([n])], names=["draft", "n"])

    written = [r.draft for r in df.mapInArrow(put, "draft string, n long").collect() if r.draft]  # one small row for each partition
    for name in old:
        fs.delete_dir(name) if fs.get_file_info(name).type == pyarrow.fs.FileType.Directory else fs.delete_file(name)
    for n, draft in enumerate(sorted(written)):
        fs.move(draft, posixpath.join(root, f"part-{n:05d}-{job}.parquet"))
    if not written and mode != "append":  # an empty table has a schema still
        pq_empty(df, fs, posixpath.join(root, f"part-00000-{job}.parquet"))
    for left in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if posixpath.basename(left.path).startswith(f"_draft-{job}-"):
            fs.delete_file(left.path)  # of attempts that failed or came second


def pq_empty(df: DataFrame, fs, name: str) -> None:
    """A file without rows."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    pq.write_table(to_arrow_schema(df.schema).empty_table(), name, filesystem=fs)
