"""What Parquet files say about themselves, as tables: files, schema, row groups, chunks, pages, indexes, Bloom filters.

Files are listed by Spark without reading them; footers, indexes and page headers are read in tasks, by byte range, through
pyarrow's file systems. One row stands for each thing described, so these tables grow with the files, not with their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import thrift
from ..functions.pages import PageWalker

MAGIC, ENCRYPTED = b"PAR1", b"PARE"
#: Bytes of footers, bounds and filters that are held for one batch of rows.
MOST = 1 << 22


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_size) of the files under a path; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~name.startswith("_") & ~name.startswith(".")).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"))


class File:
    """An open file: its size, the place and bytes of its footer, and any range of bytes."""

    def __init__(self, name: str):
        import pyarrow.fs

        if name.startswith("file:/") and not name.startswith("file:///"):
            name = f"file://{name[5:]}"
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        self.name, self.handle = name, fs.open_input_file(path)
        self.size = self.handle.size()

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()

    def read_range(self, offset: int, length: int) -> bytes:
        """``length`` bytes from ``offset`` on; a range that leaves the file is an error."""
        if offset < 0 or length < 0 or offset + length > self.size:
            raise thrift.FormatError(f"no {length} bytes in {self.name} of {self.size}", offset)
        return self.handle.read_at(length, offset)

    def trailer(self) -> tuple[int, bytes, bool]:
        """(offset of the footer, its bytes, whether it is encrypted), after the marks at both ends and its length are checked."""
        if self.size < 12:
            raise thrift.FormatError(f"{self.name} has {self.size} bytes")
        tail = self.read_range(self.size - 8, 8)
        mark = tail[4:]
        if mark not in (MAGIC, ENCRYPTED) or self.read_range(0, 4) not in (MAGIC, mark):
            raise thrift.FormatError(f"{self.name} is no Parquet file", self.size - 4)
        length = int.from_bytes(tail[:4], "little")
        begin = self.size - 8 - length
        if begin < 4:
            raise thrift.FormatError(f"footer of {length} bytes", self.size - 8)
        return begin, self.read_range(begin, length), mark == ENCRYPTED

    def metadata(self) -> dict:
        begin, data, encrypted = self.trailer()
        if encrypted:
            raise thrift.FormatError(f"the footer of {self.name} is encrypted", begin)
        return thrift.read(data, thrift.FILE)[0]


def _table(spark: SparkSession, path: str, schema: str, rows: Callable[[File], Iterator[dict]]) -> DataFrame:
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                with File(name) as f:
                    held, size = [], 0
                    for row in rows(f):
                        held.append({"file": name} | row)
                        size += sum(len(v) for v in row.values() if isinstance(v, bytes))
                        if len(held) == 4096 or size > MOST:
                            yield pa.RecordBatch.from_pylist(held, arrow)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, arrow)

    return file_list(spark, path).select("file").mapInArrow(run, schema)


def _text(raw: bytes | None) -> str | None:
    return raw.decode("utf-8", "replace") if raw is not None else None


def _pairs(found: list[dict] | None) -> list[tuple]:
    return [(_text(kv["key"]), _text(kv.get("value"))) for kv in found or ()]


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: sizes, the footer's place and bytes, whether it is encrypted, and what it says of the whole file."""

    def rows(f: File):
        begin, data, encrypted = f.trailer()
        out = {"file_size": f.size, "footer_offset": begin, "footer": data, "footer_encrypted": encrypted}
        if encrypted:
            crypto, _ = thrift.read(data, thrift.FILE_CRYPTO)
            yield out | {"algorithm": thrift.chosen(crypto["encryption_algorithm"])}
            return
        meta, _ = thrift.read(data, thrift.FILE)
        yield out | {
            "version": meta["version"], "created_by": _text(meta.get("created_by")), "n_rows": meta["num_rows"], "n_row_groups": len(meta["row_groups"]),
            "key_values": _pairs(meta.get("key_value_metadata")), "column_orders": [thrift.chosen(o) for o in meta.get("column_orders", [])], "algorithm": thrift.chosen(meta.get("encryption_algorithm", {})),
        }

    return _table(spark, path, "file string, file_size long, footer_offset long, footer binary, footer_encrypted boolean, version int, created_by string, n_rows long, n_row_groups int, key_values map<string,string>, column_orders array<string>, algorithm string", rows)


def leaves(schema: list[dict]) -> Iterator[dict]:
    """Every node of a schema in order, with its path, depth, highest levels and, for leaves, the number of its column."""
    column, open_ = 0, []  # open_: [children left, path, depth, max_rep, max_def]
    for n, e in enumerate(schema):
        name = _text(e["name"])
        while open_ and open_[-1][0] == 0:
            open_.pop()
        if n == 0:
            here = [e.get("num_children", 0), [], 0, 0, 0]
        else:
            if not open_:
                raise thrift.FormatError(f"schema has no parent for {name}")
            open_[-1][0] -= 1
            _, path, depth, rep, define = open_[-1]
            kind = e.get("repetition_type")
            here = [e.get("num_children", 0), [*path, name], depth + 1, rep + (kind == "REPEATED"), define + (kind in ("OPTIONAL", "REPEATED"))]
        leaf = n > 0 and "type" in e
        yield e | {"name": name, "path": ".".join(here[1]), "depth": here[2], "max_rep": here[3], "max_def": here[4], "column": column if leaf else None, "logical": thrift.logical_name(e)}
        column += leaf
        open_.append(here)


def schema_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row for each node of each file's schema."""

    def rows(f: File):
        for n, e in enumerate(leaves(f.metadata()["schema"])):
            yield {"element": n} | {k: e.get(k) for k in ("column", "path", "depth", "name", "type", "type_length", "repetition_type", "num_children", "converted_type", "logical", "scale", "precision", "field_id", "max_rep", "max_def")}

    return _table(spark, path, "file string, element int, column int, path string, depth int, name string, type string, type_length int, repetition_type string, num_children int, converted_type string, logical string, scale int, precision int, field_id int, max_rep int, max_def int", rows)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row group, with its first row, sizes and sorting columns."""

    def rows(f: File):
        base = 0
        for n, g in enumerate(f.metadata()["row_groups"]):
            yield {"row_group": n, "row_base": base, "n_rows": g["num_rows"], "total_byte_size": g["total_byte_size"], "total_compressed_size": g.get("total_compressed_size"), "file_offset": g.get("file_offset"), "ordinal": g.get("ordinal"), "sorting": g.get("sorting_columns", [])}
            base += g["num_rows"]

    return _table(spark, path, "file string, row_group int, row_base long, n_rows long, total_byte_size long, total_compressed_size long, file_offset long, ordinal int, sorting array<struct<column_idx:int,descending:boolean,nulls_first:boolean>>", rows)


def _chunks(f: File) -> Iterator[tuple[int, int, dict, dict]]:
    """(row group, column, chunk, its metadata) of a file; chunks whose metadata is encrypted have none."""
    for g, group in enumerate(f.metadata()["row_groups"]):
        for c, chunk in enumerate(group["columns"]):
            yield g, c, chunk, chunk.get("meta_data", {})


STATS = ("min_value", "max_value", "min", "max", "null_count", "distinct_count", "is_min_value_exact", "is_max_value_exact")
SIZE_STATS = ("unencoded_byte_array_data_bytes", "repetition_level_histogram", "definition_level_histogram")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk: all of its metadata, statistics, places of its pages, indexes and Bloom filter."""

    def rows(f: File):
        for g, c, chunk, m in _chunks(f):
            stats, sizes = m.get("statistics", {}), m.get("size_statistics", {})
            yield (
                {"row_group": g, "column": c, "path": ".".join(map(_text, m["path_in_schema"])) if m else None, "pages": m.get("encoding_stats", []), "key_values": _pairs(m.get("key_value_metadata")), "chunk_file": _text(chunk.get("file_path")), "crypto": thrift.chosen(chunk.get("crypto_metadata", {}))}
                | {k: m.get(k) for k in ("type", "codec", "encodings", "num_values", "total_uncompressed_size", "total_compressed_size", "data_page_offset", "index_page_offset", "dictionary_page_offset", "bloom_filter_offset", "bloom_filter_length")}
                | {k: chunk.get(k) for k in ("offset_index_offset", "offset_index_length", "column_index_offset", "column_index_length")}
                | {k: stats.get(k) for k in STATS}
                | {k: sizes.get(k) for k in SIZE_STATS}
            )

    return _table(
        spark, path,
        "file string, row_group int, column int, path string, type string, codec string, encodings array<string>, num_values long, total_uncompressed_size long, total_compressed_size long, data_page_offset long, index_page_offset long, dictionary_page_offset long, bloom_filter_offset long, bloom_filter_length int, "
        "offset_index_offset long, offset_index_length int, column_index_offset long, column_index_length int, min_value binary, max_value binary, min binary, max binary, null_count long, distinct_count long, is_min_value_exact boolean, is_max_value_exact boolean, "
        "unencoded_byte_array_data_bytes long, repetition_level_histogram array<long>, definition_level_histogram array<long>, pages array<struct<page_type:string,encoding:string,count:int>>, key_values map<string,string>, chunk_file string, crypto string",
        rows,
    )


def chunk_bytes(f: File, m: dict) -> tuple[int, bytes]:
    """(offset, bytes) of a chunk's pages, by its metadata."""
    begin = min(x for x in (m["data_page_offset"], m.get("dictionary_page_offset") or m["data_page_offset"]))
    return begin, f.read_range(begin, m["total_compressed_size"])


def pages(spark: SparkSession, path: str, columns: list[int] | None = None) -> DataFrame:
    """One row for each page of the chunks (of some columns): its header and place. The chunks' bytes are read, not decoded."""

    def rows(f: File):
        for g, c, _, m in _chunks(f):
            if not m or columns is not None and c not in columns:
                continue
            base, data = chunk_bytes(f, m)
            walker, n = PageWalker(data), 0
            while True:
                begin = walker.position
                page = walker.next_page()
                if page is None:
                    break
                head, body = page
                about = head.get("data_page_header") or head.get("data_page_header_v2") or head.get("dictionary_page_header") or {}
                yield {
                    "row_group": g, "column": c, "page": n, "offset": base + begin, "header_bytes": walker.position - begin - len(body), "type": head["type"], "uncompressed": head["uncompressed_page_size"], "compressed": head["compressed_page_size"], "crc": head.get("crc"),
                    "n_values": about.get("num_values"), "n_nulls": about.get("num_nulls"), "n_rows": about.get("num_rows"), "encoding": about.get("encoding"), "definition_encoding": about.get("definition_level_encoding"), "repetition_encoding": about.get("repetition_level_encoding"),
                    "is_compressed": about.get("is_compressed", True) if head["type"] == "DATA_PAGE_V2" else None, "is_sorted": about.get("is_sorted"),
                }
                n += 1

    return _table(spark, path, "file string, row_group int, column int, page int, offset long, header_bytes int, type string, uncompressed int, compressed int, crc int, n_values int, n_nulls int, n_rows int, encoding string, definition_encoding string, repetition_encoding string, is_compressed boolean, is_sorted boolean", rows)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page that the offset index and column index describe: place, first row, bounds, nulls, order of bounds."""

    def rows(f: File):
        for g, c, chunk, _ in _chunks(f):
            if not chunk.get("offset_index_offset"):
                continue
            offsets, _ = thrift.read(f.read_range(chunk["offset_index_offset"], chunk["offset_index_length"]), thrift.OFFSET_INDEX)
            index = thrift.read(f.read_range(chunk["column_index_offset"], chunk["column_index_length"]), thrift.COLUMN_INDEX)[0] if chunk.get("column_index_offset") else {}
            at = lambda name, n, index=index: index[name][n] if n < len(index.get(name, ())) else None
            for n, p in enumerate(offsets["page_locations"]):
                yield {"row_group": g, "column": c, "page": n, "offset": p["offset"], "compressed": p["compressed_page_size"], "first_row": p["first_row_index"], "null_page": at("null_pages", n), "min_value": at("min_values", n), "max_value": at("max_values", n), "null_count": at("null_counts", n), "boundary_order": index.get("boundary_order")}

    return _table(spark, path, "file string, row_group int, column int, page int, offset long, compressed int, first_row long, null_page boolean, min_value binary, max_value binary, null_count long, boundary_order string", rows)


def chunk_bloom(f: File, m: dict) -> tuple[dict, bytes] | None:
    """(header, the whole filter) of a chunk by its metadata; none where it has no Bloom filter."""
    at = m.get("bloom_filter_offset")
    if at is None:
        return None
    room = m.get("bloom_filter_length") or min(64, f.size - at)
    head, begin = thrift.read(f.read_range(at, room), thrift.BLOOM_HEADER)
    return head, f.read_range(at, begin + head["num_bytes"])


def bloom_filters(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk that has a Bloom filter: its header and the filter as ``BlockBloom.from_bytes`` takes it."""

    def rows(f: File):
        for g, c, _, m in _chunks(f):
            found = chunk_bloom(f, m)
            if found is None:
                continue
            head, whole = found
            yield {"row_group": g, "column": c, "n_blocks": head["num_bytes"] // 32, "algorithm": thrift.chosen(head["algorithm"]), "hash": thrift.chosen(head["hash"]), "compression": thrift.chosen(head["compression"]), "filter": whole}

    return _table(spark, path, "file string, row_group int, column int, n_blocks int, algorithm string, hash string, compression string, filter binary", rows)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``bytes`` of each row (file, offset, length); a range that leaves its file is an error."""

    def run(batches):
        for b in batches:
            out, f = [], None
            for name, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if f is None or f.given != name:
                    f = File(name)
                    f.given = name
                out.append(f.read_range(offset, length))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], names=["file", "offset", "length", "bytes"])

    return ranges.select("file", F.col("offset").cast("long"), F.col("length").cast("long")).mapInArrow(run, "file string, offset long, length long, bytes binary")
