"""Whole encrypted Parquet files (AES-GCM modules), written and read with keys held in memory.

Pages are built in tasks, sealed by Spark's own AES functions as rows of modules, and only sealed modules are staged; a task
for each file then puts them together. Key metadata is what key tools write for a key service, with the name of a key in
place of a wrapped key, so any reader of such files opens them with a service client that gives the key of that name.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import codecs, crypto, thrift
from ..session import shared_dir
from .metadata import File, file_list

#: Where a file's footer is: readable by all, with a signature, or sealed itself.
FOOTER_MODES = ("plaintext", "encrypted")
#: Rows of a page and of a row group.
PAGE_ROWS, GROUP_ROWS = 20_000, 200_000
#: Bytes that sealing adds to a module: its length, nonce and tag.
ADDED = 4 + crypto.NONCE + crypto.TAG
MODULE = "file int, seq long, key int, aad binary, plain binary, plan binary"
_KINDS = {"int": "INT32", "bigint": "INT64", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "BYTE_ARRAY", "binary": "BYTE_ARRAY"}


def key_metadata(name: str, footer: bool) -> bytes:
    """How a file names one of its keys."""
    about = {"keyMaterialType": "PKMT1", "internalStorage": True, "isFooterKey": footer, "masterKeyID": name, "wrappedDEK": name, "doubleWrapping": False}
    return json.dumps(about | ({"kmsInstanceID": "DEFAULT", "kmsInstanceURL": "DEFAULT"} if footer else {})).encode()


def _page(values: pa.Array, kind: str) -> tuple[dict, bytes]:
    """(header, body) of a V1 data page of an optional column."""
    there = np.asarray(values.is_valid())
    levels = codecs.hybrid_encode(there.astype(np.uint64), 1)
    some = values.drop_null()
    if kind == "BYTE_ARRAY":
        body = b"".join(len(v).to_bytes(4, "little") + v for v in some.cast(pa.binary()).to_pylist())
    elif kind == "BOOLEAN":
        body = np.packbits(np.array(some.to_pylist(), bool), bitorder="little").tobytes()
    else:
        body = some.to_numpy(zero_copy_only=False).astype(codecs.TYPES[kind.lower()]).tobytes()
    data = len(levels).to_bytes(4, "little") + levels + body
    about = {"num_values": len(values), "encoding": "PLAIN", "definition_level_encoding": "RLE", "repetition_level_encoding": "RLE"}
    return {"type": "DATA_PAGE", "uncompressed_page_size": len(data), "compressed_page_size": len(data) + ADDED, "data_page_header": about}, data


def write_encrypted(df: DataFrame, path: str, keys: crypto.StaticKeys, footer: str = "encrypted") -> None:
    """Writes ``df`` as encrypted files, one for each partition, into a new folder. Columns that ``keys`` names have their own
    key, the others the footer's. Values may be null; types are integers, floats, booleans, strings and bytes."""
    import pyarrow.fs

    if footer not in FOOTER_MODES:
        raise ValueError(f"footer {footer}")
    spark, job = df.sparkSession, uuid.uuid4().bytes
    fields = [(f.name, _KINDS[f.dataType.simpleString()], f.dataType.simpleString()) for f in df.schema]
    names = [""] + [n for n, *_ in fields if n in keys.columns]  # "" is the footer's key
    number = {n: names.index(n) if n in names else 0 for n, *_ in fields}
    sealed_meta = {n: number[n] > 0 or footer == "plaintext" for n, *_ in fields}
    uri = path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
    fs, root = pyarrow.fs.FileSystem.from_uri(uri)
    if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(f"{path} already exists")
    fs.create_dir(root, recursive=True)
    unique = lambda file: hashlib.sha256(job + file.to_bytes(4, "little")).digest()[:8]

    def modules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file = TaskContext.get().partitionId()
        own, seq, place, plan = unique(file), 0, 4, []
        held, rows = [], 0

        def group() -> Iterator[dict]:
            nonlocal seq, place
            table, columns = pa.Table.from_batches(held), []
            for c, (name, kind, _) in enumerate(fields):
                begin, plain_size = place, 0
                aad = lambda module, page=None, c=c: crypto.module_aad(b"", own, module, len(plan), c, page)
                values = table.column(c).combine_chunks()
                for p, a in enumerate(range(0, len(values), PAGE_ROWS)):
                    head, body = _page(values.slice(a, PAGE_ROWS), kind)
                    raw = thrift.write(head, thrift.PAGE_HEADER)
                    for module, data in (("data_page_header", raw), ("data_page", body)):
                        yield {"file": file, "seq": seq, "key": number[name], "aad": aad(module, p), "plain": data}
                        seq, place = seq + 1, place + len(data) + ADDED
                    plain_size += len(raw) + len(body)
                meta = {"type": kind, "encodings": ["PLAIN", "RLE"], "path_in_schema": [name.encode()], "codec": "UNCOMPRESSED", "num_values": len(values), "total_uncompressed_size": plain_size, "total_compressed_size": place - begin, "data_page_offset": begin}
                raw = thrift.write(meta, thrift.COLUMN)
                columns.append((begin, raw.hex(), seq if sealed_meta[name] else None))
                if sealed_meta[name]:
                    yield {"file": file, "seq": seq, "key": number[name], "aad": aad("column_meta"), "plain": raw}
                    seq += 1
            plan.append((len(table), columns))

        for b in batches:
            for at in range(0, b.num_rows, GROUP_ROWS):
                held.append(b.slice(at, GROUP_ROWS))
                rows += held[-1].num_rows
                if rows >= GROUP_ROWS:
                    yield pa.RecordBatch.from_pylist(list(group()), _MODULE)
                    held, rows = [], 0
        last = list(group()) if held else []
        yield pa.RecordBatch.from_pylist([*last, {"file": file, "seq": seq, "plan": json.dumps(plan).encode()}], _MODULE)

    def body(key, t: pa.Table) -> pa.Table:
        """The pages of a file, written to a draft; what is left to seal is its footer."""
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        file = key[0].as_py()
        rows = sorted(zip(t.column("seq").to_pylist(), t.column("m").to_pylist(), t.column("plan").to_pylist(), strict=True))
        plan = json.loads(rows[-1][2])
        module = {s: m for s, m, _ in rows}
        metas = {c[2] for _, columns in plan for c in columns if c[2] is not None}
        mark = b"PARE" if footer == "encrypted" else b"PAR1"
        draft = posixpath.join(root, f"_draft-{file:05d}-{uuid.uuid4().hex}")
        with fs.open_output_stream(draft) as out:
            out.write(mark)
            for s, m, _ in rows[:-1]:
                if s not in metas:
                    out.write(m)
        groups = []
        for n, (count, columns) in enumerate(plan):
            chunks, size = [], 0
            for (name, *_), (begin, raw, seq) in zip(fields, columns, strict=True):
                meta = thrift.read(bytes.fromhex(raw), thrift.COLUMN)[0]
                size += meta["total_compressed_size"]
                way = {"ENCRYPTION_WITH_COLUMN_KEY": {"path_in_schema": [name.encode()], "key_metadata": key_metadata(name, False)}} if number[name] else {"ENCRYPTION_WITH_FOOTER_KEY": {}}
                chunk = {"file_offset": begin, "crypto_metadata": way}
                chunk |= {"encrypted_column_metadata": module[seq]} if seq is not None else {}
                chunk |= {"meta_data": meta} if seq is None or footer == "plaintext" else {}
                chunks.append(chunk)
            groups.append({"columns": chunks, "total_byte_size": size, "num_rows": count, "total_compressed_size": size, "file_offset": columns[0][0], "ordinal": n})
        schema = [{"name": b"schema", "num_children": len(fields)}] + [{"name": n.encode(), "type": k, "repetition_type": "OPTIONAL"} | ({"converted_type": "UTF8", "logical_type": {"STRING": {}}} if spark_type == "string" else {}) for n, k, spark_type in fields]
        meta = {"version": 2, "schema": schema, "num_rows": sum(n for n, _ in plan), "row_groups": groups, "created_by": b"colscan", "column_orders": [{"TYPE_ORDER": {}}] * len(fields)}
        if footer == "plaintext":
            meta |= {"encryption_algorithm": algorithm(file), "footer_signing_key_metadata": key_metadata("", True)}
        aad = crypto.module_aad(b"", unique(file), crypto.FOOTER)
        return pa.table({"file": pa.array([file], pa.int32()), "draft": [draft], "aad": pa.array([aad], pa.binary()), "plain": pa.array([thrift.write(meta, thrift.FILE)], pa.binary())})

    def algorithm(file: int) -> dict:
        return {"AES_GCM_V1": {"aad_file_unique": unique(file), "supply_aad_prefix": False}}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The footer behind the pages, into the file proper."""
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(uri)
        for b in batches:
            for file, draft, plain, m in zip(*(b.column(n).to_pylist() for n in ("file", "draft", "plain", "m")), strict=True):
                if footer == "encrypted":
                    about = {"encryption_algorithm": algorithm(file), "key_metadata": key_metadata("", True)}
                    trailer, mark = crypto.join_encrypted_footer(about, m), b"PARE"
                else:
                    trailer, mark = plain + m[4 : 4 + crypto.NONCE] + m[-crypto.TAG :], b"PAR1"
                whole = f"{draft}-whole"
                with fs.open_input_stream(draft) as source, fs.open_output_stream(whole) as out:
                    while part := source.read(1 << 22):
                        out.write(part)
                    out.write(trailer + len(trailer).to_bytes(4, "little") + mark)
                fs.move(whole, posixpath.join(root, f"part-{file:05d}.parquet"))
                fs.delete_file(draft)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["file"])

    def sealed(rows: DataFrame, key) -> DataFrame:
        m = F.aes_encrypt(F.col("plain"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.col("aad"))
        return rows.withColumn("m", F.when(F.col("plain").isNotNull(), F.concat(crypto.little_endian(F.octet_length(m), 4), m)))

    def staged(rows: DataFrame) -> DataFrame:
        out = shared_dir(spark)
        rows.write.parquet(out)
        return spark.read.schema(rows.schema).parquet(out)

    all_keys = F.array(*[F.lit(keys.column_key(n) if n else keys.footer_key()) for n in names])
    pages = staged(sealed(df.mapInArrow(modules, MODULE), F.get(all_keys, F.coalesce("key", F.lit(0)))).drop("plain", "aad", "key"))
    # A draft that a second attempt of a task writes has a name of its own; the one whose row is staged is finished.
    ends = staged(sealed(pages.groupBy("file").applyInArrow(lambda k, t: body(k, t), "file int, draft string, aad binary, plain binary"), F.lit(keys.footer_key())))
    ends.mapInArrow(finish, "file int").collect()  # one number for each file
    for left in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if posixpath.basename(left.path).startswith("_draft-"):
            fs.delete_file(left.path)


_MODULE = pa.schema([("file", pa.int32()), ("seq", pa.int64()), ("key", pa.int32()), ("aad", pa.binary()), ("plain", pa.binary()), ("plan", pa.binary())])


def scan_encrypted(spark: SparkSession, path: str, keys: crypto.KeyRetriever, schema: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of encrypted files whose key metadata names keys; ``schema`` is theirs, since a sealed footer cannot be listed.
    Only columns whose keys are at hand can be asked for; a wrong key is an error."""
    wanted = spark.createDataFrame([], schema).select(*(columns or ["*"])).schema
    arrow = to_arrow_schema(wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.parquet import encryption

        class Named(encryption.KmsClient):
            def __init__(self, _config):
                super().__init__()

            def wrap_key(self, key_bytes, master_key_identifier):
                raise NotImplementedError("keys are named, not wrapped")

            def unwrap_key(self, wrapped_key, master_key_identifier):
                name = wrapped_key if isinstance(wrapped_key, str) else wrapped_key.decode()
                return keys.column_key(name, None) if name else keys.footer_key(None)

        factory, config = encryption.CryptoFactory(Named), encryption.KmsConnectionConfig()
        for b in batches:
            for file in b.column(0).to_pylist():
                with File(file) as f:
                    opened = pq.ParquetFile(f.handle, decryption_properties=factory.file_decryption_properties(config))
                    for part in opened.iter_batches(columns=wanted.names):
                        yield pa.RecordBatch.from_arrays([part.column(k.name).cast(k.type) for k in arrow], schema=arrow)

    return file_list(spark, path).select("file").mapInArrow(read, wanted)
