"""Byte forms of the Parquet encodings, for values that are raw pages: numpy, and pandas UDFs over them."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

TYPES = {"int32": "<i4", "int64": "<i8", "float": "<f4", "double": "<f8"}


def plain_decode(data: bytes, kind: str, n: int | None = None) -> np.ndarray:
    """PLAIN values; a ragged length is an error."""
    t = np.dtype(TYPES[kind])
    if n is None and len(data) % t.itemsize:
        raise ValueError(f"{len(data)} bytes are no whole number of {kind}")
    return np.frombuffer(data, t, -1 if n is None else n)


def plain_decode_bool(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n].astype(bool)


def plain_decode_bytes(data: bytes, n_values: int | None = None) -> list[bytes]:
    """Values with 32-bit little-endian lengths before them: all, or the first ``n_values``."""
    out, at = [], 0
    while at < len(data) if n_values is None else len(out) < n_values:
        if at + 4 > len(data):
            raise ValueError("length runs past the page")
        n = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + n > len(data):
            raise ValueError("value runs past the page")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def plain_decode_fixed(data: bytes, width: int) -> list[bytes]:
    if width <= 0 or len(data) % width:
        raise ValueError("ragged fixed-length page")
    return [data[i : i + width] for i in range(0, len(data), width)]


#: Fixed value: the Julian day of 1970-01-01.
EPOCH_DAY = 2_440_588


def plain_decode_int96(data: bytes, n: int | None = None) -> np.ndarray:
    """INT96 timestamps (nanoseconds of the day, then the Julian day) as nanoseconds since 1970."""
    if len(data) % 12 and n is None or n is not None and len(data) < 12 * n:
        raise ValueError("ragged INT96 page")
    raw = np.frombuffer(data, np.dtype([("nanos", "<i8"), ("day", "<i4")]), -1 if n is None else n)
    return (raw["day"].astype(np.int64) - EPOCH_DAY) * 86_400_000_000_000 + raw["nanos"]


def int96(nanos: int) -> bytes:
    """One timestamp as INT96."""
    day, rest = divmod(int(nanos), 86_400_000_000_000)
    return rest.to_bytes(8, "little") + (day + EPOCH_DAY).to_bytes(4, "little")


def plain(data: bytes, kind: str, n: int, width: int = 0):
    """``n`` PLAIN values of any physical type, by its name in lower case."""
    if kind == "boolean":
        return plain_decode_bool(data, n)
    if kind == "byte_array":
        return plain_decode_bytes(data, n)
    if kind == "fixed_len_byte_array":
        return plain_decode_fixed(data[: n * width], width)
    return plain_decode_int96(data, n) if kind == "int96" else plain_decode(data, kind, n)


def plain_at(data: bytes, kind: str, mask: np.ndarray, width: int = 0):
    """PLAIN values at the set places of a mask, which is as long as the page; the others are passed over undecoded."""
    mask = np.asarray(mask, bool)
    if kind == "byte_array":
        out, at = [], 0
        for keep in mask.tolist():
            if at + 4 > len(data):
                raise ValueError("length runs past the page")
            end = at + 4 + int.from_bytes(data[at : at + 4], "little")
            if end > len(data):
                raise ValueError("value runs past the page")
            if keep:
                out.append(data[at + 4 : end])
            at = end
        return out
    if kind == "fixed_len_byte_array":
        return [data[i * width : (i + 1) * width] for i in np.flatnonzero(mask).tolist()]
    return plain(data, kind, len(mask))[mask]


def offsets_of(values: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Values as one run of bytes with the place where each begins, and the end."""
    return np.cumsum([0, *map(len, values)]), b"".join(values)


def lookup(dictionary, codes: np.ndarray):
    """Dictionary entries of codes; a code that the dictionary lacks is an error."""
    codes = np.asarray(codes, np.int64)
    if len(codes) and codes.max() >= len(dictionary):
        raise ValueError(f"code {codes.max()} of {len(dictionary)} entries")
    return dictionary[codes] if isinstance(dictionary, np.ndarray) else [dictionary[c] for c in codes.tolist()]


def lookup_at(dictionary, codes: np.ndarray, mask: np.ndarray):
    """Entries of the codes at the set places of a mask."""
    return lookup(dictionary, np.asarray(codes)[np.asarray(mask, bool)])


def unpack_lookup(data: bytes, width: int, n: int, dictionary):
    """Dictionary entries of ``n`` bit-packed codes."""
    return lookup(dictionary, bit_unpack(data, width, n))


def predicate_bitmap(data: bytes, width: int, n: int, passes: np.ndarray) -> np.ndarray:
    """Bytes with a bit for each of ``n`` hybrid-coded codes, lowest bit first: whether its entry ``passes``."""
    return np.packbits(lookup(np.asarray(passes, bool), hybrid_decode(data, width, n)), bitorder="little")


def small_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """Codes as bytes; a bit width over 8 is an error."""
    if width > 8:
        raise ValueError(f"{width} bits are no byte")
    return np.asarray(codes).astype(np.uint8)


def bit_unpack(data: bytes, width: int, n: int) -> np.ndarray:
    """``n`` unsigned values of ``width`` bits, lowest bit first."""
    if width == 0:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def bit_pack(values: np.ndarray, width: int) -> bytes:
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def hybrid_decode(data: bytes, width: int, n: int) -> np.ndarray:
    """The RLE and bit-packing hybrid: ``n`` values."""
    out, at, have = [], 0, 0
    while have < n:
        head, at = read_varint(data, at)
        if head & 1:
            k = (head >> 1) * 8
            part = bit_unpack(data[at : at + (head >> 1) * width], width, k)
            at += (head >> 1) * width
        else:
            size = -(-width // 8)
            part = np.full(head >> 1, int.from_bytes(data[at : at + size], "little"), np.uint64)
            at += size
        out.append(part[: n - have])
        have += len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hybrid_encode(values: np.ndarray, width: int, shortest: int = 8) -> bytes:
    """Runs of at least ``shortest`` become RLE; what lies between is bit-packed in groups of eight, taking what it
    lacks to a full group from the run that follows."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return b""
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    out, loose, at = bytearray(), 0, 0

    def flush(a: int, b: int) -> None:
        if b > a:
            groups = -(-(b - a) // 8)
            part = np.zeros(groups * 8, np.uint64)
            part[: b - a] = values[a:b]
            out.extend(varint(groups << 1 | 1) + bit_pack(part, width))

    for a, b in zip(cut, [*cut[1:], len(values)], strict=True):
        a = max(int(a), at)
        borrow = -(a - loose) % 8
        if b - a - borrow >= shortest:
            flush(loose, a + borrow)
            out.extend(varint(int(b - a - borrow) << 1) + int(values[a]).to_bytes(-(-width // 8), "little"))
            loose = at = int(b)
    flush(loose, len(values))
    return bytes(out)


def packed_run(values: np.ndarray, width: int) -> bytes:
    """All values as one bit-packed run of the hybrid, filled up with zeros to a multiple of eight."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return b""
    if int(values.max()).bit_length() > width:
        raise ValueError(f"{values.max()} does not fit {width} bits")
    groups = -(-len(values) // 8)
    return varint(groups << 1 | 1) + bit_pack(np.r_[values, np.zeros(groups * 8 - len(values), np.uint64)], width)


def delta_read(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """DELTA_BINARY_PACKED values as 64-bit integers, and where they end. The last block has all its miniblocks' widths,
    but bytes only for miniblocks that hold values."""
    block, at = read_varint(data, at)
    minis, at = read_varint(data, at)
    total, at = read_varint(data, at)
    unzig = lambda z: (z >> 1) ^ -(z & 1)
    first, at = read_varint(data, at)
    if not minis or block % minis or block // minis % 8:
        raise ValueError(f"{block} values do not make {minis} miniblocks")
    if not total:
        return np.zeros(0, np.int64), at
    out = [np.array([unzig(first)], np.int64)]
    have, per = 1, block // minis
    while have < total:
        low, at = read_varint(data, at)
        widths = data[at : at + minis]
        at += minis
        for w in widths:
            if have >= total:
                break
            size = per * w // 8
            part = bit_unpack(data[at : at + size].ljust(size, b"\0"), w, per).view(np.int64) + np.int64(unzig(low))
            at += size
            out.append(part[: total - have])
            have += len(out[-1])
    return np.cumsum(np.concatenate(out), dtype=np.int64), at


def delta_decode(data: bytes) -> np.ndarray:
    return delta_read(data)[0]


def delta_encode(values: np.ndarray, block: int = 128, minis: int = 4) -> bytes:
    """DELTA_BINARY_PACKED; differences wrap around at 64 bits."""
    v = np.asarray(values, np.int64)
    zig = lambda n: (int(n) << 1 ^ int(n) >> 63) & (1 << 64) - 1
    out = bytearray(varint(block) + varint(minis) + varint(len(v)) + varint(zig(v[0]) if len(v) else 0))
    steps, per = np.diff(v.view(np.uint64)).view(np.int64), block // minis
    for a in range(0, len(steps), block):
        part = steps[a : a + block]
        low = part.min()
        over = part.view(np.uint64) - np.uint64(low.view(np.uint64) if isinstance(low, np.int64) else low)
        chunks = [over[i : i + per] for i in range(0, block, per)]
        widths = [int(c.max()).bit_length() if len(c) else 0 for c in chunks]
        out += varint(zig(low)) + bytes(widths)
        for c, w in zip(chunks, widths, strict=True):
            if len(c):
                out += bit_pack(np.r_[c, np.zeros(per - len(c), np.uint64)], w)
    return bytes(out)


def delta_length_decode(data: bytes) -> list[bytes]:
    """DELTA_LENGTH_BYTE_ARRAY: all lengths, then the bytes."""
    lengths, at = delta_read(data)
    if (lengths < 0).any() or at + int(lengths.sum()) > len(data):
        raise ValueError("values run past the page")
    ends = at + np.cumsum(lengths)
    return [data[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def delta_length_encode(values: list[bytes]) -> bytes:
    return delta_encode(np.array([len(v) for v in values], np.int64)) + b"".join(values)


def delta_bytes_decode(data: bytes) -> list[bytes]:
    """DELTA_BYTE_ARRAY: what each value shares with the one before, then the rests."""
    shared, at = delta_read(data)
    rests = delta_length_decode(data[at:])
    if len(rests) != len(shared):
        raise ValueError(f"{len(shared)} prefixes, {len(rests)} rests")
    out, last = [], b""
    for n, rest in zip(shared.tolist(), rests, strict=True):
        if not 0 <= n <= len(last):
            raise ValueError(f"prefix of {n} bytes of {len(last)}")
        last = last[:n] + rest
        out.append(last)
    return out


def shared_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two values have in common at their beginning."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(differ[0]) if len(differ) else n


def delta_bytes_encode(values: list[bytes]) -> bytes:
    shared = [shared_prefix(a, b) for a, b in zip([b"", *values], values, strict=False)]
    return delta_encode(np.array(shared, np.int64)) + delta_length_encode([v[n:] for v, n in zip(values, shared, strict=True)])


def stream_split_encode(values: np.ndarray) -> bytes:
    """BYTE_STREAM_SPLIT: the first bytes of all values, then the second ones, and so on."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def stream_split_decode(data: bytes, kind: str) -> np.ndarray:
    t = np.dtype(TYPES[kind])
    if len(data) % t.itemsize:
        raise ValueError("ragged page")
    return np.frombuffer(data, np.uint8).reshape(t.itemsize, -1).T.copy().view(t).ravel()


def compress(data: bytes, codec: str, level: int | None = None) -> bytes:
    """snappy, zstd, gzip, brotli or lz4_raw block, or the bytes themselves."""
    if codec == "uncompressed":
        return data
    if codec == "gzip":
        return gzip.compress(data, 6 if level is None else level)
    return pa.Codec(codec, compression_level=level).compress(data, asbytes=True)


def decompress(data: bytes, codec: str, size: int) -> bytes:
    """The block's ``size`` bytes; another size is an error."""
    if codec == "uncompressed":
        return data
    out = _decompress(data, codec, size)
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return out


def _decompress(data: bytes, codec: str, size: int) -> bytes:
    return gzip.decompress(data) if codec == "gzip" else pa.Codec(codec).decompress(data, size, asbytes=True)


def plain_bytes(value, kind: str | None = None) -> bytes:
    """PLAIN bytes of a value, without the length that a byte array has before it. ``kind`` is the physical type (int32,
    int64, float, double, boolean, byte_array); left out, integers are of 64 bits and floats double."""
    if isinstance(value, str):
        return value.encode()
    if isinstance(value, bytes | bytearray | memoryview):
        return bytes(value)
    if kind is None:
        kind = "boolean" if isinstance(value, bool | np.bool_) else "int64" if isinstance(value, int | np.integer) else "double"
    return bytes([bool(value)]) if kind == "boolean" else np.array(value, TYPES[kind]).tobytes()


def parquet_hash(value, kind: str | None = None, seed: int = 0) -> int:
    """XXH64 of the PLAIN bytes of a value; Bloom filters use it with seed 0."""
    import xxhash

    return xxhash.xxh64_intdigest(plain_bytes(value, kind), seed)


#: Fixed values of the split-block Bloom filter.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)


class BlockBloom:
    """Split-block Bloom filter: blocks of eight 32-bit words, one bit of each for a hash."""

    def __init__(self, blocks: int, words: np.ndarray | None = None):
        if blocks < 1:
            raise ValueError("a filter has a block at least")
        self.words = np.zeros((blocks, 8), np.uint32) if words is None else words

    @classmethod
    def from_bytes(cls, data: bytes) -> BlockBloom:
        """A filter as files have it: header, then its bits."""
        from . import thrift

        head, at = thrift.read(data, thrift.BLOOM_HEADER)
        wanted = {"algorithm": "BLOCK", "hash": "XXHASH", "compression": "UNCOMPRESSED"}
        for name, value in wanted.items():
            if thrift.chosen(head[name]) != value:
                raise thrift.FormatError(f"{name} is not {value}", at)
        size = head["num_bytes"]
        if size <= 0 or size % 32 or at + size > len(data):
            raise thrift.FormatError(f"no filter of {size} bytes", at)
        return cls(size // 32, np.frombuffer(data, "<u4", size // 4, at).reshape(-1, 8).astype(np.uint32))

    def to_bytes(self) -> bytes:
        from . import thrift

        head = {"num_bytes": self.words.nbytes, "algorithm": {"BLOCK": {}}, "hash": {"XXHASH": {}}, "compression": {"UNCOMPRESSED": {}}}
        return thrift.write(head, thrift.BLOOM_HEADER) + self.words.astype("<u4").tobytes()

    @property
    def num_blocks(self) -> int:
        return len(self.words)

    def add_bytes(self, values: list[bytes]) -> None:
        self.add(np.array([parquet_hash(v) for v in values], np.uint64))

    def has_bytes(self, values: list[bytes]) -> np.ndarray:
        return self.has(np.array([parquet_hash(v) for v in values], np.uint64))

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.asarray(hashes, np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)
        bit = ((h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] * SALT) >> np.uint32(27)
        return block.astype(np.int64), np.uint32(1) << bit

    def add(self, hashes: np.ndarray) -> None:
        block, mask = self.place(hashes)
        np.bitwise_or.at(self.words, block, mask)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        block, mask = self.place(hashes)
        return ((self.words[block] & mask) == mask).all(axis=1)


#: Physical types of Spark's types, and the widths at which their values are hashed.
PHYSICAL = {"tinyint": "int32", "smallint": "int32", "int": "int32", "date": "int32", "bigint": "int64", "timestamp": "int64", "timestamp_ntz": "int64", "float": "float", "double": "double", "string": "byte_array", "binary": "byte_array", "boolean": "boolean"}


def hashed(values: pa.Array, kind: str, seed: int = 0) -> pa.Array:
    """``parquet_hash`` of an Arrow array of the physical type ``kind``, as signed 64-bit integers; nulls stay null."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if kind == "byte_array":
        raw = values.cast(pa.binary()).to_pylist()
    elif kind == "boolean":
        raw = [None if v is None else bytes([v]) for v in values.to_pylist()]
    else:
        t = np.dtype(TYPES[kind])
        whole = values.cast(pa.from_numpy_dtype(t)) if not pa.types.is_temporal(values.type) else values.cast(pa.int32() if t.itemsize == 4 else pa.int64())
        data = np.asarray(whole.fill_null(0)).astype(t).tobytes()
        raw = [None if null else data[i * t.itemsize : (i + 1) * t.itemsize] for i, null in enumerate(values.is_null().to_pylist())]
    return pa.array([None if v is None else np.uint64(digest(v, seed)).astype(np.int64) for v in raw], pa.int64())


def with_hash(df: DataFrame, column: str, name: str, kind: str | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``name``: the hash of ``column`` at the width of its physical type, over Arrow batches."""
    kind = kind or PHYSICAL[df.schema[column].dataType.simpleString()]
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, hashed(b.column(at), kind, seed)], names=[*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


@F.pandas_udf(ArrayType(LongType()))
def hybrid_values(data: pd.Series, width: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([hybrid_decode(d, w, k).astype(np.int64) for d, w, k in zip(data, width, n, strict=True)])


@F.pandas_udf(ArrayType(LongType()))
def delta_values(data: pd.Series) -> pd.Series:
    return data.map(delta_decode)
