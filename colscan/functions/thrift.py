"""Thrift's compact protocol for the structures of a Parquet file: one reader and one writer over tables of fields."""

from __future__ import annotations

import struct

from .codecs import read_varint, varint

#: Wire types of the compact protocol (fixed values of the Thrift specification).
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
DEEPEST = 64


class FormatError(ValueError):
    """Bytes that are no valid structure; ``at`` is the place."""

    def __init__(self, what: str, at: int = 0):
        super().__init__(f"{what} at byte {at}")
        self.at = at


class Enum:
    """Names of an enumeration by number; a number without a name stays a number."""

    def __init__(self, **names: int):
        self.number, self.name = names, {v: k for k, v in names.items()}


class Many:
    """A list of some kind."""

    def __init__(self, kind):
        self.kind = kind


class Struct:
    """Fields as id -> (name, kind); a kind is a wire type, an ``Enum``, a ``Struct`` or ``Many``. ``union``: one field only."""

    def __init__(self, fields: dict[int, tuple], union: bool = False, required: tuple[str, ...] = ()):
        self.fields, self.union, self.required = fields, union, required
        self.id = {name: i for i, (name, _) in fields.items()}


def _wire(kind) -> int:
    return I32 if isinstance(kind, Enum) else LIST if isinstance(kind, Many) else STRUCT if isinstance(kind, Struct) else TRUE if kind == FALSE else kind


def _zigzag(data: bytes, at: int) -> tuple[int, int]:
    n, at = _varint(data, at)
    return (n >> 1) ^ -(n & 1), at


def _varint(data: bytes, at: int) -> tuple[int, int]:
    try:
        n, end = read_varint(data, at)
    except IndexError:
        raise FormatError("number runs past the end", at) from None
    if end - at > 10:
        raise FormatError("number of over ten bytes", at)
    return n, end


def _value(data: bytes, at: int, wire: int, kind, depth: int):
    """(value, end) of a value on the wire; ``kind`` None: unknown, skipped over but read."""
    if depth > DEEPEST:
        raise FormatError("nested too deeply", at)
    if wire in (TRUE, FALSE):
        return wire == TRUE, at
    if wire == BYTE:
        if at >= len(data):
            raise FormatError("byte runs past the end", at)
        return struct.unpack_from("b", data, at)[0], at + 1
    if wire in (I16, I32, I64):
        n, at = _zigzag(data, at)
        return (kind.name.get(n, n) if isinstance(kind, Enum) else n), at
    if wire == DOUBLE:
        if at + 8 > len(data):
            raise FormatError("double runs past the end", at)
        return struct.unpack_from("<d", data, at)[0], at + 8
    if wire == BINARY:
        n, at = _varint(data, at)
        if at + n > len(data):
            raise FormatError("binary runs past the end", at)
        return bytes(data[at : at + n]), at + n
    if wire in (LIST, SET):
        if at >= len(data):
            raise FormatError("list runs past the end", at)
        head, at = data[at], at + 1
        n, inner = head >> 4, head & 15
        if n == 15:
            n, at = _varint(data, at)
        if n > len(data) - at:
            raise FormatError("list is longer than the data", at)
        out = []
        for _ in range(n):
            if inner in (TRUE, FALSE):
                v, at = data[at] == TRUE, at + 1
            else:
                v, at = _value(data, at, inner, kind.kind if isinstance(kind, Many) else None, depth + 1)
            out.append(v)
        return out, at
    if wire == STRUCT:
        return read(data, kind if isinstance(kind, Struct) else Struct({}), at, depth + 1)
    raise FormatError(f"unknown wire type {wire}", at)


def read(data: bytes, kind: Struct, at: int = 0, depth: int = 0) -> tuple[dict, int]:
    """(fields by name, end) of the struct at ``at``. Fields that ``kind`` does not know are skipped; absent ones are left out."""
    out, field = {}, 0
    while True:
        if at >= len(data):
            raise FormatError("struct without an end", at)
        head, at = data[at], at + 1
        if head == 0:
            break
        wire = head & 15
        if head >> 4:
            field += head >> 4
        else:
            field, at = _zigzag(data, at)
        name, inner = kind.fields.get(field, (None, None))
        if name and _wire(inner) != (TRUE if wire == FALSE else wire):
            raise FormatError(f"{name} has wire type {wire}", at)
        value, at = _value(data, at, wire, inner, depth)
        if name:
            out[name] = value
    missing = [r for r in kind.required if r not in out]
    if missing:
        raise FormatError(f"no {', '.join(missing)}", at)
    return out, at


def _put(value, kind) -> bytes:
    if isinstance(kind, Struct):
        return write(value, kind)
    if isinstance(kind, Many):
        inner = _wire(kind.kind)
        head = bytes([len(value) << 4 | inner]) if len(value) < 15 else bytes([0xF0 | inner]) + varint(len(value))
        return head + b"".join(bytes([TRUE if v else FALSE]) if inner == TRUE else _put(v, kind.kind) for v in value)
    if isinstance(kind, Enum):
        value, kind = kind.number.get(value, value), I32
    if kind == BYTE:
        return struct.pack("b", value)
    if kind == DOUBLE:
        return struct.pack("<d", value)
    if kind == BINARY:
        return varint(len(value)) + value
    return varint((value << 1 ^ value >> 63) & (1 << 64) - 1)


def write(value: dict, kind: Struct) -> bytes:
    """The struct's bytes; fields are written in the order of their ids, names that ``kind`` lacks are an error."""
    unknown = set(value) - set(kind.id)
    if unknown or any(value.get(r) is None for r in kind.required):
        raise FormatError(f"unknown fields {sorted(unknown)}" if unknown else f"no {[r for r in kind.required if value.get(r) is None]}")
    out, last = bytearray(), 0
    for i, (name, inner) in sorted(kind.fields.items()):
        v = value.get(name)
        if v is None:
            continue
        wire = _wire(inner)
        if wire == TRUE:
            wire = TRUE if v else FALSE
        out += bytes([i - last << 4 | wire]) if 0 < i - last < 16 else bytes([wire]) + _put(i, I16)
        out += b"" if wire in (TRUE, FALSE) else _put(v, inner)
        last = i
    return bytes(out) + b"\0"


# Fixed values of the Parquet format: its enumerations and structures, by the ids of their fields.

TYPE = Enum(BOOLEAN=0, INT32=1, INT64=2, INT96=3, FLOAT=4, DOUBLE=5, BYTE_ARRAY=6, FIXED_LEN_BYTE_ARRAY=7)
CONVERTED = Enum(UTF8=0, MAP=1, MAP_KEY_VALUE=2, LIST=3, ENUM=4, DECIMAL=5, DATE=6, TIME_MILLIS=7, TIME_MICROS=8, TIMESTAMP_MILLIS=9, TIMESTAMP_MICROS=10, UINT_8=11, UINT_16=12, UINT_32=13, UINT_64=14, INT_8=15, INT_16=16, INT_32=17, INT_64=18, JSON=19, BSON=20, INTERVAL=21)
REPETITION = Enum(REQUIRED=0, OPTIONAL=1, REPEATED=2)
ENCODING = Enum(PLAIN=0, PLAIN_DICTIONARY=2, RLE=3, BIT_PACKED=4, DELTA_BINARY_PACKED=5, DELTA_LENGTH_BYTE_ARRAY=6, DELTA_BYTE_ARRAY=7, RLE_DICTIONARY=8, BYTE_STREAM_SPLIT=9)
CODEC = Enum(UNCOMPRESSED=0, SNAPPY=1, GZIP=2, LZO=3, BROTLI=4, LZ4=5, ZSTD=6, LZ4_RAW=7)
PAGE = Enum(DATA_PAGE=0, INDEX_PAGE=1, DICTIONARY_PAGE=2, DATA_PAGE_V2=3)
BOUNDARY = Enum(UNORDERED=0, ASCENDING=1, DESCENDING=2)
EDGES = Enum(SPHERICAL=0, VINCENTY=1, THOMAS=2, ANDOYER=3, KARNEY=4)
EMPTY = Struct({})

STATISTICS = Struct({1: ("max", BINARY), 2: ("min", BINARY), 3: ("null_count", I64), 4: ("distinct_count", I64), 5: ("max_value", BINARY), 6: ("min_value", BINARY), 7: ("is_max_value_exact", TRUE), 8: ("is_min_value_exact", TRUE)})
SIZES = Struct({1: ("unencoded_byte_array_data_bytes", I64), 2: ("repetition_level_histogram", Many(I64)), 3: ("definition_level_histogram", Many(I64))})
TIME_UNIT = Struct({1: ("MILLIS", EMPTY), 2: ("MICROS", EMPTY), 3: ("NANOS", EMPTY)}, union=True)
DECIMAL = Struct({1: ("scale", I32), 2: ("precision", I32)}, required=("scale", "precision"))
TIMESTAMP = Struct({1: ("is_adjusted_to_utc", TRUE), 2: ("unit", TIME_UNIT)}, required=("is_adjusted_to_utc", "unit"))
INTEGER = Struct({1: ("bit_width", BYTE), 2: ("is_signed", TRUE)}, required=("bit_width", "is_signed"))
LOGICAL = Struct(
    {1: ("STRING", EMPTY), 2: ("MAP", EMPTY), 3: ("LIST", EMPTY), 4: ("ENUM", EMPTY), 5: ("DECIMAL", DECIMAL), 6: ("DATE", EMPTY), 7: ("TIME", TIMESTAMP), 8: ("TIMESTAMP", TIMESTAMP), 10: ("INTEGER", INTEGER), 11: ("UNKNOWN", EMPTY), 12: ("JSON", EMPTY), 13: ("BSON", EMPTY), 14: ("UUID", EMPTY), 15: ("FLOAT16", EMPTY), 16: ("VARIANT", Struct({1: ("specification_version", BYTE)})), 17: ("GEOMETRY", Struct({1: ("crs", BINARY)})), 18: ("GEOGRAPHY", Struct({1: ("crs", BINARY), 2: ("algorithm", EDGES)}))},
    union=True,
)
SCHEMA_ELEMENT = Struct({1: ("type", TYPE), 2: ("type_length", I32), 3: ("repetition_type", REPETITION), 4: ("name", BINARY), 5: ("num_children", I32), 6: ("converted_type", CONVERTED), 7: ("scale", I32), 8: ("precision", I32), 9: ("field_id", I32), 10: ("logical_type", LOGICAL)}, required=("name",))
KEY_VALUE = Struct({1: ("key", BINARY), 2: ("value", BINARY)}, required=("key",))
SORTING = Struct({1: ("column_idx", I32), 2: ("descending", TRUE), 3: ("nulls_first", TRUE)}, required=("column_idx", "descending", "nulls_first"))
PAGE_ENCODING = Struct({1: ("page_type", PAGE), 2: ("encoding", ENCODING), 3: ("count", I32)}, required=("page_type", "encoding", "count"))
COLUMN = Struct(
    {1: ("type", TYPE), 2: ("encodings", Many(ENCODING)), 3: ("path_in_schema", Many(BINARY)), 4: ("codec", CODEC), 5: ("num_values", I64), 6: ("total_uncompressed_size", I64), 7: ("total_compressed_size", I64), 8: ("key_value_metadata", Many(KEY_VALUE)), 9: ("data_page_offset", I64), 10: ("index_page_offset", I64), 11: ("dictionary_page_offset", I64), 12: ("statistics", STATISTICS), 13: ("encoding_stats", Many(PAGE_ENCODING)), 14: ("bloom_filter_offset", I64), 15: ("bloom_filter_length", I32), 16: ("size_statistics", SIZES)},
    required=("type", "encodings", "path_in_schema", "codec", "num_values", "total_uncompressed_size", "total_compressed_size", "data_page_offset"),
)
COLUMN_KEY = Struct({1: ("path_in_schema", Many(BINARY)), 2: ("key_metadata", BINARY)}, required=("path_in_schema",))
COLUMN_CRYPTO = Struct({1: ("ENCRYPTION_WITH_FOOTER_KEY", EMPTY), 2: ("ENCRYPTION_WITH_COLUMN_KEY", COLUMN_KEY)}, union=True)
CHUNK = Struct({1: ("file_path", BINARY), 2: ("file_offset", I64), 3: ("meta_data", COLUMN), 4: ("offset_index_offset", I64), 5: ("offset_index_length", I32), 6: ("column_index_offset", I64), 7: ("column_index_length", I32), 8: ("crypto_metadata", COLUMN_CRYPTO), 9: ("encrypted_column_metadata", BINARY)}, required=("file_offset",))
ROW_GROUP = Struct({1: ("columns", Many(CHUNK)), 2: ("total_byte_size", I64), 3: ("num_rows", I64), 4: ("sorting_columns", Many(SORTING)), 5: ("file_offset", I64), 6: ("total_compressed_size", I64), 7: ("ordinal", I16)}, required=("columns", "total_byte_size", "num_rows"))
GCM = Struct({1: ("aad_prefix", BINARY), 2: ("aad_file_unique", BINARY), 3: ("supply_aad_prefix", TRUE)})
ALGORITHM = Struct({1: ("AES_GCM_V1", GCM), 2: ("AES_GCM_CTR_V1", GCM)}, union=True)
COLUMN_ORDER = Struct({1: ("TYPE_ORDER", EMPTY)}, union=True)
FILE = Struct({1: ("version", I32), 2: ("schema", Many(SCHEMA_ELEMENT)), 3: ("num_rows", I64), 4: ("row_groups", Many(ROW_GROUP)), 5: ("key_value_metadata", Many(KEY_VALUE)), 6: ("created_by", BINARY), 7: ("column_orders", Many(COLUMN_ORDER)), 8: ("encryption_algorithm", ALGORITHM), 9: ("footer_signing_key_metadata", BINARY)}, required=("version", "schema", "num_rows", "row_groups"))
FILE_CRYPTO = Struct({1: ("encryption_algorithm", ALGORITHM), 2: ("key_metadata", BINARY)}, required=("encryption_algorithm",))
LOCATION = Struct({1: ("offset", I64), 2: ("compressed_page_size", I32), 3: ("first_row_index", I64)}, required=("offset", "compressed_page_size", "first_row_index"))
OFFSET_INDEX = Struct({1: ("page_locations", Many(LOCATION)), 2: ("unencoded_byte_array_data_bytes", Many(I64))}, required=("page_locations",))
COLUMN_INDEX = Struct({1: ("null_pages", Many(TRUE)), 2: ("min_values", Many(BINARY)), 3: ("max_values", Many(BINARY)), 4: ("boundary_order", BOUNDARY), 5: ("null_counts", Many(I64)), 6: ("repetition_level_histograms", Many(I64)), 7: ("definition_level_histograms", Many(I64))}, required=("null_pages", "min_values", "max_values", "boundary_order"))
DATA_PAGE = Struct({1: ("num_values", I32), 2: ("encoding", ENCODING), 3: ("definition_level_encoding", ENCODING), 4: ("repetition_level_encoding", ENCODING), 5: ("statistics", STATISTICS)}, required=("num_values", "encoding"))
DICTIONARY_PAGE = Struct({1: ("num_values", I32), 2: ("encoding", ENCODING), 3: ("is_sorted", TRUE)}, required=("num_values", "encoding"))
DATA_PAGE_V2 = Struct({1: ("num_values", I32), 2: ("num_nulls", I32), 3: ("num_rows", I32), 4: ("encoding", ENCODING), 5: ("definition_levels_byte_length", I32), 6: ("repetition_levels_byte_length", I32), 7: ("is_compressed", TRUE), 8: ("statistics", STATISTICS)}, required=("num_values", "num_nulls", "num_rows", "encoding"))
PAGE_HEADER = Struct({1: ("type", PAGE), 2: ("uncompressed_page_size", I32), 3: ("compressed_page_size", I32), 4: ("crc", I32), 5: ("data_page_header", DATA_PAGE), 6: ("index_page_header", EMPTY), 7: ("dictionary_page_header", DICTIONARY_PAGE), 8: ("data_page_header_v2", DATA_PAGE_V2)}, required=("type", "uncompressed_page_size", "compressed_page_size"))
BLOOM_HEADER = Struct({1: ("num_bytes", I32), 2: ("algorithm", Struct({1: ("BLOCK", EMPTY)}, union=True)), 3: ("hash", Struct({1: ("XXHASH", EMPTY)}, union=True)), 4: ("compression", Struct({1: ("UNCOMPRESSED", EMPTY)}, union=True))}, required=("num_bytes", "algorithm", "hash", "compression"))


def chosen(union: dict) -> str | None:
    """The name of a union's field; None where the file has one that this table does not know."""
    return next(iter(union), None)


def logical_name(element: dict) -> str | None:
    """A readable logical type such as ``TIMESTAMP(utc, MICROS)``; the converted type where there is only that."""
    kind = element.get("logical_type")
    name = chosen(kind) if kind is not None else None
    if name is None:
        return element.get("converted_type")
    about = kind[name]
    parts = {
        "DECIMAL": lambda: [about["precision"], about["scale"]],
        "INTEGER": lambda: [about["bit_width"], "signed" if about["is_signed"] else "unsigned"],
        "TIME": lambda: ["utc" if about["is_adjusted_to_utc"] else "local", chosen(about["unit"])],
        "TIMESTAMP": lambda: ["utc" if about["is_adjusted_to_utc"] else "local", chosen(about["unit"])],
        "VARIANT": lambda: [about.get("specification_version")],
        "GEOMETRY": lambda: [about.get("crs", b"").decode()],
        "GEOGRAPHY": lambda: [about.get("crs", b"").decode(), about.get("algorithm")],
    }.get(name, list)()
    parts = [str(p) for p in parts if p not in (None, "")]
    return f"{name}({', '.join(parts)})" if parts else name
