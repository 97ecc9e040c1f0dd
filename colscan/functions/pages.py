"""Pages of a column chunk: headers, bodies, levels and values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import codecs, thrift


class PageWalker:
    """(header, body) of each page in a chunk's bytes, up to ``limit``; ``position`` is where the next one begins."""

    def __init__(self, data: bytes, limit: int | None = None):
        self.data, self.position = data, 0
        self.limit = len(data) if limit is None else min(limit, len(data))

    def next_page(self) -> tuple[dict, bytes] | None:
        if self.position >= self.limit:
            return None
        header, body = thrift.read(self.data, thrift.PAGE_HEADER, self.position)
        end = body + header["compressed_page_size"]
        if header["compressed_page_size"] < 0 or end > self.limit:
            raise thrift.FormatError("page runs past the chunk", body)
        self.position = end
        return header, self.data[body:end]

    def __iter__(self) -> Iterator[tuple[dict, bytes]]:
        while (page := self.next_page()) is not None:
            yield page


def bit_width(n: int) -> int:
    """Bits that hold 0..n."""
    return int(n).bit_length()


def decode_levels(data: bytes, highest: int, n: int, prefixed: bool = True) -> tuple[np.ndarray, int]:
    """(levels, bytes taken): the RLE hybrid, in V1 pages behind a 32-bit length. No bytes are taken where the highest level is 0."""
    if highest == 0:
        return np.zeros(n, np.int64), 0
    size = int.from_bytes(data[:4], "little") if prefixed else len(data)
    begin = 4 if prefixed else 0
    if begin + size > len(data):
        raise thrift.FormatError("levels run past the page")
    levels = codecs.hybrid_decode(data[begin : begin + size], bit_width(highest), n).astype(np.int64)
    if len(levels) and levels.max() > highest:
        raise thrift.FormatError(f"level {levels.max()} over {highest}")
    return levels, begin + size


def split_v1(body: bytes, n: int, max_rep: int, max_def: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(repetition levels, definition levels, value bytes) of a V1 data page's uncompressed body."""
    rep, a = decode_levels(body, max_rep, n)
    define, b = decode_levels(body[a:], max_def, n)
    return rep, define, body[a + b :]


def split_v2(body: bytes, header: dict, max_rep: int, max_def: int, codec: str = "uncompressed") -> tuple[np.ndarray, np.ndarray, bytes]:
    """The same of a V2 page's body as it stands in the file: its levels are never compressed, its values may be."""
    about = header["data_page_header_v2"]
    a = about.get("repetition_levels_byte_length", 0)
    b = a + about.get("definition_levels_byte_length", 0)
    rep, _ = decode_levels(body[:a], max_rep, about["num_values"], prefixed=False)
    define, _ = decode_levels(body[a:b], max_def, about["num_values"], prefixed=False)
    values = body[b:]
    if about.get("is_compressed", True) and codec != "uncompressed" and values:
        values = codecs.decompress(values, codec, header["uncompressed_page_size"] - b)
    return rep, define, values


def decode_values(data: bytes, encoding: str, kind: str, n: int, dictionary=None, width: int = 0):
    """``n`` values of one page; ``kind`` is a physical type in lower case, ``width`` the bytes of a fixed-length one."""
    if encoding in ("RLE_DICTIONARY", "PLAIN_DICTIONARY"):
        codes = codecs.hybrid_decode(data[1:], data[0], n) if n else np.zeros(0, np.uint64)
        return codecs.lookup(dictionary, codes)
    if encoding == "PLAIN":
        return codecs.plain(data, kind, n, width)
    if encoding == "DELTA_BINARY_PACKED":
        return codecs.delta_decode(data).astype(codecs.TYPES[kind])
    if encoding == "DELTA_LENGTH_BYTE_ARRAY":
        return codecs.delta_length_decode(data)
    if encoding == "DELTA_BYTE_ARRAY":
        return codecs.delta_bytes_decode(data)
    if encoding == "BYTE_STREAM_SPLIT":
        return codecs.stream_split_decode(data, kind)
    if encoding == "RLE" and kind == "boolean":
        return codecs.hybrid_decode(data[4:], 1, n).astype(bool)
    raise thrift.FormatError(f"no decoder of {kind} in {encoding}")


def decode_pages(data: bytes, column: dict, max_def: int = 0, max_rep: int = 0, width: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | list]]:
    """(repetition levels, definition levels, values that are not null) of each data page of a chunk, by its metadata ``column``."""
    kind, codec, dictionary = str(column["type"]).lower(), str(column["codec"]).lower(), None
    for header, body in PageWalker(data):
        if header["type"] == "DICTIONARY_PAGE":
            about = header["dictionary_page_header"]
            dictionary = codecs.plain(codecs.decompress(body, codec, header["uncompressed_page_size"]), kind, about["num_values"], width)
            continue
        if header["type"] == "DATA_PAGE":
            about = header["data_page_header"]
            rep, define, values = split_v1(codecs.decompress(body, codec, header["uncompressed_page_size"]), about["num_values"], max_rep, max_def)
        elif header["type"] == "DATA_PAGE_V2":
            about = header["data_page_header_v2"]
            rep, define, values = split_v2(body, header, max_rep, max_def, codec)
        else:
            continue
        yield rep, define, decode_values(values, about["encoding"], kind, int((define == max_def).sum()), dictionary, width)


def decode_chunk(data: bytes, column: dict, max_def: int = 0, max_rep: int = 0, width: int = 0) -> tuple[np.ndarray, np.ndarray, list]:
    """(repetition levels, definition levels, values that are not null) of a whole chunk, by its metadata ``column``."""
    reps, defs, out = [], [], []
    for rep, define, values in decode_pages(data, column, max_def, max_rep, width):
        reps.append(rep)
        defs.append(define)
        out += list(values)
    return (np.concatenate(reps) if reps else np.zeros(0, int)), (np.concatenate(defs) if defs else np.zeros(0, int)), out
