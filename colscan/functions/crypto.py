"""Authenticated encryption of values and modules: AES-GCM with the Parquet module AAD.

Encryption runs in Spark's own functions, so a module is a column of bytes, and a context says with which key and for which
row group and column it is sealed.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Module types of the Parquet encryption specification.
MODULES = {"footer": 0, "column_meta": 1, "data_page": 2, "dictionary_page": 3, "data_page_header": 4, "dictionary_page_header": 5, "column_index": 6, "offset_index": 7, "bloom_header": 8, "bloom_bits": 9}
NONCE, TAG = 12, 16
#: The modules that have a page ordinal, and the one that has no ordinals at all.
PAGED, FOOTER = ("data_page", "data_page_header"), "footer"


def has_page_ordinal(module: str) -> bool:
    return module in PAGED


def module_aad(prefix: bytes, unique: bytes, module: str, row_group: int | None = None, column: int | None = None, page: int | None = None) -> bytes:
    """prefix, file id, module type, then the 16-bit little-endian ordinals that the module has."""
    ordinals = () if module == FOOTER else (row_group, column, page) if has_page_ordinal(module) else (row_group, column)
    if any(n is None or not 0 <= n < 1 << 15 for n in ordinals):
        raise ValueError(f"{module} needs {len(ordinals)} ordinals of 15 bits")
    return prefix + unique + bytes([MODULES[module]]) + b"".join(n.to_bytes(2, "little") for n in ordinals)


def frame(body: bytes) -> bytes:
    """A module: 32-bit little-endian length, then nonce, ciphertext and tag."""
    if len(body) < NONCE + TAG:
        raise ValueError("too short for nonce and tag")
    return len(body).to_bytes(4, "little") + body


def unframe(data: bytes) -> bytes:
    n = int.from_bytes(data[:4], "little")
    if n < NONCE + TAG or len(data) < 4 + n:
        raise ValueError("truncated module")
    return data[4 : 4 + n]


def check_key(key: bytes) -> bytes:
    if len(key) not in (16, 32):
        raise ValueError("keys have 128 or 256 bits")
    return key


def encrypt(value: Column, key: bytes, aad: bytes) -> Column:
    """Nonce, ciphertext and tag of a string or binary column."""
    return F.aes_encrypt(value.cast("binary"), F.lit(check_key(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad))


def decrypt(value: Column, key: bytes, aad: bytes) -> Column:
    """The plain bytes; a wrong key or AAD is an error."""
    return F.aes_decrypt(value, F.lit(check_key(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def try_decrypt(value: Column, key: bytes, aad: bytes) -> Column:
    """The plain bytes; null for a wrong key or AAD."""
    return F.try_aes_decrypt(value, F.lit(check_key(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def rotate(df: DataFrame, column: str, old: bytes, new: bytes, aad: bytes) -> DataFrame:
    return df.withColumn(column, encrypt(decrypt(F.col(column), old, aad), new, aad))


class KeyRetriever(Protocol):
    """Where keys come from, by the metadata that a file has for them."""

    def footer_key(self, key_metadata: bytes | None) -> bytes: ...

    def column_key(self, path: str, key_metadata: bytes | None) -> bytes: ...


@dataclass
class StaticKeys:
    """Keys held in memory. A column without a key of its own has the footer's."""

    footer: bytes | None = None
    columns: dict[str, bytes] = field(default_factory=dict)

    def set_footer(self, key: bytes) -> StaticKeys:
        self.footer = check_key(key)
        return self

    def set_column(self, path: str, key: bytes) -> StaticKeys:
        self.columns[path] = check_key(key)
        return self

    def footer_key(self, key_metadata: bytes | None = None) -> bytes:
        if self.footer is None:
            raise KeyError("no footer key")
        return self.footer

    def column_key(self, path: str, key_metadata: bytes | None = None) -> bytes:
        return self.columns[path] if path in self.columns else self.footer_key(key_metadata)


def random_bytes(n: int) -> bytes:
    return os.urandom(n)


class NonceSource(Protocol):
    """The nonce of each module as a column, or None for one that Spark draws at random."""

    def nonce(self, number: Column) -> Column | None: ...


class RandomNonces:
    """A random nonce for each module."""

    def nonce(self, number: Column) -> None:
        return None


def little_endian(n: Column, size: int) -> Column:
    """A number's ``size`` lowest bytes, lowest first."""
    text = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(size)]))


@dataclass
class CountedNonces:
    """A fixed prefix of four bytes, then a counter: for tests, and where numbers never repeat under a key."""

    prefix: bytes
    start: int = 0

    def __post_init__(self):
        if len(self.prefix) != NONCE - 8:
            raise ValueError(f"prefix of {len(self.prefix)} bytes")

    def nonce(self, number: Column) -> Column:
        return F.concat(F.lit(self.prefix), little_endian(number + self.start, 8))


@dataclass
class ModuleContext:
    """Key, AAD and ordinals of the modules of one column chunk, or of a footer (which has no ordinals)."""

    key: bytes
    unique: bytes
    prefix: bytes = b""
    row_group: int | None = None
    column: int | None = None
    nonces: NonceSource = field(default_factory=RandomNonces)

    def __post_init__(self):
        check_key(self.key)

    def aad(self, module: str, page: int | None = None) -> bytes:
        return module_aad(self.prefix, self.unique, module, self.row_group, self.column, page)


def encrypt_module(plain: Column, context: ModuleContext, module: str, page: int | None = None, number: Column | None = None) -> Column:
    """A framed module: 32-bit little-endian length, nonce, ciphertext and tag. ``number`` numbers the modules of a nonce source."""
    nonce = context.nonces.nonce(number if number is not None else F.lit(0))
    body = F.aes_encrypt(plain.cast("binary"), F.lit(context.key), F.lit("GCM"), F.lit("DEFAULT"), nonce if nonce is not None else F.lit(b""), F.lit(context.aad(module, page)))
    return F.concat(little_endian(F.octet_length(body), 4), body)


def module_length(framed: Column) -> Column:
    """Bytes of the module at the beginning of some bytes, its length included."""
    text = F.hex(F.substring(framed, 1, 4))
    return F.conv(F.concat(*[F.substring(text, 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("long") + 4


def decrypt_module(framed: Column, context: ModuleContext, module: str, page: int | None = None) -> Column:
    """(plain, used) of the module at the beginning of some bytes; a truncated one, a wrong key or AAD is an error."""
    used = module_length(framed)
    whole = (F.octet_length(framed) >= used) & (used >= 4 + NONCE + TAG)
    body = F.substring(framed, F.lit(5), (used - 4).cast("int"))
    plain = F.when(whole, decrypt(body, context.key, context.aad(module, page))).otherwise(F.raise_error(F.lit("truncated module")))
    return F.struct(plain.alias("plain"), used.alias("used"))


def encrypt_footer(plain: Column, context: ModuleContext) -> Column:
    return encrypt_module(plain, context, FOOTER)


def decrypt_footer(framed: Column, context: ModuleContext) -> Column:
    return decrypt_module(framed, context, FOOTER)["plain"]


def split_encrypted_footer(trailer: bytes) -> tuple[dict, bytes]:
    """(what the file says of its encryption, the framed footer) of the bytes between a file's pages and its length."""
    from . import thrift

    about, end = thrift.read(trailer, thrift.FILE_CRYPTO)
    unframe(trailer[end:])
    return about, trailer[end:]


def join_encrypted_footer(about: dict, framed: bytes) -> bytes:
    from . import thrift

    return thrift.write(about, thrift.FILE_CRYPTO) + framed
