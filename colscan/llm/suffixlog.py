"""Substring dedup by a logarithmic family of suffix arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Repeats

#: Bytes of a stretch, and of the pieces whose least hash names it.
LENGTH, GRAM = 50, 24
#: Suffixes of a batch.
BATCH = 1 << 16
#: Bytes of text for each shard; each group of documents sends a packed row to each shard, so few are better. An array
#: keeps its places in 32 bits, so a shard's segments have less than 2 GB.
SHARD_BYTES = 16 << 20


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, in byte order: a view of the bytes, which are not copied."""
    return np.ndarray(max(0, len(data) - 7), ">u8", data, 0, (1,))


class Family:
    """Suffix arrays of geometrically growing size over batches of places of one text, in document order.

    An array is the sorted places of its batches, ordered by the ``length`` bytes that follow, with the first eight of
    these and the least id that has them; places with equal bytes stand once. A batch is sorted and scanned against
    every array; what none has forms a new array, and arrays of like size merge.
    """

    def __init__(self, data: np.ndarray, length: int):
        self.length, self.levels = length, []
        words = -(-length // 8)
        self.eights = eights(np.concatenate((data, np.zeros(8 * words + 8, np.uint8))))
        self.steps = range(0, 8 * words, 8)
        self.rest = np.uint64(8 * (8 * words - length))

    def word(self, places: np.ndarray, step: int) -> np.ndarray:
        w = self.eights[places + step].astype(np.uint64)
        return w >> self.rest << self.rest if step == self.steps[-1] else w

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at each a is less than, equal to or greater than that at b, after equal first words."""
        out = np.zeros(len(a), np.int8)
        open_ = np.arange(len(a))
        for step in self.steps[1:] if len(self.steps) > 1 else self.steps:
            x, y = self.word(a[open_], step), self.word(b[open_], step)
            out[open_] = (x > y).astype(np.int8) - (x < y)
            open_ = open_[x == y]
            if not len(open_):
                break
        return out

    def scan(self, heads: np.ndarray, places: np.ndarray, level: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(place in the level, whether it is the same) of each of the sorted suffixes."""
        keys, have, _ = level
        lo, hi = np.searchsorted(keys, heads, "left"), np.searchsorted(keys, heads, "right")
        same = np.zeros(len(places), bool)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            order = self.compare(have[mid], places[live])
            same[live] |= order == 0
            lo[live] = np.where(order < 0, mid + 1, np.where(order == 0, mid, lo[live]))
            hi[live] = np.where(order < 0, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo, same

    def add(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """True at places whose suffix a document of smaller id has, in this batch or an earlier one."""
        order = np.lexsort([self.word(places, s) for s in reversed(self.steps)])
        s, i = places[order], ids[order]
        head = self.word(s, 0)
        differ = np.r_[True, head[1:] != head[:-1]]
        near = np.flatnonzero(~differ)
        differ[near] = self.compare(s[near], s[near - 1]) != 0
        first = np.flatnonzero(differ)
        size = np.diff(np.r_[first, len(s)])
        least = np.minimum.reduceat(i, first)
        s, head = s[first], head[first]
        new = np.ones(len(s), bool)
        for level in self.levels:
            at, hit = self.scan(head, s, level)
            least[hit] = np.minimum(least[hit], level[2][at[hit]])
            new &= ~hit
        out = np.empty(len(order), bool)
        out[order] = i > np.repeat(least, size)
        if new.any():
            self.levels.append((head[new], s[new].astype(np.int32), least[new]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            small, large = self.levels.pop(), self.levels.pop()
            at, _ = self.scan(small[0], small[1], large)  # the arrays have no suffix in common
            self.levels.append(tuple(np.insert(y, at, x) for x, y in zip(small, large, strict=True)))
        return out


def decide(job: Repeats, data, bounds, ids, keys, start, size) -> np.ndarray:
    """Batches the segments by id and runs them through the family; True at stretches of smaller ids."""
    base = np.cumsum(size) - size
    order = np.argsort(ids, kind="stable")
    family = Family(data, job.length)
    out = np.zeros(int(size.sum()), bool)
    done = np.cumsum(size[order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + BATCH, "right")))
        own = order[a:b]
        n = size[own]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(base[own], n) + step] = family.add(np.repeat(bounds[own], n) + step, np.repeat(ids[own], n))
        a = b
    return out


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row: bytes that an earlier document has are removed.

    Removed is each byte under a string of ``length`` bytes that starts in a document of smaller id too. Rows of one
    id are never earlier than each other. A null id comes after all others; null texts are empty; a text of any length
    is taken whole. Other columns of ``docs``, of whatever names, are not read. Empty tables give no rows.
    """
    out = Repeats(length, min(GRAM, length // 2), False, False, decide, SHARD_BYTES)(docs, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept")


def bytes_sql(length: int = LENGTH) -> str:
    """DuckDB form of ``dedup_bytes`` over documents(doc_id, text) with unique ids, without the kept bytes; strings of bytes as hex.

    Texts are cut into pieces first, since a place in a long string takes long to find. A hash picks the strings that are compared.
    """
    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
     p as (select doc_id, 200 * j as base, substr(h, 400 * j + 1, {2 * length + 400}) as t, least(200, n - {length - 1} - 200 * j) as m from (select *, unnest(range(0, (n + 199) // 200)) as j from d)),
     g as (select doc_id, base + i as i, substr(t, 2 * i + 1, {2 * length}) as s, hash(substr(t, 2 * i + 1, {2 * length})) as x from (select *, unnest(range(0, m)) as i from p)),
     m as (select x from g group by x having min(doc_id) < max(doc_id)),
     w as (select doc_id, i, s from g semi join m using (x)),
     f as (select s, min(doc_id) as first from w group by s),
     r as (select doc_id, i from w join f using (s) where doc_id > first),
     e as (select doc_id, i, i > lag(i) over (partition by doc_id order by i) + {length} as apart from r),
     o as (select doc_id, i, sum(case when apart is distinct from false then 1 else 0 end) over (partition by doc_id order by i) as span from e),
     v as (select doc_id, span, min(i) as a, max(i) + {length} as b from o group by doc_id, span),
     q as (select doc_id, sum(b - a)::bigint as removed, count(*) as spans, max(b) as last from v group by doc_id),
     z as (select doc_id, a, coalesce(lag(b) over (partition by doc_id order by a), 0) as begin from v),
     k as (select doc_id, string_agg(substr(h, 2 * begin + 1, 2 * (a - begin)), '' order by a) as kept from z join d using (doc_id) group by doc_id)
select d.doc_id, d.n as n_bytes, coalesce(q.removed, 0) as n_removed, coalesce(q.spans, 0) as n_spans,
       sha256(unhex(case when q.removed is null then d.h else k.kept || substr(d.h, 2 * q.last + 1) end)) as kept_sha256
from d left join q using (doc_id) left join k using (doc_id)
"""
