"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items of up to ``SMALLEST`` shingles are too small for minima of windows and are looked up exactly: an item of n
shingles that a document holds to ``THRESHOLD`` misses less than (1 - ``THRESHOLD``) n of them, so the document has at
least one of any so many and one more. An item of one to four words is looked up as that run of words.

Longer items are partitioned by their number of shingles, each partition up to twice the size of the one
before. For a partition of up to u shingles, every document is seen as overlapping windows of 1.5 u
shingles, u/2 apart, so a copied item lies whole in one window and the Jaccard similarity of item and window
is bounded from below (0.25 in the worst case, a containment of 0.8 of the smallest item of its partition).
A window and an item that share one of ``PERMUTATIONS`` minima are a candidate: at that worst case one pair in
ten thousand is missed. Candidates are verified by exact containment over the whole document, on the words themselves.

``smallest=None`` looks up every item like the small ones: a dearer search that misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered_rows, sliced
from .wordhash import Words, encoded, mix, slabs, spans

#: Words of a shingle; shingles of an item that a document must hold.
WIDTH, THRESHOLD = 5, 0.8
PERMUTATIONS = 32
#: Shingles of the largest items that are looked up exactly; the size partitions begin above.
SMALLEST = 16
#: Test items searched for in one pass over the documents; this bounds what each task is sent.
ITEMS = 20_000
#: Low bits of a hash that a bitmap holds, so that most places of a text are passed over at once.
_LOW = np.uint64((1 << 20) - 1)
_MUL = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=np.uint64))


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, A-Z lower-cased; a text of one to four words is one shingle."""
    return _shingles(Words([t.lower() for t in encoded(texts)]), len(texts))


def _shingles(w: Words, n: int) -> list[np.ndarray]:
    gram, at = w.grams(WIDTH)
    doc = w.doc[at]
    cut = np.searchsorted(doc, np.arange(n + 1))
    return [np.unique(gram[a:b]) if b > a else short(w, i) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


def short(w: Words, i: int) -> np.ndarray:
    """The one shingle of a text of fewer than five words."""
    a, b = w.bounds[i : i + 1], w.bounds[i + 1 : i + 2]
    return spans(w.hash, a, b) if b > a else w.hash[:0]


class Exact:
    """Hashes and the items that have them."""

    def __init__(self, found: list[tuple[int, int]]):
        self.hash, self.item = np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found], dtype=np.int64)
        order = np.argsort(self.hash)
        self.hash, self.item = self.hash[order], self.item[order]
        self.seen = np.zeros(int(_LOW) + 1, dtype=bool)
        self.seen[self.hash & _LOW] = True

    def pairs(self, gram: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of a text and an item that has one of its hashes."""
        hit = np.flatnonzero(self.seen[gram & _LOW])
        left, right = np.searchsorted(self.hash, gram[hit], "left"), np.searchsorted(self.hash, gram[hit], "right")
        n = right - left
        at = np.repeat(left - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else left
        return set(zip(np.repeat(doc[hit], n).tolist(), self.item[at].tolist(), strict=True))


class Items:
    """Signatures of a bounded block of test items, by size partition."""

    def __init__(self, ids: list[int], texts: list[str | None], smallest: int | None = SMALLEST):
        raw = [t.lower() for t in encoded(texts)]
        self.words = [t.split() for t in raw]
        w = Words(raw)
        self.sets = dict(enumerate(_shingles(w, len(texts))))
        self.ids = ids
        n_words = np.diff(w.bounds)
        #: number of words -> items of so many, under ``WIDTH``
        self.short = {k: Exact([(self.sets[i][0], i) for i in np.flatnonzero(n_words == k).tolist()]) for k in range(1, WIDTH) if (n_words == k).any()}
        small = [i for i, s in self.sets.items() if n_words[i] >= WIDTH and (smallest is None or len(s) <= smallest)]
        #: items of up to ``SMALLEST`` shingles, under as many of their shingles as a document cannot miss all of
        self.small = Exact([(h, i) for i in small for h in self.sets[i][: len(self.sets[i]) - int(np.ceil(THRESHOLD * len(self.sets[i]) - 1e-9)) + 1].tolist()])
        levels: dict[int, list[int]] = {}
        for i, s in self.sets.items():
            if smallest is not None and len(s) > smallest:
                levels.setdefault(max(0, int(np.ceil(np.log2(len(s) / SMALLEST)))), []).append(i)
        #: level -> for each permutation (sorted minima, the items that have them)
        self.levels = {}
        for level, own in levels.items():
            tables = []
            for mul, add in zip(_MUL, _ADD, strict=True):
                low = np.array([(self.sets[i] * mul + add).min() for i in own], dtype=np.uint64)
                order = np.argsort(low)
                tables.append((low[order], np.array(own)[order]))
            self.levels[level] = tables
        self.bits: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"bits": {}}  # bitmaps are large and soon made again

    def seen(self, level: int, n: int) -> np.ndarray:
        """A bitmap of the low bits of a table's minima."""
        if (level, n) not in self.bits:
            self.bits[level, n] = bits = np.zeros(1 << 18, dtype=bool)
            bits[self.levels[level][n][0] & np.uint64((1 << 18) - 1)] = True
        return self.bits[level, n]

    def containment(self, item: int, words: list[bytes]) -> float:
        """How much of an item's shingles a document has, by the words themselves; 0 or 1 for an item of one shingle."""
        mine = self.words[item]
        width = min(WIDTH, len(mine))
        grams = lambda x: {tuple(x[i : i + width]) for i in range(len(x) - width + 1)}
        own = grams(mine)
        return len(own & grams(words)) / len(own)

    def found(self, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
        """(text index, item id, containment) for all texts."""
        for first, part in slabs([t.lower() for t in encoded(texts)]):
            yield from ((first + i, self.ids[j], c) for i, j, c in self._slab(part))

    def _slab(self, texts: list[bytes]) -> Iterator[tuple[int, int, float]]:
        w = Words(texts)
        gram, at = w.grams(WIDTH)
        doc = w.doc[at]
        whole = []
        for k, items in self.short.items():
            runs, first = w.grams(k)
            whole += items.pairs(runs, w.doc[first])
        sure = lambda i, j: self.containment(j, texts[i].split())
        yield from ((i, j, 1.0) for i, j in sorted(set(whole)) if sure(i, j) == 1)
        if not len(gram):
            return
        begins = np.searchsorted(doc, np.arange(len(texts) + 1))
        pairs = self.small.pairs(gram, doc)
        within = np.arange(len(gram)) - begins[doc]
        starts = np.flatnonzero(within % (SMALLEST // 2) == 0)
        for n, (mul, add) in enumerate(zip(_MUL, _ADD, strict=True)):
            low, block_doc = np.minimum.reduceat(gram * mul + add, starts), doc[starts]
            for level in range(max(self.levels, default=-1) + 1):
                if level:
                    ordinal = np.arange(len(low)) - np.searchsorted(block_doc, block_doc)
                    even = np.flatnonzero(ordinal % 2 == 0)
                    low, block_doc = np.minimum.reduceat(low, even), block_doc[even]
                if level not in self.levels:
                    continue
                window = low.copy()
                for d in (1, 2):
                    same = np.flatnonzero(block_doc[:-d] == block_doc[d:])
                    window[same] = np.minimum(window[same], low[same + d])
                minima, items = self.levels[level][n]
                hit = np.flatnonzero(self.seen(level, n)[window & np.uint64((1 << 18) - 1)])
                left, right = np.searchsorted(minima, window[hit], "left"), np.searchsorted(minima, window[hit], "right")
                for h, a, b in zip(hit[left < right], left[left < right], right[left < right], strict=True):
                    pairs.update((int(block_doc[h]), int(i)) for i in items[a:b])
        for i, j in sorted(pairs):
            # equal words have equal hashes, so what the hashes rule out is out; the rest is counted exactly
            if np.isin(self.sets[j], gram[begins[i] : begins[i + 1]]).mean() >= THRESHOLD and (c := sure(i, j)) >= THRESHOLD:
                yield i, j, c


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", smallest: int | None = SMALLEST) -> Iterator[Items]:
    """The test items in blocks of about ``ITEMS``; items without a word match nothing."""
    n = -(-bench.count() // ITEMS)
    rows = bench.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        yield Items([r.id for r in own], [r.text for r in own], smallest)


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", smallest: int | None = SMALLEST) -> DataFrame:
    """(doc_id, item_id, containment) for each document that holds at least ``THRESHOLD`` of an item's shingles.

    Case of A-Z and the kind of white space do not matter. Null and blank texts match nothing. An item of one to
    four words is one shingle and matches a document with this run of words. Repeated rows report each for itself;
    null ids are reported as null; texts of any length are taken whole; other columns, of whatever names, are not read. An
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for items in blocks(bench, item_col, smallest=smallest):

        def run(batches, items=spark.sparkContext.broadcast(items)):
            for b in sliced(batches):
                ids, rows = b.column(0), list(items.value.found(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["doc_id", "item_id", "containment"])

        found = slim.mapInArrow(run, "doc_id long, item_id long, containment double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, containment double")


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", smallest: int | None = SMALLEST) -> DataFrame:
    """The rows of ``docs`` that hold no test item, all columns unchanged and of any names, without a shuffle."""
    for items in blocks(bench, smallest=smallest):

        def run(batches, items=docs.sparkSession.sparkContext.broadcast(items), at=docs.columns.index(text_col)):
            for b in sliced(batches):
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[i for i, _, _ in items.value.found(b.column(at).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        docs = filtered_rows(docs, run)
    return docs


def leaks_sql() -> str:
    """DuckDB form of ``leaks`` over documents(doc_id, text) and benchmark(item_id, text): all shingles, joined."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
with b as (select row_number() over () as r, item_id, {words} as w from benchmark where text is not null),
     i as (select distinct r, item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) as s from (select *, least({WIDTH}, len(w)) as k from b where len(w) > 0)),
     n as (select r, count(*) as n from i group by r),
     d as (select row_number() over () as q, doc_id, {words} as w from documents where text is not null),
     g as (select distinct q, doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) as s from d, (select distinct k from i) where len(w) >= k)
select g.doc_id, i.item_id, count(*) / any_value(n.n) as containment
from g join i on g.k = i.k and g.s = i.s join n on n.r = i.r group by g.q, g.doc_id, i.r, i.item_id having count(*) >= {THRESHOLD} * any_value(n.n)
"""
