"""Near duplicates by SimHash with a Gray-order hierarchical index.

The uppermost nodes are masked patterns of two of six bit fields: fingerprints that differ in at most four bits agree in
at least two of six fields, so every link lies under a common one. A node with very many fingerprints has nodes below it
in which a third field may differ by one bit: four differences over four fields leave one of them with at most one.

Under such a node fingerprints are sorted by Gray rank and a tree is built over them: a node of the tree factors out the
bits that all its fingerprints share, as (mask, pattern), and its children keep only what is new below. A search goes
down from the root, adds up the differences of the patterns on its way, and leaves a whole subtree when they exceed the
radius, or when all its fingerprints are connected to the searched one already. A group reports a spanning forest of its
links, never all pairs; components come from ``common.connected``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import SCHEMA, similar_links, sketches
from .common import connected, partitions, quoted, sliced, staged, text_of
from .wordhash import encoded

#: Bits of the six fields, from the top; any two of them form an upper node.
FIELDS = (11, 11, 11, 11, 10, 10)
#: Differing bits of a link.
RADIUS = 4
#: Children of a node of the tree.
FANOUT = 8
#: Fingerprints under one upper node in one group; beyond that a third field parts them, and beyond that they are tiled.
TILE = 8192
#: Searches made together: first of so many members of a group, then of twice as many each time; and the members that
#: they may meet in all.
FIRST, MEETINGS = 16, 1 << 22
#: Rows of the node table in a task.
TASK_ROWS = 400_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SLOT = (np.arange(8) * 256)[None, :]


def simhash(text: str | None, width: int = 4) -> int:
    """Fingerprint of a text as a signed 64-bit number: majority bits of XXH64 (seed 42) of its word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype=">u8")
    slots = hashes.view(np.uint8).reshape(-1, 8) + _SLOT
    ones = np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones.ravel() > len(hashes)).tobytes(), "big", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): a document is an id with a text, whose hash stands for it."""
    text = quoted(text_col).cast("string")
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, h, fp) of every row; a null or blank text has fingerprint zero."""

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([simhash(t, width) for t in b.column(2).to_pylist()], pa.int64())], names=["doc_id", "h", "fp"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, h long, fp long")


def fingerprints_and_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(doc_id, h, fp, key, bands, bytes) of every row: the fingerprint, the shingle set's hash and buckets, the sketch's length."""

    def run(batches):
        for b in sliced(batches):
            texts = b.column(2).to_pylist()
            key, bands, sketch = zip(*(s or (None, None, None) for s in sketches(encoded(texts), width)), strict=True) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([simhash(t, width) for t in texts], pa.int64()), pa.array(key, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array([s and len(s) for s in sketch], pa.int64())], names=["doc_id", "h", "fp", "key", "bands", "bytes"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"doc_id long, h long, fp long, {SCHEMA}")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each unsigned 64-bit word in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component, for links a-b among 0..n-1."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while (lab[lab] != lab).any():
            lab = lab[lab]
        open_ = lab[a] != lab[b]
        a, b = a[open_], b[open_]
    return lab


class Forest:
    """Trees over runs of equal ``keys``, with ``x`` in Gray order within a run.

    A level has, for each of its nodes, the bits that are one (or zero) in all its fingerprints, and where its children
    begin on the level below; level 0 are the fingerprints themselves. ``met`` and ``pruned`` count the nodes that searches
    have looked at and left, ``compared`` the fingerprints among them.
    """

    def __init__(self, keys: np.ndarray, x: np.ndarray, radius: int = RADIUS):
        self.x, self.radius = x, radius
        self.met = self.pruned = self.compared = 0
        self.lab = np.arange(len(x))
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(x)])
        self.size, self.place = np.repeat(size, size), np.arange(len(x)) - np.repeat(first, size)
        self.root = np.cumsum(new) - 1
        self.levels = [(x, ~x, None, np.arange(1, len(x) + 1))]
        group, place = self.root, self.place
        while len(x) and place.max() > 0:
            ones, zeros, _, stop = self.levels[-1]
            cut = np.flatnonzero(place % FANOUT == 0)
            self.levels.append((np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut), np.r_[cut, len(ones)], stop[np.r_[cut[1:], len(ones)] - 1]))
            group, place = group[cut], place[cut] // FANOUT

    def alone(self) -> list[np.ndarray]:
        """For each level the label that all fingerprints of a node have, or -1."""
        low = high = self.lab
        out = [self.lab]
        for _, _, cut, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(low, cut[:-1]), np.maximum.reduceat(high, cut[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def linked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from each of the fingerprints (by place) to later ones of its group that it is not connected to."""
        label = self.alone()
        node, apart = self.root[q], np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            ones, zeros, cut, _ = self.levels[level]
            mask = ones[node] | zeros[node]
            n = cut[node + 1] - cut[node]
            child = np.repeat(cut[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q, apart, above = np.repeat(q, n), np.repeat(apart, n), np.repeat(mask, n)
            ones, zeros, _, stop = self.levels[level - 1]
            apart = apart + np.bitwise_count((self.x[q] ^ ones[child]) & (ones[child] | zeros[child]) & ~above)
            stay = (apart <= self.radius) & (stop[child] > q + 1) & (label[level - 1][child] != self.lab[q])
            self.met += len(child)
            self.pruned += len(child) - int(stay.sum())
            self.compared += len(child) if level == 1 else 0
            q, node, apart = q[stay], child[stay], apart[stay]
        return q, node

    def connect(self) -> np.ndarray:
        """Label (a place) of every fingerprint's component."""
        at, many = 0, FIRST
        while (now := np.flatnonzero((self.place >= at) & (self.place < at + many) & (self.size > self.place + 1))).size:
            weight = np.cumsum(self.size[now])
            for part in np.split(now, np.flatnonzero(np.diff(weight // MEETINGS)) + 1):
                a, b = self.linked(part)
                a, b = self.lab[a], self.lab[b]
                roots, local = np.unique(np.concatenate((a, b)), return_inverse=True)
                if len(roots):
                    to = np.arange(len(self.x))
                    to[roots] = roots[_roots(len(roots), local[: len(a)], local[len(a) :])]
                    self.lab = to[self.lab]
            at, many = at + many, many * 2
        return self.lab


def search(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component label (an index) of each of the fingerprints ``x``, which are in Gray order, through one tree."""
    return Forest(np.zeros(len(x), np.int64), x, radius).connect()


def _links(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of whole groups: ``x`` in Gray order within runs of equal ``keys``."""
    lab = Forest(keys, x).connect()
    at = np.flatnonzero(lab != np.arange(len(x)))
    return x[at], x[lab[at]]


def _sweep(batches):
    """Groups of a sorted partition, one after the other; a group that a batch leaves open is carried on."""
    held = None
    for batch in batches:
        t = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        held = t if held is None else [np.concatenate((p, q)) for p, q in zip(held, t, strict=True)]
        last = np.flatnonzero(held[0] != held[0][-1])
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield from _grouped(held[0][:cut], held[1][:cut])
            held = [v[cut:] for v in held]
    if held is not None and len(held[0]):
        yield from _grouped(*held)


def _grouped(keys: np.ndarray, x: np.ndarray):
    _, run = np.unique(keys, return_inverse=True)
    order = np.lexsort((gray_rank(x), run))
    a, b = _links(keys[order], x[order])
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (``fp``) within ``RADIUS`` bits of each other, directly or over others."""
    spark = distinct.sparkSession
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    ends = [64 - sum(FIELDS[:i]) for i in range(len(FIELDS) + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for hi, lo in zip(ends, ends[1:], strict=False)]
    pairs = list(combinations(range(len(FIELDS)), 2))
    nodes = F.array(*[F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j])))) for n, (i, j) in enumerate(pairs)])
    rows = distinct.select("fp", F.posexplode(nodes).alias("pair", "node"))
    hot = rows.groupBy("node").count().where(F.col("count") > TILE).select("node", F.lit(True).alias("hot"))
    rows = rows.join(hot, "node", "left")
    # Below a hot node: one more field, as it is and with each of its bits turned, so that values one bit apart meet.
    below = [(n, f, signed(masks[f]), signed(turned)) for n, own in enumerate(pairs) for f in range(len(FIELDS)) if f not in own for turned in (0, *(1 << b for b in range(ends[f + 1], ends[f])))]
    below = F.broadcast(spark.createDataFrame(below, "pair int, field int, mask long, turned long"))  # 690 rows
    deeper = rows.where("hot").join(below, "pair").select("fp", F.xxhash64("node", "field", F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("turned"))).alias("node")).distinct()
    full = deeper.groupBy("node").count().where(F.col("count") > TILE).select("node", F.ceil(F.col("count") / TILE).alias("k"))
    deeper = deeper.join(full, "node", "left")
    tile = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("k"))
    tiles = F.when(F.col("k").isNull(), F.array(F.col("node"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: F.xxhash64(F.col("node"), F.least(o, tile), F.greatest(o, tile))))
    rows = rows.where("hot is null").select("node", "fp").unionByName(deeper.select(F.explode(tiles).alias("node"), "fp"))
    n = partitions(spark, distinct.count() * 15, TASK_ROWS)
    return rows.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_sweep, "a long, b long")


def components(docs: DataFrame, id_col: str, text_col: str, width: int, similar: bool) -> DataFrame:
    """(doc_id, h, fp, first) of every row: ``first`` is the least (doc_id, h) of its component, ids that are null apart."""
    rows = staged((fingerprints_and_sketches if similar else fingerprints)(docs, id_col, text_col, width))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h")))
    distinct = staged(rows.groupBy("fp").agg(least.alias("rep")))
    # Each step below is over distinct fingerprints; copies come back in the last join alone.
    edges = links(distinct.select("fp"))
    if similar:
        edges = edges.unionByName(similar_links(rows, docs, text_col))
    root = connected(edges).withColumnRenamed("node", "fp")
    known = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = known.join(known.groupBy("root").agg(F.min("rep").alias("first")), "root").select("fp", "first")
    return rows.select("doc_id", "h", "fp").join(known, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, similar: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id that links reach.

    Links are those of fingerprints and, if ``similar``, those of shingle sets that are alike (see ``alike``).

    Null and blank texts have fingerprint zero and link like any other; texts of any length are taken whole. Equal rows
    are one node, and so are different texts of one fingerprint. A null id stands for no document: it is never a
    component_id unless a component has no other id. Empty tables give no rows; other columns are not read.
    """
    found = components(docs, id_col, text_col, width, similar)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component.

    Documents are linked by fingerprints or by five-word shingles of which they share four fifths. A document is an id
    with a text: rows of one id with different texts are different documents, ordered by a hash of the text. Of rows that
    are equal in both, the least one in all columns stays. Rows without an id cannot be told from others by it, and all of
    them stay. Columns may have any names; empty tables give no rows.
    """
    found = components(docs, id_col, text_col, width, True)
    first = found.where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("d"), quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("h"))
    named = rows.join(first, ["doc_id", "h"])
    once = named.where("n = 1").select("d").unionByName(named.where("n > 1").groupBy("doc_id", "h").agg(F.min("d").alias("d")).select("d"))
    return once.unionByName(rows.where("doc_id is null").select("d")).select("d.*")
