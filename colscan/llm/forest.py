"""Quality rules: an isolation forest on rule statistics, its cut calibrated from labelled rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .wordhash import Words, encoded, slabs

#: Trees, rows of each (the method's subsample), and bins in which labelled scores are counted.
TREES, ROWS, BINS = 128, 256, 1000
SEED = 11
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, upper long, stops long, kinds long, n_chars long"


def statistics(texts: list[str | None], window: int = 5) -> np.ndarray:
    """Rule statistics of whole texts, one row each, in the order of ``STATS`` after the id."""
    out = np.zeros((len(texts), 9), np.int64)
    for first, part in slabs(encoded(texts)):
        w = Words(part)
        n = len(part)
        row = out[first : first + n]
        row[:, 0] = np.diff(w.bounds)
        begins = np.cumsum([0, *(len(t) + 1 for t in part)])
        at = np.zeros(len(w.data) + 1, np.int64)

        def total(mask, at=at, ends=begins, w=w):
            np.cumsum(mask, out=at[1:])
            return np.diff(at[np.minimum(ends, len(w.data))])

        lead = (w.data & 0xC0) != 0x80  # the first byte of each code point
        at[0] = 0
        points = np.r_[0, np.cumsum(lead)]
        chars = points[w.end] - points[w.start]
        row[:, 1] = np.bincount(w.doc, chars, n)
        row[:, 2] = total(SYMBOLS[w.data])
        for i, t in enumerate(part):
            lines = Counter(x for x in t.split(b"\n") if x.split())
            row[i, 3] = sum(c - 1 for c in lines.values())
        gram, start = w.grams(window)
        if len(gram):
            doc = w.doc[start]
            order = np.lexsort((gram, doc))
            same = (gram[order][1:] == gram[order][:-1]) & (doc[order][1:] == doc[order][:-1])
            twice = start[order[np.r_[False, same] | np.r_[same, False]]]
            step = np.zeros(len(w.hash) + 1, np.int32)
            np.add.at(step, twice, 1)
            np.add.at(step, twice + window, -1)
            row[:, 4] = np.bincount(w.doc, np.cumsum(step[:-1]) > 0, n)
        row[:, 5] = total((w.data >= 65) & (w.data <= 90))
        row[:, 6] = total(np.isin(w.data, np.frombuffer(b".!?", np.uint8)))
        order = np.lexsort((w.hash, w.doc))
        h, d = w.hash[order], w.doc[order]
        if len(h):
            row[:, 7] = np.bincount(d, np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])], n)
        row[:, 8] = total(lead) - 1
        row[-1, 8] += 1  # all but the last are followed by a separator
    return out


def vectors(stats: np.ndarray) -> np.ndarray:
    """Scale-free rule values of the statistics."""
    words, chars, symbols, dup, repeat, upper, stops, kinds, n = (stats[:, i].astype(np.float64) for i in range(9))
    w, c = np.maximum(words, 1), np.maximum(n, 1)
    return np.column_stack([np.log1p(words), chars / w, symbols / w, np.log1p(dup), repeat / w, upper / c, stops / w, kinds / w**0.8])


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    trees: list  # per tree: feature, split, left child, path length at a leaf
    rows: int
    cut: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in (0, 1): 2 ** -(mean path length / expected length)."""
        depth = np.zeros(len(x))
        for feature, split, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(feature[at], 0)] >= split[at]
                at = np.where(inner, left[at] + right, at)
            depth += length[at]
        return 2 ** -(depth / len(self.trees) / max(1e-9, float(mean_path(self.rows)))) if self.trees else np.zeros(len(x))


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> tuple[np.ndarray, ...]:
    """One tree: random features split at random values between their extremes."""
    nodes: list[list] = []

    def node() -> int:
        nodes.append([-1, 0.0, 0, 0.0])
        return len(nodes) - 1

    todo = [(node(), x, 0)]
    while todo:
        at, rows, depth = todo.pop()
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth >= deepest or len(rows) <= 1 or not len(free):
            nodes[at][3] = depth + float(mean_path(len(rows)))
            continue
        f = int(rng.choice(free))
        split = rng.uniform(lo[f], hi[f])
        right = rows[:, f] >= split
        if right.all():
            split, right = hi[f], rows[:, f] >= hi[f]
        a, b = node(), node()
        nodes[at][:3] = [f, split, a]
        todo += [(a, rows[~right], depth + 1), (b, rows[right], depth + 1)]
    f, s, c, n = zip(*nodes, strict=True)
    return np.array(f), np.array(s), np.array(c), np.array(n)


def plant(x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    if not len(x):
        return Forest([], rows)
    rows = min(rows, len(x))
    return Forest([grow(x[rng.choice(len(x), rows, replace=False)], rng, max(1, int(np.ceil(np.log2(max(2, rows)))))) for _ in range(trees)], rows)


def calibrate(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut (upper edge of a bin) at which balanced accuracy over all labelled rows is best; 1 if one kind is missing."""
    if not good.sum() or not bad.sum():
        return 1.0
    kept_good, kept_bad = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    return float((np.argmax(kept_good - kept_bad) + 1) / len(good))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", trees: int = TREES, rows: int = ROWS) -> DataFrame:
    """Statistics, anomaly score and verdict of every row of ``docs``.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated five-word windows. kept: not
    base_failed, and an anomaly below the cut. The forest's subsamples come from the ``trees * rows`` rows of lowest
    hashed id that pass the base rules and are not labelled poor; the cut is calibrated on the scores of all labelled
    rows that pass the base rules. Without labels of both kinds nothing is rejected beyond the base rules. Of conflicting
    labels of an id the worse one counts. A null text has no words; texts of any length are measured whole; null ids and
    repeated rows are judged like any row; other columns, of whatever names, are not read; empty tables give no rows.
    Rows of equal hash are taken into the sample in order of their id.
    """
    spark = docs.sparkSession

    def measure(batches):
        for b in batches:
            s = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[:, i]) for i in range(9))], names=[f.split()[0] for f in STATS.split(", ")])

    stats = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, STATS))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    names = [f.split()[0] for f in STATS.split(", ")][1:]
    rated = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.expr(good).alias("good")).where("good is not null").groupBy("doc_id").agg(F.min("good").alias("good"))
    known = staged(stats.where(~failed).join(rated, "doc_id", "left"))
    sample = known.where("coalesce(good, true)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trees * rows).select(*names).toArrow()
    forest = plant(vectors(np.column_stack([sample.column(c).to_numpy() for c in names])), trees, rows)
    model = spark.sparkContext.broadcast(forest)

    def scored(batches):
        for b in batches:
            x = vectors(np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.scores(x))], names=[*b.schema.names, "anomaly"])

    counts = known.where("good is not null").mapInArrow(scored, f"{STATS}, good boolean, anomaly double").groupBy(F.least(F.lit(BINS - 1), F.floor(F.col("anomaly") * BINS)).cast("int").alias("bin"), "good").count().collect()
    tally = np.zeros((2, BINS), np.int64)
    for r in counts:
        tally[int(r.good), r.bin] += r["count"]
    cut = calibrate(tally[1], tally[0])
    out = stats.mapInArrow(scored, f"{STATS}, anomaly double").withColumn("base_failed", failed)
    return out.select("doc_id", *names[:5], "base_failed", (~F.col("base_failed") & (F.col("anomaly") < cut)).alias("kept"), F.round("anomaly", 6).alias("anomaly"))
