"""URL filters: host and path rules, then the ratio of two character language models."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: (verdict, host/path) rules; the longest that fits wins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Longest context in bytes.
ORDER = 5
#: A context of ``RARE`` bytes or more counts from its second occurrence in a class on; before, the model backs off. This
#: leaves out the long contexts of one url alone, which are most of a model's size and speak for no other url.
RARE, TWICE = 3, 2
#: One in so many urls that rules judge is kept from the models, and the cut is calibrated on these.
FOLDS = 5
#: Bins of the score differences of rule-judged urls, over [-SPAN, SPAN].
BINS, SPAN = 2000, 4.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``; else both empty."""
    at = F.instr(url, "://")
    tail = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(tail, r"^([^/?#]*)", 1)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, and by_rule (its verdict); the last two null where no rule fits."""
    host, path = split_url(F.col(url_col).cast("string"))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.withColumns({"rule": rule, "by_rule": verdict})


def _codes(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Literal context and byte of each place and order, as order << 48 | context << 8 | byte [place, order], and each place's url."""
    data = [re.sub(r"^[a-z]+://", "", (u or "").lower()).encode("utf-8", "surrogatepass") + b"\n" for u in urls]
    flat = np.frombuffer(b"".join(b"\n" * ORDER + d for d in data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
    first = np.cumsum([0, *(len(d) + ORDER for d in data)])[:-1]
    place = np.arange(len(owner)) - np.repeat(np.cumsum([0, *map(len, data)])[:-1], [len(d) for d in data]) + np.repeat(first, [len(d) for d in data]) + ORDER
    context = np.zeros(len(place), np.uint64)
    pairs = []
    for k in range(ORDER + 1):
        if k:
            context = context | flat[place - k] << np.uint64(8 * (k - 1))
        pairs.append(np.uint64(k << 48) | context << np.uint64(8) | flat[place])
    return np.column_stack(pairs).astype(np.int64), owner


def _at(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of each ``x`` among sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(x))
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, values[i], 0)


@dataclass
class Ratio:
    """Two Markov models of variable order, each smoothed down to the uniform one; counts of (class, order)."""

    pairs: list  # for each class (sorted order, context and byte; their counts)
    contexts: list  # for each class (sorted order and context; their counts; different bytes seen after them)
    cut: float = 0.0

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Mean log-likelihood difference a character: accepted over rejected."""
        if not urls:
            return np.zeros(0)
        codes, owner = _codes(urls)
        distinct, place = np.unique(codes, return_inverse=True)
        place = place.reshape(codes.shape)
        logs = []
        for c in (0, 1):
            p = np.full(len(owner), 1 / 256)
            keys, counts, kinds = self.contexts[c]
            of = [_at(keys, counts, distinct >> 8), _at(keys, kinds, distinct >> 8), _at(*self.pairs[c], distinct)]
            for k in range(ORDER + 1):  # Witten-Bell: each order backs off by the variety seen after its context
                n, t, hit = (v[place[:, k]] for v in of)
                p = np.where(n > 0, (hit + t * p) / np.maximum(n + t, 1), p)
            logs.append(np.log(np.maximum(p, 1e-12)))
        return np.bincount(owner, logs[1] - logs[0], len(urls)) / np.bincount(owner, minlength=len(urls))


def counted(judged: DataFrame, url_col: str) -> Ratio:
    """The counts over all given urls, which rules have judged: of each context (see ``RARE``) and byte, so that the model grows
    with their number. Contexts are literal bytes, never merged."""

    def run(batches):
        for b in batches:
            kinds = np.array([v == "allow" for v in b.column(1).to_pylist()], bool)
            codes, owner = _codes(b.column(0).to_pylist())
            for c in (0, 1):
                mine = kinds[owner] == c
                joint, n = np.unique(codes[mine].ravel(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), c), pa.int32()), pa.array(joint), pa.array(n)], names=["c", "joint", "n"])

    rows = judged.select(F.col(url_col).cast("string"), "by_rule").mapInArrow(run, "c int, joint long, n long").groupBy("c", "joint").agg(F.sum("n").alias("n"))
    context = F.shiftright("joint", 8)
    often = rows.where(context >= RARE << 40).groupBy("c", context.alias("context")).agg(F.sum("n").alias("all")).where(F.col("all") >= TWICE).select("c", "context")
    rows = rows.where(context < RARE << 40).unionByName(rows.withColumn("context", context).join(often, ["c", "context"], "left_semi").drop("context"))
    t = rows.toArrow()
    c, joint, n = (t.column(x).to_numpy() for x in ("c", "joint", "n"))
    model = Ratio([], [])
    for kind in (0, 1):
        mine = np.flatnonzero(c == kind)
        mine = mine[np.argsort(joint[mine])]
        keys, starts, kinds = np.unique(joint[mine] >> 8, return_index=True, return_counts=True)
        model.pairs.append((joint[mine], n[mine]))
        model.contexts.append((keys, np.add.reduceat(n[mine], starts) if len(starts) else n[mine], kinds))
    return model


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    A rule's verdict stands. Urls that no rule fits are judged by the models, which learn from the urls that rules have
    judged but for every ``FOLDS``th of them (by hash of the url, so equal urls go together); on those the cut is where
    balanced accuracy is best. Where they lack a verdict the cut is taken on all judged urls. Without urls of both
    verdicts everything else is allowed. Null urls and urls without ``://`` have empty host and path and are judged by the
    models too. Urls of any length are taken whole, repeated rows each have the verdict, other columns are not read. Empty
    tables give no rows.
    """
    rows = with_rules(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url", rules)
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    model = counted(rows.where(F.col("by_rule").isNotNull() & ~held), "url")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in batches:
            s = shared.value.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    out = staged(rows.mapInArrow(score, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, path string, rule string, by_rule string, score double"))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") / (2 * SPAN) + 0.5) * BINS))).cast("int")
    tally = np.zeros((2, 2, BINS))  # held out or not, verdict, bin
    for r in out.where("by_rule is not null").groupBy(held.alias("held"), place.alias("bin"), "by_rule").count().collect():
        tally[int(r.held), int(r.by_rule == "allow"), r.bin] += r["count"]
    tally = tally[1] if tally[1].sum(axis=1).all() else tally.sum(axis=0)
    cut = -np.inf
    if tally.sum(axis=1).all():
        above = lambda t: (np.cumsum(t[::-1]) / t.sum())[::-1]
        cut = (int(np.argmax(above(tally[1]) - above(tally[0]))) / BINS - 0.5) * 2 * SPAN
    by_model = F.when(F.col("score") >= float(cut), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), F.round("score", 6).alias("score"))
