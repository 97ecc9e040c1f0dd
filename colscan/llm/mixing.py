"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, staged, text_of

#: Times that a document may be repeated, and tokens of a block of the mixed order.
REPEATS, BLOCK_TOKENS = 2.0, 1 << 20
#: Sources whose totals are broadcast, under 100 bytes each; more are joined with a shuffle.
SOURCES = 1 << 20
#: Exponents that one pass over the totals tries, and passes: 32 ** 12 steps narrow an exponent to the last bits.
TRIES, PASSES = 31, 12
#: Documents of a hash bucket on average; running token sums are taken within a bucket, then over buckets.
BUCKET_DOCS = 2_000


def tokens(text: Column) -> Column:
    """Words of a text: runs of other than space and tab to carriage return."""
    return (F.size(F.split(text, r"[\x20\x09-\x0D]+")) - F.when(text.rlike(r"^[\x20\x09-\x0D]|^$"), 1).otherwise(0) - F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def exponent(least: float, most: float, whole: float, shape: Callable, repeats: float, entropy: float | None, budget: float | None) -> float:
    """The exponent in [0, 1] for sources of ``least`` to ``most`` tokens, ``whole`` in all.

    It is bisected, ``TRIES`` places at a time: the largest one whose entropy (nats) reaches ``entropy`` if that is given,
    else 0, and then raised as far as no source is passed through over ``repeats`` times. ``shape`` gives (sum of
    share ** x, sum of share ** x * log(share)) for some exponents x; only entropies and budgets need it.
    """

    def bisect(good: Callable) -> float:
        """Where ``good`` (of some exponents) turns, the last good one."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            xs = [lo + (hi - lo) * (i + 1) / (TRIES + 1) for i in range(TRIES)]
            fine = good(xs)
            n = next((i for i, ok in enumerate(fine) if not ok), TRIES)
            lo, hi = (xs[n - 1] if n else lo), (xs[n] if n < TRIES else hi)
        return lo

    def within(xs: list[float]) -> list[bool]:
        """Whether the smallest source, which is passed through most often, stays within ``repeats``."""
        if budget is None:
            return [(most / least) ** (1 - x) <= repeats + 1e-9 for x in xs]
        return [(least / whole) ** x / norm * budget / least <= repeats + 1e-9 for x, (norm, _) in zip(xs, shape(xs), strict=True)]

    def high(xs: list[float]) -> list[bool]:
        return [math.log(norm) - x * log / norm >= entropy for x, (norm, log) in zip(xs, shape(xs), strict=True)]

    x = 0.0
    if entropy is not None:
        x = 1.0 if high([1.0])[0] else bisect(high)
    if not within([x])[0]:
        x = 1.0 if not within([1.0])[0] else max(x, bisect(lambda xs: [not ok for ok in within(xs)]) + 1e-15)
    return x


def weights(totals: dict, repeats: float = REPEATS, entropy: float | None = None, budget: int | None = None) -> tuple[float, dict, dict]:
    """(exponent, weight of each source, how often each source is passed through).

    Weights are token shares raised to the exponent. Without a ``budget`` in tokens, the least-weighted source relative to
    its size is passed through once, so that nothing is left out. Sources without tokens have weight 0 and are passed
    once.
    """
    sized = {s: t for s, t in totals.items() if t}
    if not sized:
        return 0.0, dict.fromkeys(totals, 0.0), dict.fromkeys(totals, 1.0)
    whole, most = sum(sized.values()), max(sized.values())
    logs = {s: math.log(t / whole) for s, t in sized.items()}
    shape = lambda xs: [(sum(math.exp(x * v) for v in logs.values()), sum(math.exp(x * v) * v for v in logs.values())) for x in xs]
    x = exponent(min(sized.values()), most, whole, shape, repeats, entropy, budget)
    norm = shape([x])[0][0]
    w = {s: math.exp(x * v) / norm for s, v in logs.items()}
    passes = {s: max(1.0, (most / t) ** (1 - x)) if budget is None else min(w[s] * budget / t, repeats) for s, t in sized.items()}
    return x, {s: w.get(s, 0.0) for s in totals}, {s: passes.get(s, 1.0) for s in totals}


def planned(totals: DataFrame, repeats: float, entropy: float | None, budget: int | None) -> DataFrame:
    """``totals`` (source, total) with weight and passes, as ``weights`` has them; for any number of sources."""
    sized = totals.where("total > 0")
    least, most, whole = sized.agg(F.min("total"), F.max("total"), F.sum("total")).first()
    if not whole:
        return totals.withColumns({"weight": F.lit(0.0), "passes": F.lit(1.0)})
    log = F.log(F.col("total") / F.lit(float(whole)))

    def shape(xs: list[float]) -> list[tuple[float, float]]:
        r = sized.agg(*[F.sum(F.exp(x * log)) for x in xs], *[F.sum(F.exp(x * log) * log) for x in xs]).first()
        return list(zip(r[: len(xs)], r[len(xs) :], strict=True))

    x = exponent(least, most, whole, shape, repeats, entropy, budget)
    weight = F.exp(x * log) / shape([x])[0][0]
    passes = F.greatest(F.lit(1.0), F.pow(F.lit(float(most)) / F.col("total"), F.lit(1 - x))) if budget is None else F.least(weight * float(budget) / F.col("total"), F.lit(float(repeats)))
    some = F.col("total") > 0
    return totals.withColumns({"weight": F.when(some, weight).otherwise(0.0), "passes": F.when(some, passes).otherwise(1.0)})


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: float = REPEATS, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """The mixed order: (doc_id, source, tokens, epoch, block, rank), one row for each time a document is used.

    Each pass through a source is a hashed permutation of it, cut where its token budget ends: a document belongs to
    the last, partial pass if the tokens before it are fewer than what is left. Each source's stream of tokens is
    spread evenly over the blocks, so every block holds the sources in the target weights, to within a document;
    rank is a hash that orders a block (ties: by doc_id, source and epoch). Documents of equal hash are ordered by
    doc_id. Rows of one id and source move together as one document; a null id or a null source is a value of its own.
    Null texts have no tokens; texts of any length are counted whole. Other columns, of whatever names, are not read.
    Empty tables give no rows.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), tokens(text_of(text_col)).alias("n"))
    rows = staged(rows.groupBy("doc_id", "source").agg(F.sum("n").alias("tokens")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source")))
    totals = staged(rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")))
    use = staged(planned(totals, repeats, entropy, budget))
    n_sources, n_docs, used = use.agg(F.count("*"), F.sum("docs"), F.sum(F.col("total") * F.col("passes"))).first()
    n_blocks = max(1, math.ceil((used or 0) / block_tokens))
    bits = max(0, math.ceil(math.log2(max(1, (n_docs or 0) / BUCKET_DOCS))))
    # Running token sums in hash order: in buckets of a source, then over buckets of a group, then over the groups, so that no
    # task has a whole source or all its buckets.
    upper = bits // 2
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 63 - bits) if bits else F.lit(0).cast("long"))
    upto = lambda value, *keys, by: F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = rows.withColumn("inner", upto("tokens", "source", "bucket", by=("h", "doc_id")))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("all")).withColumn("group", F.shiftright("bucket", upper))
    groups = buckets.groupBy("source", "group").agg(F.sum("all").alias("all")).select(F.col("source").alias("s"), F.col("group").alias("g"), upto("all", "source", by=("group",)).alias("base"))
    buckets = buckets.withColumn("outer", upto("all", "source", "group", by=("bucket",))).join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
    buckets = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("outer") + F.col("base")).alias("outer"))
    placed = inner.join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", F.col("inner") + F.col("outer")).drop("s", "b")
    use = use.select(F.col("source").alias("s"), "total", "passes")
    placed = placed.join(F.broadcast(use) if n_sources <= SOURCES else use, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    full = F.floor("passes")
    times = full + F.when(F.col("at") < F.round((F.col("passes") - full) * F.col("total")), 1).otherwise(0)
    out = placed.withColumn("times", times.cast("int")).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    share = (F.col("epoch") * F.col("total") + F.col("at")) / F.greatest(F.lit(1.0), F.col("passes") * F.col("total"))
    block = F.least(F.lit(n_blocks - 1), F.floor(share * n_blocks)).cast("long")
    return out.select("doc_id", "source", "tokens", "epoch", block.alias("block"), F.xxhash64(F.lit(seed + 1), "h", "epoch").alias("rank"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` as ``plan`` uses them, so often, with epoch, block and rank; columns of these names are replaced."""
    uses = plan(docs, id_col, source_col=source_col, **how).groupBy("doc_id", "source").agg(F.collect_list(F.struct("epoch", "block", "rank")).alias("uses"))  # a document's own uses
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "block", "rank")]
    rows = docs.select(F.struct(*map(quoted, kept)).alias("d"), quoted(id_col).alias("i"), quoted(source_col).alias("s"))
    # Null-safe, and on the id alone as a key that hashes evenly: no source is a key of its own.
    found = rows.join(uses, rows["i"].eqNullSafe(uses["doc_id"]) & rows["s"].eqNullSafe(uses["source"]))
    return found.select("d", F.explode("uses").alias("u")).select("d.*", "u.epoch", "u.block", "u.rank")


def in_order(docs: DataFrame, rows: int, each: int = 8_000) -> DataFrame:
    """``mixed`` rows dealt to partitions by ranges of (block, rank) and sorted in them: written files have the mixed order."""
    n = max(1, -(-rows // each))
    return docs.repartitionByRange(n, "block", "rank").sortWithinPartitions("block", "rank")
