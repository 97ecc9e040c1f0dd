"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, where only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_all, drop_staged, quoted, staged, text_of

#: Bytes of text that a shard may hold.
SHARD_BYTES = 64 << 20
#: Bits of the hash, and how many are looked at beyond the mean depth in one pass.
BITS, AHEAD = 60, 6
#: Leaves of a directory that is broadcast, under 100 bytes each.
SLOTS = 1 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaves (prefix, depth, shard_bytes) of the directory for ``sizes`` (h, bytes), one row per key, written out.

    A pass adds up the bytes of all prefixes down to some depth in one aggregation and closes every bucket that
    fits, or that one key alone fills, at its first such depth; the next pass goes on below the buckets that are
    still too large.
    """
    whole = sizes.agg(F.sum("bytes"), F.count("*")).first()
    leaves, top, open_, temporary = None, 0, sizes, []
    left = whole[0] or 0
    while True:
        low = min(BITS, top + max(1, math.ceil(math.log2(max(2, left / limit)))) + AHEAD)
        fine = open_.groupBy(_prefix(F.col("h"), F.lit(low)).alias("p")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last"))
        level = fine.select(F.explode(F.sequence(F.lit(top), F.lit(low))).alias("depth"), "*")
        level = level.groupBy("depth", F.call_function("shiftright", F.col("p"), (F.lit(low) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.min("first").alias("first"), F.max("last").alias("last"))
        level = staged(level.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("first") == F.col("last")) | (F.col("depth") >= BITS)))
        temporary.append(level)
        parent = level.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        split = level.where((F.col("depth") > top) & F.col("fits")).withColumn("above", F.call_function("shiftright", F.col("prefix"), F.lit(1))).join(parent, ["depth", "above"], "left_semi")
        done = split.select("prefix", "depth", "shard_bytes").unionByName(level.where((F.col("depth") == top) & F.col("fits")).select("prefix", "depth", "shard_bytes"))
        leaves = done if leaves is None else leaves.unionByName(done)
        rest = level.where((F.col("depth") == low) & ~F.col("fits")).select(F.col("prefix").alias("p"), "shard_bytes")
        left = rest.agg(F.max("shard_bytes")).first()[0]
        if left is None:
            out = staged(leaves)
            drop_all(temporary)
            return out
        open_ = staged(open_.withColumn("p", _prefix(F.col("h"), F.lit(low))).join(rest.select("p"), "p", "left_semi").select("h", "bytes"))
        temporary.append(open_)
        top = low


def slots(leaves: DataFrame, n: int) -> DataFrame:
    """The directory as rows (slot, width, leaves): for each value of the first ``width`` bits the leaves that lie there.

    A leaf of fewer bits stands in several slots and one of more bits beside others in one slot, whatever the depths;
    the ``n`` leaves have about ``n`` slots, so a slot has few.
    """
    width = min(BITS, max(0, math.ceil(math.log2(max(1, n)))))
    shift = lambda name, x, k: F.call_function(name, x, k.cast("int"))
    spread = F.greatest(F.lit(width) - F.col("depth"), F.lit(0))
    first = shift("shiftright", F.col("prefix"), F.greatest(F.col("depth") - width, F.lit(0)))
    ends = shift("shiftleft", F.col("prefix") + 1, F.lit(BITS) - F.col("depth")) - 1
    spread_out = F.sequence(shift("shiftleft", first, spread), shift("shiftleft", first + 1, spread) - 1)
    leaf = F.struct(ends.alias("last"), F.col("prefix"), F.col("depth").cast("int").alias("depth"), F.col("shard_bytes"))
    rows = leaves.select(F.explode(spread_out).alias("slot"), leaf.alias("leaf"))
    return rows.groupBy("slot").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")).withColumn("width", F.lit(width))


def shards(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_bytes, shard (its hash prefix as bits; the undivided table is ``""``), depth, shard_bytes, oversize.

    Every shard holds at most ``limit`` bytes of text, except one that a single key fills alone: a longer document,
    or repeated rows of one key, which no hash bit can part. It is marked ``oversize``. Null keys share the key of
    the empty text; null texts have no bytes; a text of any length is one document. Equal hashes of different keys
    (60 bits) stay together like one key. Empty tables give no rows. Columns of the five names in ``docs`` are
    replaced; other columns may have any name, since rows are carried whole.

    A document finds its shard by the first bits of its hash, then among the few leaves of that slot by their last
    hash. The directory is broadcast while it has at most ``SLOTS`` leaves; a larger one is joined with a shuffle.
    """
    made = ["n_bytes", "shard", "depth", "shard_bytes", "oversize"]
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns if c.lower() not in made]).alias("d"), hash_bits(F.col(key)).alias("h"), F.octet_length(text_of(text_col)).cast("long").alias("n"))
    sizes = staged(rows.groupBy("h").agg(F.sum("n").alias("bytes")))
    leaves = directory(sizes, limit)
    drop_staged(sizes)
    n = leaves.count()
    table = slots(leaves, n)
    table = F.broadcast(table) if n <= SLOTS else table
    width = min(BITS, max(0, math.ceil(math.log2(max(1, n)))))
    found = rows.withColumn("slot", _prefix(F.col("h"), F.lit(width))).join(table, "slot")
    leaf = F.element_at(F.filter("leaves", lambda x: x["last"] >= F.col("h")), 1)
    found = found.select("d", "n", leaf.alias("leaf"))
    bits = F.when(F.col("leaf.depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(leaf.prefix), leaf.depth, '0')"))
    return found.select("d.*", F.col("n").alias("n_bytes"), bits.alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"), (F.col("leaf.shard_bytes") > limit).alias("oversize"))


def shards_sql(limit: int = SHARD_BYTES) -> str:
    """DuckDB form of ``shards`` over documents(doc_id, text)."""
    return f"""
with d as (select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes,
                  ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h from documents),
     p as (select d.h, d.n_bytes, g.depth, d.h >> (60 - g.depth) as prefix from d, (select unnest(range(0, 61)) as depth) g),
     s as (select depth, prefix, sum(n_bytes) as shard_bytes, min(h) = max(h) as alone from p group by all),
     f as (select d.doc_id, d.n_bytes, d.h, min(s.depth) as depth from d join s on s.prefix = d.h >> (60 - s.depth)
           where s.shard_bytes <= {limit} or s.alone group by all)
select f.doc_id, f.n_bytes, right(lpad(bin(s.prefix), 64, '0'), f.depth::int) as shard, f.depth::int as depth,
       s.shard_bytes::bigint as shard_bytes, s.shard_bytes > {limit} as oversize
from f join s on s.depth = f.depth and s.prefix = f.h >> (60 - f.depth) join d on d.doc_id = f.doc_id and d.n_bytes = f.n_bytes
"""
