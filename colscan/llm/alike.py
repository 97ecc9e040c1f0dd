"""Links between texts whose five-word shingles are alike, for the copies that a SimHash of 64 bits cannot tell.

Two texts with a Jaccard similarity of 0.8 differ in about ten of 64 fingerprint bits, where no index of fingerprints
prunes. So texts also meet in ``BANDS`` buckets by their minima under hashed permutations (a pair at 0.8 misses all of
them in 2 of 10,000 cases, and ``AGREE`` of its minima in fewer than 1 of 10,000). There a pair is decided on the whole
sets of shingles, as hashes of 64 bits, however long the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, partitions, sliced, staged
from .wordhash import Words, encoded, mix, slabs

#: Buckets of a text, and minima that make a bucket's name.
BANDS, PER_BAND = 16, 4
#: Minima in which a pair must agree before its sets are compared.
AGREE = 38
#: Texts of a bucket in one group, and bytes of their sketches; beyond either the bucket is tiled over more groups.
TILE, TILE_BYTES = 16_384, 1 << 26
#: Rows of the table in a task, and bytes of their sketches.
TASK_ROWS, TASK_BYTES = 50_000, 1 << 25
#: Bytes of text whose shingles are hashed in one go.
SLAB = 1 << 20
#: Similarity of a link, as a fraction.
SIMILAR = (4, 5)
_MUL = mix(np.arange(1, BANDS * PER_BAND + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(2001, BANDS * PER_BAND + 2001, dtype=np.uint64))
SCHEMA = "key long, bands array<long>, bytes long"


def sketches(texts: list[bytes], width: int) -> list[tuple[int, np.ndarray, bytes] | None]:
    """(hash of the shingle set, buckets, sketch) of each whole text; None below ``width`` words.

    A sketch is a byte of each minimum, then the hashes of all distinct shingles, 64 bits each.
    """
    out: list = [None] * len(texts)
    for first, part in slabs([t.lower() for t in texts], SLAB):
        w = Words(part)
        gram, at = w.grams(width)
        if not len(gram):
            continue
        doc = w.doc[at]
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        low = np.stack([np.minimum.reduceat(gram * mul + add, starts) for mul, add in zip(_MUL, _ADD, strict=True)], axis=1)
        names = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(starts), axis=0)
        for r in range(PER_BAND):
            names = mix(names + mix(low[:, r::PER_BAND]))
        names = names.view(np.int64)
        marks = mix(low).astype(np.uint8)
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(gram)], strict=True)):
            own = np.unique(gram[a:b])
            out[first + int(doc[a])] = (int(np.add.reduce(mix(own + np.uint64(1))).view(np.int64)), names[n], marks[n].tobytes() + own.tobytes())
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts are similar, from the hashes of all their distinct shingles."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    small, large = sorted((len(a), len(b)))
    if small * SIMILAR[1] < large * SIMILAR[0]:
        return False
    both = np.sort(np.concatenate((a, b)))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * SIMILAR[1] >= (len(both) - common) * SIMILAR[0]


def bucket_links(fp: list[int], sketch: list[bytes]) -> list[tuple[int, int]]:
    """Links that connect all similar texts of a bucket. Texts that are connected already are not compared."""
    n, head = len(fp), BANDS * PER_BAND
    marks = np.frombuffer(b"".join(s[:head] for s in sketch), np.uint8).reshape(n, head)
    sets = [np.frombuffer(s, np.uint64, offset=head) for s in sketch]
    lab = np.arange(n)
    out = []
    for i in range(n - 1):
        apart = np.flatnonzero(lab[i + 1 :] != lab[i]) + i + 1
        if not len(apart):
            continue
        for j in apart[np.count_nonzero(marks[apart] == marks[i], axis=1) >= AGREE].tolist():
            if lab[j] != lab[i] and alike(sets[i], sets[j]):
                lab[lab == lab[j]] = lab[i]
                if fp[i] != fp[j]:
                    out.append((fp[i], fp[j]))
    return out


def _sweep(batches):
    """Buckets of a sorted partition, one after the other; one that a batch leaves open is carried on."""
    bucket, fps, held = None, [], []

    def done():
        found = bucket_links(fps, held) if len(fps) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])

    for batch in sliced(batches):
        for b, f, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if b != bucket:
                if len(fps) > 1:
                    yield done()
                bucket, fps, held = b, [], []
            fps.append(f)
            held.append(s)
    yield done()


def sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key, sketch) of every distinct shingle set. Copies are one row a task before they move."""

    def run(batches):
        for b in sliced(batches):
            made = [s for s in sketches(encoded(b.column(0).to_pylist()), width) if s]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in made], pa.int64()), pa.array([s[2] for s in made], pa.binary())], names=["key", "sketch"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, sketch binary").groupBy("key").agg(F.min("sketch").alias("sketch"))


def similar_links(rows: DataFrame, docs: DataFrame, text_col: str = "text", width: int = 5) -> DataFrame:
    """Links (a, b) of fingerprints whose texts are similar, from rows (fp, key, bands, bytes) of ``docs``.

    Equal shingle sets count once, summed up on the map side. Buckets of a single text go before any sketch is moved;
    whole sets are large, so they are not kept from the first scan but made again. A bucket of over ``TILE`` texts or
    ``TILE_BYTES`` is tiled, so that each pair of its texts still meets in some task.
    """
    spark = rows.sparkSession
    known = rows.where("key is not null")
    members = staged(known.select("fp", "key", "bytes", F.explode("bands").alias("bucket")).distinct())
    k = F.ceil(F.greatest(F.count("*") / TILE, F.sum("bytes") / TILE_BYTES))
    size = members.groupBy("bucket").agg(F.count("*").alias("count"), k.alias("k")).where("count > 1").drop("count")
    shared = members.join(size, "bucket")
    tile = F.pmod(F.xxhash64("key", "fp"), F.col("k"))
    tiles = F.when(F.col("k") == 1, F.array("bucket")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: F.xxhash64(F.col("bucket"), F.least(o, tile), F.greatest(o, tile))))
    shared = staged(shared.select("key", "fp", "bytes", F.explode(tiles).alias("bucket")))
    drop_staged(members)
    total = shared.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n = max(partitions(spark, total[0], TASK_ROWS), partitions(spark, total[1], TASK_BYTES))
    one = sets(docs, text_col, width).join(shared.select("key").distinct(), "key", "left_semi")
    return shared.join(one, "key").select("bucket", "fp", "sketch").repartition(n, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_sweep, "a long, b long")
