"""Repeated stretches of text, found exactly: what is common to word-level and byte-level substring dedup.

A stretch is ``length`` consecutive units (words or bytes) of one document. Each stretch belongs to the smallest
hash of its ``gram``-unit pieces, so equal stretches belong to equal hashes wherever they stand; consecutive
stretches with one hash form a run. The steps, all linear in the text:

1. documents are packed into groups; every group reports its runs; hashes that occur in one document only are
   dropped, which leaves few, and hashes with very many different runs are listed as hot;
2. the texts of the runs that remain go to index shards by their hash, each distinct text of a group once. A run
   of a hot hash (a phrase shorter than a stretch, with a different text around it each time) goes stretch by
   stretch, each to the shard of its own whole text, so that no shard has all surroundings of a phrase;
3. a shard's index (see ``fmindex`` and ``suffixlog``) decides which stretches start earlier elsewhere;
4. documents are rebuilt without the units that such stretches cover.

Hashes choose where things meet; the decision is made on the texts. However frequent a hash or passage is, it is one
entry for each group in step 1, and one for each group and distinct text in step 2.

All data between steps is packed, one row for each group and target. Where there are over ``FAN`` targets a row first
goes to one of ``FAN`` bundles of targets, and bundles are split in tasks of their own, so the number of rows grows
with the data and not with groups times shards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, staged, text_of
from .wordhash import Words, encoded, mix, slabs, spans

#: Bytes of text for each group of documents, and for each bucket of runs and index shard.
GROUP_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: Bytes whose runs are computed in one go, and stretches of a run.
SLAB, LONGEST = 1 << 19, 50_000
#: Different runs from which a hash is hot; and hot hashes that the tasks are told, the hottest ones. Any other hash has
#: fewer runs than ``HOT``, or, in a table with more hot hashes than that, at most one in ``HOT_MOST`` of all runs.
HOT, HOT_MOST = 1024, 1 << 20
#: Targets that a row is packed for directly, and bytes (packed) that a task splits at a time beyond that.
FAN, SPLIT_BYTES = 4096, 32 << 20
#: Bytes of text for each task of a step where there are more shards than the session has shuffle partitions.
TASK_BYTES = 256 << 20
#: Bits of a piece's hash that are left out where runs are sent: 48 remain, and a chance agreement only sends a run to the index.
DROPPED = np.uint64(16)
#: Compression level of rows that hold texts of segments, most of what is moved.
TEXT_LEVEL = 3
NO_ID = (1 << 63) - 1
ROW = "kind int, part long, blob binary"
#: Kinds of rows: runs for a bucket, runs or stretches for their documents, hashes known to be repeated, hot hashes.
RUNS, OWN, SURE, HOTTEST = 0, 1, 2, 3


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays as one blob: byte planes, compressed."""
    out = []
    for a in arrays:
        a = np.frombuffer(a, np.uint8) if isinstance(a, bytes) else np.ascontiguousarray(a)
        out += [np.array([ord(a.dtype.kind), a.dtype.itemsize, len(a)], np.int64).tobytes(), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, size, n = np.frombuffer(raw, np.int64, 3, at)
        at += 24
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(f"{chr(kind)}{size}").ravel())
        at += int(n * size)
    return out


def merged(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, blobs), strict=True)]


def by_part(part: np.ndarray, *arrays: np.ndarray):
    """(part, arrays of it) for each part, in the given order within a part."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), [x[order[a:b]] for x in arrays]


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    k, p, b = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int64()), pa.array(b, pa.binary())], names=["kind", "part", "blob"])


class Bytes:
    """Units are bytes: ``data`` with ``start``/``end``, ``hash`` of each, and ``bounds`` of the texts."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.arange(len(self.data))
        self.end = self.start + 1
        self.hash = mix(np.arange(1, 257, dtype=np.uint64))[self.data]
        self.bounds = np.cumsum([0, *map(len, texts)])


def tags(h: np.ndarray) -> np.ndarray:
    """What names a hash's shard: 32 bits of it."""
    return h.astype(np.uint32)


class Repeats:
    """The pipeline of the module for one kind of unit; made on the driver, used in tasks."""

    def __init__(self, length: int, gram: int, words: bool, within: bool, decide: Callable, shard_bytes: int = SHARD_BYTES):
        """within: an earlier start in the same document counts too. decide(job, data, bounds, ids, keys, starts, counts):
        for each segment's ``counts`` stretches, one after the other, whether an equal one starts earlier; the segments'
        texts are data[bounds[i]:bounds[i + 1]]."""
        self.length, self.gram, self.words, self.within, self.decide, self.shard_bytes = length, gram, words, within, decide, shard_bytes
        self.group_bytes, self.fan, self.many, self.split_bytes = GROUP_BYTES, FAN, HOT, SPLIT_BYTES
        self.shards = self.tasks = self.partitions = 1
        self.bundled, self.hot = False, None

    def units(self, texts: list[bytes]):
        return Words(texts) if self.words else Bytes(texts)

    def clean(self, text: bytes) -> bytes:
        return b" ".join(text.split()) if self.words else text

    def runs(self, texts: list[bytes]):
        """(hash, text, start, stretches, hash of its whole text) of every run."""
        found = []
        for first, part in slabs(texts, SLAB):
            u = self.units(part)
            n = len(u.hash) - self.length + 1
            if n <= 0:
                continue
            at = np.arange(len(u.hash) - self.gram + 1)
            low = spans(u.hash, at, at + self.gram)
            where = at if self.within else None
            have, need = 1, self.length - self.gram + 1
            while have < need:  # minimum over ``need`` neighbours by doubling
                step = min(have, need - have)
                if self.within:
                    where = np.where(low[step:] < low[:-step], where[step:], where[:-step])
                low = np.minimum(low[:-step], low[step:])
                have += step
            doc = np.repeat(np.arange(len(part)), np.diff(u.bounds))
            whole = doc[:n] == doc[self.length - 1 :]
            new = np.r_[True, (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1]) | (whole[1:] != whole[:-1])]
            if self.within:  # the place of the least piece parts equal stretches of one document
                new[1:] |= where[1:] != where[:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, n])
            good = whole[begin]
            begin, size = begin[good], size[good]
            if len(size) and size.max() > LONGEST:
                pieces = -(-size // LONGEST)
                ordinal = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                rest = np.repeat(size, pieces) - ordinal * LONGEST
                begin, size = np.repeat(begin, pieces) + ordinal * LONGEST, np.minimum(rest, LONGEST)
            found.append((low[begin] >> DROPPED, (doc[begin] + first).astype(np.uint32), (begin - u.bounds[doc[begin]]).astype(np.uint32), size.astype(np.uint16), spans(u.hash, begin, begin + size + self.length - 1).astype(np.uint32)))
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint32, np.uint16, np.uint32)]

    def target(self, fine: np.ndarray, *arrays: np.ndarray):
        """(target, arrays) for the rows to be sent: the shard or group itself, or its bundle. The first array sent is ``fine``."""
        to = mix(fine.astype(np.uint64)) % np.uint64(self.fan) if self.bundled else fine
        return by_part(to.astype(np.int64), fine, *arrays)

    def split(self, batches, ragged: bool):
        """Rows for bundles as rows for single targets; a task holds some rows of each bundle at a time."""
        held: dict[tuple[int, int], list[bytes]] = {}
        size = 0

        def out():
            for (kind, _), blobs in held.items():
                fine, *arrays = merged(blobs)
                if not (ragged and kind == RUNS):
                    yield rows([(kind, p, pack(*x)) for p, x in by_part(fine.astype(np.int64), fine, *arrays)])
                    continue
                *arrays, lengths, data = arrays
                ends, data = np.cumsum(lengths.astype(np.int64)), data.tobytes()
                begins = ends - lengths
                yield rows([(kind, p, pack(*x, b"".join(data[begins[j] : ends[j]] for j in i))) for p, (i, *x) in by_part(fine.astype(np.int64), np.arange(len(fine)), fine, *arrays, lengths)])

        for b in batches:
            for kind, part, blob in zip(*(b.column(n).to_pylist() for n in ("kind", "part", "blob")), strict=True):
                if kind == HOTTEST:
                    yield rows([(kind, part, blob)])
                    continue
                held.setdefault((kind, part), []).append(blob)
                size += len(blob)
                if size >= self.split_bytes:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    def single(self, df: DataFrame, ragged: bool = False) -> DataFrame:
        """Bundles split into one row for each target."""
        if not self.bundled:
            return df
        spread = F.pmod(F.xxhash64("blob"), F.lit(max(1, self.tasks // self.fan)))
        return df.repartition(max(self.tasks, self.fan), "kind", "part", spread).mapInArrow(lambda b: self.split(b, ragged), ROW)

    def by_shard(self, df: DataFrame, ragged: bool = False):
        """The rows grouped by target, each shard in the partition of its number; what goes to documents is spread by hash."""
        own = F.col("kind") == OWN
        place = F.when(own, F.pmod(F.xxhash64("part"), F.lit(self.tasks))).otherwise(F.pmod("part", F.lit(self.tasks))).cast("int")
        rows_ = self.single(df, ragged).withColumns({"own": own, "place": place})
        return rows_.repartitionById(self.tasks, F.col("place")).groupBy("own", "part", "place")

    def by_group(self, df: DataFrame):
        """The rows grouped by group of documents."""
        return (df.repartition(self.tasks, "part") if self.tasks > self.partitions else df).groupBy("part")

    def known(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which entries have a hash that another document (or, ``within``, another place) has too."""
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(s)])
        if self.within:
            many = size > 1
        else:
            i = ids[order]
            many = np.minimum.reduceat(i, first) != np.maximum.reduceat(i, first) if len(s) else size > 1
        out = np.zeros(len(h), bool)
        out[order] = np.repeat(many, size)
        return out

    def packed(self, batches):
        """Documents (id, key, text) packed into groups of about ``GROUP_BYTES``, numbered within the job."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, keys, texts, size = [], [], [], 0
        for b in sliced(batches):
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoded(b.column(2).to_pylist()), strict=True):
                t = self.clean(t)
                if size and size + len(t) > self.group_bytes:
                    yield rows([(RUNS, number, pack(np.array(ids, np.int64), np.array(keys, np.int64), np.array(list(map(len, texts))), b"".join(texts)))])
                    number += 1
                    ids, keys, texts, size = [], [], [], 0
                ids.append(i)
                keys.append(k)
                texts.append(t)
                size += len(t)
        if ids:
            yield rows([(RUNS, number, pack(np.array(ids, np.int64), np.array(keys, np.int64), np.array(list(map(len, texts))), b"".join(texts)))])

    @staticmethod
    def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(ids, keys, texts) of a group."""
        ids, keys, sizes, data = unpack(blob)
        data, ends = data.tobytes(), np.cumsum(sizes).tolist()
        return ids, keys, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def find(self, batches):
        """Step 1, by group. RUNS and SURE: for a bucket; OWN: runs known to be repeated, for their group."""
        for b in sliced(batches, 1):
            number, blob = b.column("part")[0].as_py(), b.column("blob")[0].as_py()
            ids, _, texts = self.opened(blob)
            h, doc, start, size, whole = self.runs(texts)
            again = self.known(h, ids[doc])
            fine = (tags(h) % np.uint32(self.shards)).astype(np.uint32)
            one = ~again
            out = [(RUNS, p, pack(*x)) for p, x in self.target(fine[one], h[one], np.full(int(one.sum()), number), doc[one], start[one], size[one])]
            # how many different texts a hash has here, told apart by 16 bits
            pairs = np.unique(h[again] << DROPPED | (whole[again] & 0xFFFF))
            sure, different = np.unique(pairs >> DROPPED, return_counts=True)
            out += [(SURE, p, pack(*x)) for p, x in self.target((tags(sure) % np.uint32(self.shards)).astype(np.uint32), sure, different.astype(np.uint32))]
            out += self.to_documents(h[again], np.full(int(again.sum()), number), doc[again], start[again], size[again])
            yield rows(out)

    def to_documents(self, h, group, doc, start, size) -> list:
        return [(OWN, p, pack(*x)) for p, x in self.target(group, tags(h), doc, start, size)]

    def match(self, key, t: pa.Table) -> pa.Table:
        """Step 1, by bucket: the runs whose hash is repeated, and the hot hashes. Runs known to be repeated pass through."""
        if key[0].as_py():
            return t
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        single = [b for k, b in zip(kinds, blobs, strict=True) if k == RUNS]
        known = [b for k, b in zip(kinds, blobs, strict=True) if k == SURE]
        _, sure, different = merged(known) if known else (None, np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        out = []
        h = np.zeros(0, np.uint64)
        if single:
            _, h, group, doc, start, size = merged(single)
            # documents by group and place; two rows of one document count as two here, and the index decides
            again = self.known(h, (mix(group.view(np.uint64)) + doc).view(np.int64)) | np.isin(h, sure)
            h = h[again]
            out = self.to_documents(h, *(x[again] for x in (group, doc, start, size)))
        names, at = np.unique(np.concatenate((sure, h)), return_inverse=True)
        total = np.bincount(at, np.concatenate((different, np.ones(len(h)))), len(names))
        many = total >= self.many
        if many.any():
            out.append((HOTTEST, -1, pack(tags(names[many]), total[many].astype(np.int64))))
        return pa.Table.from_batches([rows(out)])

    @staticmethod
    def hottest(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                tag, n = unpack(blob)
                yield pa.RecordBatch.from_arrays([pa.array(tag.astype(np.int64)), pa.array(n)], names=["tag", "n"])

    def extract(self, key, docs: pa.Table, found: pa.Table) -> pa.Table:
        """Step 2. RUNS: segments for an index shard; OWN: stretches already decided, for their group.

        Of segments with equal text, the first goes to the shard; the others are repeated throughout.
        """
        if not found.num_rows or not docs.num_rows:
            return pa.Table.from_batches([rows([])])
        number = key[0].as_py()
        own_ids, own_keys, texts = self.opened(docs.column("blob")[0].as_py())
        _, tag, doc, start, size = merged(found.column("blob").to_pylist())
        order = np.lexsort((start, own_keys[doc], own_ids[doc]))
        tag, doc, start, size = tag[order], doc[order], start[order].astype(np.int64), size[order].astype(np.int64)
        ids, keys = own_ids[doc], own_keys[doc]
        hot = np.isin(tag, self.hot.value).tolist()
        cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])
        runs: dict[bytes, tuple[int, int, int]] = {}
        single: dict[bytes, tuple[int, int, int]] = {}
        sent, done, segments = [], [], []

        def take(first: dict, piece: bytes, me: tuple[int, int], n: int, at: int, count: int) -> bool:
            """Whether the piece is to be sent; else it is noted as repeated, or is one and the same, told twice."""
            was = first.get(piece)
            if was is None:
                first[piece] = (*me, at)
                return True
            if was == (*me, at):
                return False
            if self.within or was[0] < me[0]:
                done.append((n, at, count))
                return False
            return True

        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
            me = (int(ids[a]), int(keys[a]))
            data = texts[doc[a]]
            u = self.units([data])
            begin, end = u.start[start[a:b]].tolist(), u.end[start[a:b] + size[a:b] + self.length - 2].tolist()
            for n, (x, y) in enumerate(zip(begin, end, strict=True), a):
                at, count, piece = int(start[n]), int(size[n]), data[x:y]
                if not take(runs, piece, me, n, at, count):
                    continue
                if not hot[n]:
                    sent.append((n, at, count, tag[n]))
                    segments.append(piece)
                    continue
                ends = u.end[at + self.length - 1 : at + self.length - 1 + count].tolist()
                for j, (p, q) in enumerate(zip(u.start[at : at + count].tolist(), ends, strict=True)):
                    piece = data[p:q]
                    if take(single, piece, me, n, at + j, 1):
                        sent.append((n, at + j, 1, zlib.crc32(piece)))
                        segments.append(piece)
        out = []
        if sent:
            n, at, count, named = map(np.array, zip(*sent, strict=True))
            fine = (named.astype(np.uint32) % np.uint32(self.shards)).astype(np.uint32)
            lengths = np.array([len(s) for s in segments], dtype=np.uint32)
            for p, (f, i, x, y, d, s, c, m) in self.target(fine, np.arange(len(n)), ids[n], keys[n], doc[n], at.astype(np.uint32), count.astype(np.uint16), lengths):
                out.append((RUNS, p, pack(f, x, y, np.full(len(x), number), d, s, c, m, b"".join(segments[j] for j in i), level=TEXT_LEVEL)))
        if done:
            n, at, count = map(np.array, zip(*done, strict=True))
            out += [(OWN, p, pack(*x)) for p, x in self.target(np.full(len(n), number), doc[n], at.astype(np.uint32), count.astype(np.uint32))]
        return pa.Table.from_batches([rows(out)])

    def index(self, key, t: pa.Table) -> pa.Table:
        """Step 3: the shard's verdict, as ranges of stretches for each group."""
        if key[0].as_py():
            return t
        _, ids, keys, group, doc, start, size, lengths, data = merged(t.column("blob").to_pylist())
        del t
        size = size.astype(np.int64)
        bad = self.decide(self, data, np.r_[0, np.cumsum(lengths.astype(np.int64))], ids, keys, start.astype(np.int64), size)
        # Flags of a byte for each stretch are all that is held here: where a segment begins, and where a range does.
        begin = np.cumsum(size) - size
        head = np.zeros(len(bad) + 1, bool)
        head[begin] = head[-1] = True
        edge = np.flatnonzero(bad & (head[:-1] | np.r_[True, ~bad[:-1]]))
        stop = np.flatnonzero(bad & (head[1:] | np.r_[~bad[1:], True]))
        who = np.searchsorted(begin, edge, "right") - 1
        ranges = (doc[who], (start[who] + edge - begin[who]).astype(np.uint32), (stop - edge + 1).astype(np.uint32))
        return pa.Table.from_batches([rows([(OWN, p, pack(*x)) for p, x in self.target(group[who], *ranges)])])

    def rebuild(self, key, docs: pa.Table, found: pa.Table) -> pa.Table:
        """Step 4: (doc_id, n, n_removed, n_spans, kept_sha256, kept) of each document of a group."""
        out = []
        ids, keys, texts = self.opened(docs.column("blob")[0].as_py()) if docs.num_rows else (np.zeros(0, int),) * 2 + ([],)
        gone: dict[tuple[int, int], list] = {}
        if found.num_rows:
            _, doc, start, size = merged(found.column("blob").to_pylist())
            i, k, start, size = ids[doc], keys[doc], start.astype(np.int64), size.astype(np.int64)
            order = np.lexsort((k, i))
            i, k, start, size = (x[order] for x in (i, k, start, size))
            cut = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (k[1:] != k[:-1])]).tolist()
            gone = {(int(i[a]), int(k[a])): [start[a:b], start[a:b] + size[a:b] + self.length - 1] for a, b in zip(cut, [*cut[1:], len(i)], strict=True)}
        for i, k, text in zip(map(int, ids), map(int, keys), texts, strict=True):
            units = text.split() if self.words else text
            n, removed, parts, kept = len(units), 0, 0, text
            if (i, k) in gone:
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, gone[i, k][0], 1)
                np.add.at(step, gone[i, k][1], -1)
                hit = np.cumsum(step[:-1]) > 0
                removed, parts = int(hit.sum()), int(np.count_nonzero(np.diff(np.r_[0, hit.astype(np.int8)]) == 1))
                kept = b" ".join(w for w, x in zip(units, hit.tolist(), strict=True) if not x) if self.words else np.frombuffer(text, np.uint8)[~hit].tobytes()
            out.append((None if i == NO_ID else i, n, removed, parts, hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["doc_id", "n", "n_removed", "n_spans", "kept_sha256", "kept"])

    def __call__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows as ``rebuild`` gives them, one for each row of ``docs``."""
        spark = docs.sparkSession
        text = text_of(text_col)
        slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
        packed, find, match, extract, index, rebuild = (getattr(self, n) for n in ("packed", "find", "match", "extract", "index", "rebuild"))
        groups = staged(slim.mapInArrow(lambda b: packed(b), ROW))
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        self.partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.shards = max(1, -(-total // self.shard_bytes))
        self.tasks = max(min(self.shards, self.partitions), -(-total // TASK_BYTES))
        self.bundled = max(self.shards, groups.count()) > self.fan
        runs = staged(self.by_shard(groups.mapInArrow(lambda b: find(b), ROW)).applyInArrow(lambda k, t: match(k, t.select(["kind", "part", "blob"])), ROW))
        hot = runs.where(f"kind = {HOTTEST}").mapInArrow(self.hottest, "tag long, n long").groupBy("tag").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "tag").limit(HOT_MOST)
        self.hot = spark.sparkContext.broadcast(np.sort(hot.toArrow().column("tag").to_numpy().astype(np.uint32)))
        runs = self.by_group(self.single(runs.where(f"kind = {OWN}")))
        pieces = self.by_group(groups).cogroup(runs).applyInArrow(lambda k, d, r: extract(k, d, r), ROW)
        verdicts = self.by_shard(pieces, ragged=True).applyInArrow(lambda k, t: index(k, t.select(["kind", "part", "blob"])), ROW)
        result = "doc_id long, n long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        return self.by_group(groups).cogroup(self.by_group(self.single(verdicts))).applyInArrow(lambda k, d, r: rebuild(k, d, r), result)
