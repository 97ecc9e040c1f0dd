"""Substring dedup by a compressed FM-index per shard: backward search over a wavelet matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Repeats
from .wordhash import Words

#: Words of a stretch, and of the pieces whose least hash names it.
LENGTH, GRAM = 20, 10
#: Symbols at which a search begins with a table; the rest is backward search.
SEED = 8
#: Stretches searched for at once, and bytes whose words are hashed at once.
BATCH, SLAB = 1 << 16, 1 << 20


#: The bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Wavelet:
    """Rank of symbols in a sequence, from one bit vector for each bit of the symbols: 64-bit words and the ones before each,
    in 32 bits, so a symbol of b bits takes 1.5 b bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        self.bits = max(1, int(sigma - 1).bit_length())
        first = np.arange(sigma)
        n = len(seq)
        place = np.zeros(sigma, np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b & 1).astype(bool)
            padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int32)].astype(np.int32)
            zeros = n - int(counts[-1])
            self.levels.append((b, words, counts, zeros))
            place = self._step(place.astype(np.int32), (first >> b & 1).astype(bool), words, counts, zeros)
            seq = np.concatenate((seq[~bit], seq[bit]))
        self.base = place

    @staticmethod
    def _step(i, bit, words, counts, zeros):
        w = i >> 6
        ones = counts[w] + np.bitwise_count(words[w] & _BELOW[i & 63])
        return np.where(bit, zeros + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before place ``i``."""
        i = i.astype(np.int32)
        for b, words, counts, zeros in self.levels:
            i = self._step(i, (symbol >> b & 1).astype(bool), words, counts, zeros)
        return i - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``text`` ordered by the next ``depth`` symbols at least (prefix doubling), and the rank of each place's
    first ``seed`` symbols (a power of two) among all such."""
    rank, have = text.astype(np.int64), 1
    order, seeds = np.argsort(rank, kind="stable"), rank
    while have < depth:
        key = rank * (int(rank.max()) + 2)
        key[: len(key) - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        have *= 2
        if have == seed:
            seeds = rank
    return order, seeds


class FMIndex:
    """Index of a text whose symbol 0 parts the documents; answers patterns of up to ``depth`` symbols.

    The intervals of all strings of ``SEED`` symbols are kept as a table, so that a search takes up there. The text is
    held once, in 32 bits a symbol; the suffix order goes when its Burrows-Wheeler transform is in the wavelet matrix.
    """

    def __init__(self, text: np.ndarray, depth: int):
        sigma = int(text.max()) + 1
        self.seed = 1 << (min(depth, SEED).bit_length() - 1)
        order, seeds = suffix_order(text, depth, self.seed)
        self.seeds, self.first = seeds.astype(np.int32), np.r_[0, np.cumsum(np.bincount(seeds))]
        self.text = text.astype(np.int32)
        self.wavelet = Wavelet(text[order - 1], sigma)  # the Burrows-Wheeler transform; place 0 wraps to the last symbol
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]

    def intervals(self, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the strings of ``width`` symbols at some places: (first, end, symbols matched) of each.

        A string whose interval has shrunk to one place occurs nowhere else; its search ends there, so the number of
        symbols is the matching statistic where it is between the seed's and the string's length.
        """
        skip = width - self.seed
        group = self.seeds[places + skip]
        lo, hi = self.first[group], self.first[group + 1]
        live = np.flatnonzero(hi - lo > 1)
        matched = np.where(hi - lo > 1, self.seed, 0)
        for j in range(skip - 1, -1, -1):
            if not len(live):
                break
            # Equal strings have equal intervals, so each interval and symbol is looked up once.
            c = self.text[places[live] + j]
            one, again = np.unique(lo[live] * np.int64(len(self.below)) + c, return_inverse=True)
            c, start = one % len(self.below), one // len(self.below)
            stop = np.zeros(len(one), np.int64)
            stop[again] = hi[live]
            both = self.wavelet.rank(np.concatenate((c, c)), np.concatenate((start, stop)))
            lo[live], hi[live] = (self.below[c] + both[: len(c)])[again], (self.below[c] + both[len(c) :])[again]
            live = live[hi[live] - lo[live] > 1]
            matched[live] += 1
        return lo, hi, matched


def symbols(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, bounds of the segments): equal numbers for equal words and only for these.

    Hashes group the words; every word is then held against the first of its group byte by byte. The segments'
    texts are data[cuts[i]:cuts[i + 1]]; words are found in slabs of whole segments.
    """
    hashes, start, end, counts = [], [], [], []
    a = 0
    while a < len(cuts) - 1:
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + SLAB, "right")) - 1)
        w = Words([data[x:y].tobytes() for x, y in zip(cuts[a:b], cuts[a + 1 : b + 1], strict=True)])
        shift = cuts[a] - np.arange(b - a)  # the texts stand there with one byte between them
        hashes.append(w.hash)
        start.append((w.start + shift[w.doc]).astype(np.int32))
        end.append((w.end + shift[w.doc]).astype(np.int32))
        counts.append(np.diff(w.bounds))
        a = b
    hashes, start, end = (np.concatenate(x) for x in (hashes, start, end))
    bounds = np.r_[0, np.cumsum(np.concatenate(counts))]
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = end - start
    like = first[number]
    same = bool((size == size[like]).all())
    other = np.flatnonzero(like != np.arange(len(like)))
    for a in range(0, len(other), BATCH) if same else ():
        own = other[a : a + BATCH]
        n = size[own]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(start[own], n) + step] != data[np.repeat(start[like[own]], n) + step]).any():
            same = False
            break
    if not same:
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        number = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in zip(start.tolist(), end.tolist(), strict=True)])
    return number, bounds


def decide(job: Repeats, data, cuts, ids, keys, start, size) -> np.ndarray:
    """Streams the segments through an index of them all; True at stretches that start earlier somewhere."""
    symbol, bounds = symbols(data, cuts)
    text = np.zeros(len(symbol) + len(size), np.int64)
    text[np.arange(len(symbol)) + np.repeat(np.arange(len(size)), np.diff(bounds))] = symbol + 1
    index = FMIndex(text, job.length)
    of = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    place = bounds[:-1][of] + of + at
    interval = np.full(len(of), -1)
    for a in range(0, len(of), BATCH):
        lo, _, matched = index.intervals(place[a : a + BATCH], job.length)
        interval[a : a + BATCH] = np.where(matched == job.length, lo, -1 - np.arange(a, a + len(lo)))
    begin = start[of] + at
    order = np.lexsort((begin, keys[of], ids[of], interval))
    same = lambda x: x[order][1:] == x[order][:-1]
    more = np.r_[False, same(interval)] if len(of) else np.zeros(0, bool)
    # equal places are one and the same stretch, told twice by repeated rows
    twin = np.r_[False, same(interval) & same(ids[of]) & same(keys[of]) & same(begin)] if len(of) else more
    first = np.maximum.accumulate(np.where(~more, np.arange(len(of)), 0))
    apart = np.flatnonzero(~twin)
    group = apart[np.searchsorted(apart, np.arange(len(of)), "right") - 1] if len(of) else first
    out = np.zeros(len(of), bool)
    out[order] = more & (group != first)
    return out


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row: words covered by a repeated stretch are removed.

    A stretch is repeated if the same ``length`` words start earlier: in a document of smaller id, or earlier in the
    same one. Rows of one id but different text are ordered by a hash of the text; equal rows are one document, each
    with its result. A null id comes after all others; null and blank texts have no words; a text of any length is
    taken whole. Other columns of ``docs``, of whatever names, are not read. Empty tables give no rows.
    """
    from pyspark.sql import functions as F

    out = Repeats(length, min(GRAM, length // 2), True, True, decide)(docs, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256", "kept")


def words_sql(length: int = LENGTH) -> str:
    """DuckDB form of ``dedup_words`` over documents(doc_id, text) with unique ids, without the kept text."""
    return f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
     g as (select doc_id, i, array_to_string(w[i:i + {length - 1}], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {length - 2})) as i from d)),
     f as (select s, min({{'d': doc_id, 'i': i}}) as first from g group by s),
     r as (select doc_id, i from g join f using (s) where {{'d': doc_id, 'i': i}} > first),
     c as (select distinct doc_id, unnest(range(i, i + {length})) as p from r),
     k as (select doc_id, p, x from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d) anti join c using (doc_id, p)),
     t as (select doc_id, count(*) as n, string_agg(x, ' ' order by p) as kept from k group by doc_id)
select d.doc_id, len(d.w) as n_words, len(d.w) - coalesce(t.n, 0) as n_removed, sha256(coalesce(t.kept, '')) as kept_sha256 from d left join t using (doc_id)
"""
