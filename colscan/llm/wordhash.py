"""Vectorised words and word n-grams of whole texts, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled in one go (one longer text is still taken whole).
SLAB = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
#: True at bytes that belong to words: all but space and tab to carriage return.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, SLAB + 4096), base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= SLAB + 4096:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Places in a word whose scrambles are looked up; those of later bytes are computed.
PLACES = 64
_BYTE_AT = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, from one running sum; equal content gives equal hashes anywhere."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(_R, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_RINV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def slabs(texts: list[bytes], most: int = SLAB) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of about ``most`` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word: the sum of a scramble of every byte together with its place in the word.

    No base is raised to powers, whose low bits a word of a regular pattern can cancel, however long the words are.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[start] = start
    code = np.arange(len(data)) - np.maximum.accumulate(first)
    far = np.flatnonzero(code >= PLACES)
    code <<= 8
    code |= data
    value = _BYTE_AT[code & (PLACES * 256 - 1)]
    value[far] = mix(code[far].astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[end] - total[start] + mix((end - start).astype(np.uint64)))


class Words:
    """Words of some texts: ``hash``, byte ``start``/``end`` in ``data``, ``doc`` (index of the text), and ``bounds``,
    where text i has the words bounds[i]:bounds[i+1]."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        inside = np.zeros(len(self.data) + 2, dtype=np.int8)
        inside[1:-1] = IN_WORD[self.data]
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.hash = word_hashes(self.data, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of each run of k words of one text."""
        at = np.arange(max(0, len(self.hash) - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        return spans(self.hash, at, at + k), at


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]
