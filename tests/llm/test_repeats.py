import hashlib
import random

import numpy as np
import pytest

from colscan.llm import fmindex, repeats, suffixlog, wordhash

SCHEMA = "doc_id long, text string, part long, blob string"


def words_brute(docs, n=20):
    seen, out = {}, {}
    order = sorted(docs)
    split = {d: (docs[d] or "").encode().split() for d in order}
    for d in order:
        for i in range(len(split[d]) - n + 1):
            seen.setdefault(tuple(split[d][i : i + n]), (d, i))
    for d in order:
        hit = set()
        for i in range(len(split[d]) - n + 1):
            if seen[tuple(split[d][i : i + n])] < (d, i):
                hit.update(range(i, i + n))
        kept = b" ".join(w for i, w in enumerate(split[d]) if i not in hit)
        out[d] = (len(split[d]), len(hit), hashlib.sha256(kept).hexdigest())
    return out


def bytes_brute(docs, n=50):
    seen, out = {}, {}
    for d in sorted(docs):
        t = (docs[d] or "").encode()
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], d)
    for d in sorted(docs):
        t = (docs[d] or "").encode()
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] < d:
                hit[i : i + n] = True
        out[d] = (len(t), int(hit.sum()), int((hit[1:] & ~hit[:-1]).sum() + hit[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~hit[:-1]].tobytes()).hexdigest())
    return out


def made():
    r = random.Random(5)
    vocab = ["a", "of", "the", "été", "x1", "longer-word"]
    passages = [" ".join(r.choices(vocab, k=r.randint(18, 90))) for _ in range(6)]
    docs = {i: " ".join(r.choice(passages) if r.random() < 0.3 else " ".join(r.choices(vocab, k=r.randint(1, 40))) for _ in range(r.randint(0, 6))) for i in range(60)}
    return docs | {70: None, 71: "", 72: "\n\t ", 73: "a " * 3000, 74: "a  " * 2500, 75: "z" * 130_000, 76: docs[3], 77: docs[3]}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 30_000)
    monkeypatch.setattr(suffixlog, "BATCH", 700)
    monkeypatch.setattr(fmindex, "BATCH", 1000)


def test_words(spark, small):
    docs = made()
    got = fmindex.dedup_words(spark.createDataFrame([(d, t, 1, "b") for d, t in docs.items()], SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == words_brute(docs)


def test_bytes(spark, small):
    docs = made()
    got = suffixlog.dedup_bytes(spark.createDataFrame([(d, t, 1, "b") for d, t in docs.items()], SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == bytes_brute(docs)


@pytest.mark.parametrize("hot", [2, 1024])
@pytest.mark.parametrize("fan", [2, 4096])
def test_bundles_and_hot_hashes(spark, small, monkeypatch, hot, fan):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FAN", fan)
    monkeypatch.setattr(repeats, "SPLIT_BYTES", 2000)
    docs = made()
    rows = spark.createDataFrame([(d, t, 1, "b") for d, t in docs.items()], SCHEMA)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.dedup_words(rows).collect()} == words_brute(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixlog.dedup_bytes(rows).collect()} == bytes_brute(docs)


def test_a_short_phrase_in_every_document_is_spread(spark, monkeypatch):
    """A phrase of 47 bytes (16 words) with different text around it each time: no shard has all of it."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 30_000)
    monkeypatch.setattr(repeats, "HOT", 50)
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    noise = lambda n: "".join(r.choices(letters, k=n))
    words = " ".join(noise(2) for _ in range(16))
    docs = {i: f"{' '.join(noise(6) for _ in range(20))} {words} {' '.join(noise(6) for _ in range(20))} {noise(60)}{words[:29]}" for i in range(600)}
    docs |= {600 + i: docs[i] for i in range(5)}
    for make, brute, length, gram, words_, within, decide in ((fmindex, words_brute, 20, 10, True, True, fmindex.decide), (suffixlog, bytes_brute, 50, 24, False, False, suffixlog.decide)):
        job = repeats.Repeats(length, gram, words_, within, decide, 4000)
        loads = spark.sparkContext.accumulator(0)

        def counted(j, data, *rest, decide=decide, loads=loads):
            loads.add(max(0, len(data) - 60_000))
            return decide(j, data, *rest)

        job.decide = counted
        rows = spark.createDataFrame([(d, t, 1, "b") for d, t in docs.items()], SCHEMA)
        got = {x.doc_id: x for x in job(rows).collect()}
        want = brute(docs)
        assert {d: (x.n, x.n_removed) for d, x in got.items()} == {d: v[:2] for d, v in want.items()}
        assert len(job.hot.value) >= 1 and job.shards > 10
        assert loads.value == 0, make.__name__


def test_words_are_compared_by_their_bytes(spark, monkeypatch):
    """Long words of a regular pattern, and words under a hash that has only two values."""
    pattern = lambda c: "".join("ab"[(i.bit_count() + c) & 1] for i in range(2048))
    head = " ".join(f"w{i}" for i in range(19))
    docs = {1: f"{head} {pattern(0)}", 2: f"{head} {pattern(1)}", 3: f"{head} {pattern(0)}"}
    got = fmindex.dedup_words(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 20}
    assert wordhash.Words([docs[1].encode()]).hash[-1] != wordhash.Words([docs[2].encode()]).hash[-1]
    real = wordhash.Words

    class Weak(real):
        def __init__(self, texts):
            super().__init__(texts)
            self.hash &= np.uint64(1)

    segments = [b"a b c", b"c d a", b"dd a"]
    want = [x for s in segments for x in s.split()]
    for kind in (real, Weak):
        monkeypatch.setattr(fmindex, "Words", kind)
        number, bounds = fmindex.symbols(np.frombuffer(b"".join(segments), np.uint8), np.cumsum([0, *map(len, segments)]))
        assert bounds.tolist() == [0, 3, 6, 8]
        assert all((number[i] == number[j]) == (want[i] == want[j]) for i in range(8) for j in range(8))


def test_suffix_arrays_against_brute_force():
    r = np.random.default_rng(2)
    for length in (3, 8, 11, 50):
        data = np.repeat(r.integers(97, 99, 400, dtype=np.uint8), 3)
        family = suffixlog.Family(data, length)
        seen: dict[bytes, int] = {}
        for doc, at in enumerate(np.array_split(np.arange(len(data) - length), 23)):
            place = np.concatenate((at, at[:5]))
            ids = np.full(len(place), doc)
            text = [data[p : p + length].tobytes() for p in place]
            assert family.add(place, ids).tolist() == [seen.get(t, doc) < doc for t in text]
            for t in text:
                seen.setdefault(t, doc)
        assert sum(len(x[0]) for x in family.levels) == len(seen)
        for heads, places, _ in family.levels:
            texts = [data[p : p + length].tobytes() for p in places]
            assert texts == sorted(texts) and (np.diff(heads.astype(float)) >= 0).all()


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.dedup_words(docs).collect()} == words_brute(plain)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixlog.dedup_bytes(docs).collect()} == bytes_brute(plain)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 0, ""), (1, text, 0, ""), (None, text, 0, ""), (None, None, None, None)]
    got = fmindex.dedup_words(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 0, 0), (0, 30, 30), (1, 30, 0), (1, 30, 0)]
    got = suffixlog.dedup_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, len(text)), (1, 0), (1, 0)]
    assert fmindex.dedup_words(spark.createDataFrame([], SCHEMA)).count() == 0
    assert suffixlog.dedup_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fm_index_counts():
    r = np.random.default_rng(1)
    text = r.integers(1, 3, 400)
    for n in (8, 9, 16, 20):
        text[200 : 200 + n + 5] = text[: n + 5]
        index = fmindex.FMIndex(np.r_[text, 0], 20)
        lo, hi, matched = index.intervals(np.arange(60), n)
        for i, (a, b, m) in enumerate(zip(lo, hi, matched, strict=True)):
            many = lambda k: sum((text[j : j + k] == text[i + n - k : i + n]).all() for j in range(len(text) - k + 1))
            assert many(n) == (b - a if m == n else 1)
            # the matching statistic: the longest end of the string that also stands elsewhere, from a seed's length on
            assert m == max((k for k in range(8, n + 1) if many(k) > 1), default=0)


def test_pack():
    a = [np.arange(5, dtype=np.uint16), np.array([-(2**62), 7]), np.frombuffer(b"xyz", np.uint8), np.zeros(0, np.uint64)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, repeats.unpack(repeats.pack(*a)), strict=True))
