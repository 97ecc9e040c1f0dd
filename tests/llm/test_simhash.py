import numpy as np
import pytest
import xxhash

from colscan.llm.simhash import Forest, fingerprints, gray_rank, keep_one, links, near_duplicates, search, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(fps, sets=None):
    """{doc: smallest reachable doc} for {doc: fingerprint}; with ``sets``, over a similarity of 0.8 of these too."""

    def linked(x, y):
        if sets and sets[x] and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            return True
        return bin(fps[x] ^ fps[y]).count("1") <= 4

    ids, out = sorted(fps), {}
    for d in ids:
        if d in out:
            continue
        todo, out[d] = [d], d
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in out and linked(x, y):
                    out[y] = d
                    todo.append(y)
    return out


@pytest.mark.parametrize("text", ["a b c d e f", "One two", "", None, "A  b\tC\nd\x0be É é", "x " * 500])
def test_fingerprint(text):
    assert simhash(text) % (1 << 64) == slow_fingerprint(text)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_index_against_brute_force():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    x = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base] + [rng.integers(0, 2**63, 200, dtype=np.uint64)])
    x = np.unique(x)
    x = x[np.argsort(gray_rank(x))]
    assert len(x) > 300
    got, want = search(x), brute({i: int(v) for i, v in enumerate(x)})
    assert [want[g] for g in got] == [want[i] for i in range(len(x))]
    assert len(set(got)) == len(set(want.values()))


def grouped(rng, n_groups):
    """Groups of 1 to 700 fingerprints, some in dense clusters and some at random, in Gray order."""
    keys, xs = [], []
    for g in range(n_groups):
        n = int(rng.choice([1, 2, 3, 8, 9, 60, 700]))
        base = rng.integers(0, 2**63, max(1, n // 9), dtype=np.uint64)
        x = base[rng.integers(0, len(base), n)]
        for _ in range(int(rng.integers(0, 5))):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        x = np.unique(x)
        xs.append(x[np.argsort(gray_rank(x))])
        keys.append(np.full(len(x), g))
    return np.concatenate(keys), np.concatenate(xs)


def test_trees_against_brute_force():
    keys, x = grouped(np.random.default_rng(11), 25)
    lab = Forest(keys, x).connect()
    for g in np.unique(keys):
        at = np.flatnonzero(keys == g)
        want = brute({int(i): int(x[i]) for i in at})
        assert [want[int(i)] for i in lab[at]] == [want[int(i)] for i in at]
        assert len(set(lab[at].tolist())) == len(set(want.values()))


def test_trees_prune():
    """Most of what a pairwise comparison would look at is left with its subtree, in clusters and at random."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.unique(np.repeat(base, 100) ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)))
    apart = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    for x, most in ((near, 0.1), (apart, 0.6)):
        x = x[np.argsort(gray_rank(x))]
        f = Forest(np.zeros(len(x)), x)
        f.connect()
        assert len(f.levels) == 5 and f.pruned > f.met / 2
        assert f.compared < most * len(x) ** 2 / 2


def test_nodes_hold_what_all_below_share():
    keys, x = grouped(np.random.default_rng(12), 6)
    f = Forest(keys, x)
    begin = np.arange(len(x))
    for level in range(1, len(f.levels)):
        ones, zeros, cut, stop = f.levels[level]
        begin = begin[cut[:-1]]
        for i, (a, b) in enumerate(zip(begin, stop, strict=True)):
            assert len(set(keys[a:b])) == 1
            assert ones[i] == np.bitwise_and.reduce(x[a:b]) and zeros[i] == np.bitwise_and.reduce(~x[a:b])


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = near_duplicates(docs).collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute(fps)


@pytest.mark.parametrize("most", [3, 20, 200])
def test_hot_node_is_parted_and_tiled(spark, monkeypatch, most):
    monkeypatch.setattr("colscan.llm.simhash.TILE", most)
    rng = np.random.default_rng(3)
    fps = {i: int(v) for i, v in enumerate(np.unique(np.uint64(2**62 + 12345) ^ (np.uint64(1) << rng.integers(0, 40, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 40, 300, dtype=np.uint64))))}
    rows = links(spark.createDataFrame([(v,) for v in fps.values()], "fp long")).collect()
    reach = brute(fps)
    from colscan.llm.common import connected

    roots = {r.node: r.root for r in connected(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert len({roots.get(v, v) for v in fps.values()}) == len(set(reach.values()))


def test_edges(spark):
    rows = [(3, "same words here for all of us", None, None, 1), (1, "same words here for all of us", "x", "y", 2), (1, "same words here for all of us", "x", "y", 2), (5, None, None, None, None), (4, "", None, None, 0), (None, "nobody owns this one at all", None, None, 0), (9, "long " * 40000, "a", "b", 3)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 3, 1), (False, 4, 4), (False, 5, 4), (False, 9, 9), (True, 0, None)]
    kept = keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 9), (True, 0)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    long_ = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, long_("a"), "x"), (1, long_("b"), "y"), (2, long_("b"), "z"), (3, long_("c"), "q"), (3, long_("c"), "p"), (3, long_("c"), "p"), (None, long_("c"), "n")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, `n` string")).collect()
    assert sorted((r.doc_id or 0, r.text[0], r.n) for r in got) == [(0, "c", "n"), (1, "a", "x"), (1, "b", "y"), (3, "c", "p")]


@pytest.mark.parametrize("name", ["__id", "h", "d", "first", "n", "a.b"])
def test_keep_one_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b c d", "k"), (2, "a b c d", "l")], f"doc_id long, text string, `{name}` string")
    assert [tuple(r) for r in keep_one(docs).collect()] == [(1, "a b c d", "k")]


def test_fingerprints_ignore_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "k", 7)], "doc_id long, text string, fp string, node long")
    assert near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert keep_one(docs).columns == docs.columns
    assert fingerprints(docs).count() == 1
