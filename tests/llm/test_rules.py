import re

import numpy as np
import xxhash

from colscan.llm import forest
from colscan.llm.forest import judged, plant, statistics
from colscan.llm.urlfilter import RULES, filtered

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    from collections import Counter

    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


ODD = ["", None, " \n\t", "a b c d e a b c d e a", "x\ny\nx\n\n \n \nx", "été ñandú # * | <b>", "a " * 9000, "\x85 \xa0 a\x1cb", "a\r\nb\r\na\r"]


def test_statistics():
    got = statistics(ODD)
    assert [tuple(map(int, r[:5])) for r in got] == [base(t) for t in ODD]
    assert [int(r[8]) for r in got] == [len(t or "") for t in ODD]


def test_judged(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in judged(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        r, b = got[d], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r.base_failed and r.kept)
    rows = [(r.quality, got[r.doc_id].kept) for r in labels.collect()]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    assert np.mean(good) > 0.85 and np.mean(bad) < 0.2


def test_forest_finds_what_lies_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    f = plant(x)
    assert f.scores(np.array([[9.0, -9, 9]]))[0] > f.scores(x).max()


def test_judged_edges(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a", 1), (0, "", 2)], "doc_id long, text string, good long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judged(docs, none).count() == len(ODD) + 2
    assert judged(docs.limit(0), none).count() == 0


def by_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
    best = None
    for kind, rule in RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (kind, rule)
    return host, path, best


def test_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in filtered(pages).collect()}
    for r in pages.collect():
        host, path, best = by_rule(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, best and best[1])
        assert g.verdict == best[0] if best else g.verdict in ("allow", "block")


def test_url_edges(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?q#f", "a://b://c/d", "x://net/es/", "x://net/esx", "x://sub.example.com/en", "x://É.com/\nq", "x://" + "a" * 50000]
    rows = [(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[3], None, None)]
    got = filtered(spark.createDataFrame(rows, "page_id long, url string, host string, score string")).collect()
    assert len(got) == len(rows)
    for g in got:
        host, path, best = by_rule(urls[g.page_id if g.page_id is not None else 3])
        assert (g.host, g.path, g.rule) == (host, path, best and best[1])
    assert filtered(spark.createDataFrame([], "page_id long, url string")).count() == 0


def slow_path(tree, row):
    """Path length of a row in one tree, node by node."""
    feature, split, left, length = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] + (1 if row[feature[at]] >= split[at] else 0)
    return length[at]


def test_forest_scores_against_plain_paths():
    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=300), r.integers(0, 4, 300), np.full(300, 2.0)])
    trees = forest.plant(x, trees=20, rows=64)
    expected = float(forest.mean_path(64))
    want = [2 ** -(np.mean([slow_path(t, row) for t in trees.trees]) / expected) for row in x[:50]]
    assert np.allclose(trees.scores(x[:50]), want)
    odd = np.array([[30.0, 3, 2.0]])
    assert trees.scores(odd)[0] > np.quantile(trees.scores(x), 0.95)


def test_trees_split_between_extremes():
    """Every inner node has rows on both sides; leaves count what an unfinished subtree would still take."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(64, 3)), 1)
    feature, split, left, length = forest.grow(x, r, 6)

    def walk(at, rows, depth):
        if feature[at] < 0:
            assert length[at] == depth + float(forest.mean_path(len(rows)))
            return len(rows)
        right = rows[:, feature[at]] >= split[at]
        assert 0 < right.sum() < len(rows)
        return walk(left[at], rows[~right], depth + 1) + walk(left[at] + 1, rows[right], depth + 1)

    assert walk(0, x, 0) == 64


def test_verdicts_of_documents_recomputed(spark):
    """Sample, forest, cut and verdict again, from the texts and labels by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in judged(docs, labels, trees=16, rows=32).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    stats = forest.statistics([t for _, t in texts])
    failed = {d: s[0] < 10 or 100 * s[4] > 20 * s[0] for (d, _), s in zip(texts, stats, strict=True)}
    good = {}
    for r in labels.collect():
        good[r.doc_id] = min(good.get(r.doc_id, True), r.quality == 1)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ordered = sorted((signed(xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)), d, i) for i, (d, _) in enumerate(texts) if not failed[d] and good.get(d, True))
    x = forest.vectors(stats)
    trees = forest.plant(x[[i for _, _, i in ordered[: 16 * 32]]], 16, 32)
    score = {d: 2 ** -(np.mean([slow_path(t, x[i]) for t in trees.trees]) / float(forest.mean_path(32))) for i, (d, _) in enumerate(texts)}
    tally = np.zeros((2, forest.BINS))
    for d, v in score.items():
        if d in good and not failed[d]:
            tally[int(good[d]), min(forest.BINS - 1, int(v * forest.BINS))] += 1
    cut = max(range(forest.BINS), key=lambda n: (round(tally[1, : n + 1].sum() / tally[1].sum() - tally[0, : n + 1].sum() / tally[0].sum(), 12), -n)) + 1
    for d, r in got.items():
        assert abs(r.anomaly - score[d]) < 1e-6 and r.base_failed == failed[d]
        if abs(score[d] - cut / forest.BINS) > 1e-9:
            assert r.kept == (not failed[d] and score[d] < cut / forest.BINS)
