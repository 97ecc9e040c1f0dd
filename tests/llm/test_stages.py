import math
import random

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from colscan.llm import decontaminate, mixing, ordinal, sharding
from colscan.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b c d e f", "x", "s", 1), (1, "a b c d e f", "x", "s", 1), (2, None, None, None, None), (3, "", "x", "t", 0), (None, "one two", "x", "s", 1), (4, "word " * 50_000, "x", "t", 1)]


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_leaks(docs, items):
    sets = {i: shingle_set(t) for i, t in items}
    out = set()
    for d, t in docs:
        have = shingle_set(t)
        out |= {(d, i) for i, s in sets.items() if s and len(s & have) >= 0.8 * len(s)}
    return out


def test_decontaminate_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert want
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want
    kept = {r.doc_id for r in decontaminate.clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_decontaminate_partial_passages_in_long_documents(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(12, 150)))) for i in range(20)]
    docs = []
    for d in range(80):
        part = items[d % 20][1].split()
        for _ in range(d % 4):
            part[r.randrange(len(part))] = "CHANGED"
        body = r.choices(vocab, k=r.randint(10, 6000))
        at = r.randrange(len(body))
        docs.append((d, " ".join(body[:at] + part + body[at:]).upper()))
    want = brute_leaks(docs, items)
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_scattered_pieces(spark):
    """Items cut into 3 to 30 pieces all over long documents: the search finds them, and the exact mode is sure to."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(20_000)]
    items, docs = [], []
    for i in range(40):
        item = r.choices(vocab, k=r.randint(120, 400))
        items.append((i, " ".join(item)))
        n = r.choice((3, 10, 30))
        cuts = sorted(r.sample(range(1, len(item)), n - 1))
        body = []
        for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True):
            # pieces overlap by four words, so that they have all of the item's shingles
            body += r.choices(vocab, k=r.randint(50, 400)) + item[max(0, a - 4) : b]
        docs.append((i, " ".join(body)))
    want = brute_leaks(docs, items)
    assert len(want) == 40
    rows, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.leaks(rows, bench, smallest=None).collect()} == want
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(rows, bench).collect()}
    assert got <= want and len(got) >= 36


def test_containment_is_decided_on_words(monkeypatch):
    """Under a hash of two values nearly everything is a candidate, and no more than before is found."""
    real = decontaminate.Words

    class Weak(real):
        def __init__(self, texts):
            super().__init__(texts)
            self.hash = self.hash & np.uint64(1)

    items, docs = ["a b c d e f g", "x y", "q r s t u"], ["a b c d e f h", "z x y z", "x z y", "q r s t u v", "b a c d e f g"]
    find = lambda: {(d, i, round(c, 3)) for d, i, c in decontaminate.Items([0, 1, 2], items, None).found(docs)}
    want = find()
    assert want == {(1, 1, 1.0), (3, 2, 1.0)}
    monkeypatch.setattr(decontaminate, "Words", Weak)
    assert find() <= want


def test_decontaminate_edges(spark):
    docs, items = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([(7, "A b  c\nd e"), (8, None), (9, ""), (10, "ONE two"), (11, "two one"), (None, "one two")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in decontaminate.leaks(docs, items).collect()) == [(0, 0), (0, 10), (1, 7), (1, 7)]
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_sharding_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for limit in (10**9, 50_000, 3_000):
        got = sorted(map(tuple, sharding.shards(docs, limit=limit).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "oversize").collect()))
        assert got == sorted(con.execute(sharding.shards_sql(limit)).fetchall())
    assert "op6_sharding" in oracle_sql()


def test_sharding_of_deep_leaves(spark):
    """A few keys share 24 first bits and more, so that leaves of depth 0 to 30 stand beside each other."""
    r = random.Random(8)
    keys = [(r.getrandbits(sharding.BITS), 10) for _ in range(300)] + [((5 << 36) + (i << 30), 400) for i in range(3)] + [((9 << 52) + i, 100) for i in range(40)]
    sizes = spark.createDataFrame(keys, "h long, bytes long")
    limit = 500
    leaves = sharding.directory(sizes, limit)
    rows = leaves.collect()
    assert max(x.depth for x in rows) > 50
    want = {}
    for h, _ in keys:
        for depth in range(61):
            own = [(x, b) for x, b in keys if x >> (60 - depth) == h >> (60 - depth)]
            if sum(b for _, b in own) <= limit or len({x for x, _ in own}) == 1:
                want[h] = (h >> (60 - depth), depth, sum(b for _, b in own))
                break
    assert {tuple(x) for x in rows} == set(want.values())
    for n in (len(rows), 3, 5000):
        table = {x.slot: x for x in sharding.slots(leaves, n).collect()}
        for h, leaf in want.items():
            slot = table[h >> (60 - next(iter(table.values())).width)]
            found = next(x for x in slot.leaves if x.last >= h)
            assert (found.prefix, found.depth, found.shard_bytes) == leaf


def test_sharding_without_a_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, sharding.shards(docs, limit=3000).collect()))
    monkeypatch.setattr(sharding, "SLOTS", 1)
    assert sorted(map(tuple, sharding.shards(docs, limit=3000).collect())) == want


@pytest.mark.parametrize("name", ["prefix", "h", "slot", "leaf", "d", "n", "leaves", "width", "__h", "a.b", "Depth"])
def test_sharding_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b", "keep"), (2, None, None)], f"doc_id long, text string, `{name}` string")
    got = sharding.shards(docs, limit=1).collect()
    assert sorted(r.n_bytes for r in got) == [0, 3]
    if name != "Depth":
        assert {r.doc_id: r[name] for r in got} == {1: "keep", 2: None}


def test_sharding_edges(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ODD], SCHEMA + ", shard string")
    got = sharding.shards(docs, limit=8).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.oversize for r in got} == {1: True, 2: False, 3: False, None: False, 4: True}
    assert sharding.shards(docs.limit(0)).count() == 0


def test_weights():
    totals = {"a": 900, "b": 90, "c": 10, "d": 0}
    x, w, passes = mixing.weights(totals, repeats=4)
    assert 0 < x < 1 and math.isclose(sum(w.values()), 1) and w["d"] == 0 and passes["d"] == 1
    assert math.isclose(max(passes.values()), 4, rel_tol=1e-6) and math.isclose(min(passes.values()), 1)
    x, w, _ = mixing.weights(totals, repeats=1e9, entropy=0.9)
    assert math.isclose(-sum(v * math.log(v) for v in w.values() if v), 0.9, rel_tol=1e-6)
    x, w, passes = mixing.weights(totals, repeats=1e9, budget=300)
    assert x == 0 and math.isclose(passes["c"], 10)
    assert mixing.weights({})[1] == {}


def int_hash(n, seed=42):
    return xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed)


def brute_plan(docs, block_tokens, seed=1, **how):
    """The plan's rows by plain loops: documents in order of their hash, running sums, passes and blocks."""
    sizes = {}
    for d, s, n in docs:
        sizes[d, s] = sizes.get((d, s), 0) + n
    totals = {}
    for (_, s), n in sizes.items():
        totals[s] = totals.get(s, 0) + n
    _, _, passes = mixing.weights(totals, **how)
    n_blocks = max(1, math.ceil(sum(t * passes[s] for s, t in totals.items()) / block_tokens))

    def key(d, s):
        h = int_hash(seed)
        h = xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), h) if d is not None else h
        return xxhash.xxh64_intdigest(s.encode(), h) if s is not None else h

    out = []
    for s, total in totals.items():
        at = 0
        for d, h in sorted(((d, key(d, t)) for d, t in sizes if t == s), key=lambda x: (x[1], x[0] is not None, x[0] or 0)):
            full = math.floor(passes[s])
            times = full + (at < math.floor((passes[s] - full) * total + 0.5))
            for e in range(times):
                share = (e * total + at) / max(1.0, passes[s] * total)
                rank = xxhash.xxh64_intdigest(e.to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), int_hash(seed + 1)))
                out.append((d, s, sizes[d, s], e, min(n_blocks - 1, math.floor(share * n_blocks)), rank - (1 << 64) if rank >> 63 else rank))
            at += sizes[d, s]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"repeats": 5.0}, {"repeats": 1.0}, {"repeats": 50.0, "entropy": 0.9}, {"budget": 30_000}, {"budget": 2_000, "repeats": 1.5}])
def test_plan_against_brute_force(spark, monkeypatch, how):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    docs = docs.unionByName(spark.createDataFrame([(3, "s", "a b c"), (3, "s", "d"), (None, "s", "x y"), (7, None, "u v w"), (8, "empty", None)], "doc_id long, source string, text string"))
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    got = sorted((tuple(r) for r in mixing.plan(docs, block_tokens=2000, **how).collect()), key=str)
    assert got == brute_plan(rows, 2000, **how)


def test_many_sources(spark, monkeypatch):
    """Sources whose totals are not broadcast have the same plan."""
    docs = spark.createDataFrame([(i, f"s{i % 300}", "w " * (i % 300 + 1)) for i in range(900)], "doc_id long, source string, text string")
    want = sorted(mixing.plan(docs, block_tokens=5000, entropy=5.4, repeats=9.0).collect())
    monkeypatch.setattr(mixing, "SOURCES", 10)
    assert sorted(mixing.plan(docs, block_tokens=5000, entropy=5.4, repeats=9.0).collect()) == want


def test_mixed_keeps_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = {(r.doc_id, r.epoch): (r.block, r.rank) for r in mixing.plan(docs, block_tokens=3000).collect()}
    out = mixing.mixed(docs, block_tokens=3000)
    assert out.columns == [*docs.columns, "epoch", "block", "rank"]
    rows = mixing.in_order(out, 1000, 100).collect()
    assert {(r.doc_id, r.epoch): (r.block, r.rank) for r in rows} == plan and len(rows) == len(plan)
    assert [(r.block, r.rank) for r in rows] == sorted(plan.values())


@pytest.mark.parametrize("name", ["__id", "__n", "__times", "i", "s", "d", "uses", "u", "block", "a.b"])
def test_mixing_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b", "x", "keep"), (None, None, None, None)], f"doc_id long, text string, source string, `{name}` string")
    rows = mixing.mixed(docs).collect()
    assert {r.doc_id for r in rows} == {1, None}
    if name != "block":
        assert {r[name] for r in rows} == {"keep", None}


def test_mixing_edges(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "epoch", "block", "rank"]
    got = out.collect()
    assert {r.doc_id for r in got} == {r[0] for r in ODD} and len(got) >= len(ODD)
    assert mixing.mixed(docs.limit(0)).count() == 0
    texts = ["", " ", "a", " a b\n", "\x0bx\x1cy z", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.tokens(mixing.text_of("text")).alias("n")).collect()
    assert [r.n for r in rows] == [len((t or "").encode().split()) for t in texts]


def test_ordinal_held_out(spark):
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]

    def text(grade):
        body = r.choices(vocab, k=r.randint(20, 60))
        if grade == 1:
            body[r.randrange(len(body))] = "nasty"
            body[r.randrange(len(body))] = "nastily"
        return " ".join(w + "%%" for w in body) if grade == 0 else " ".join(body)

    grades = [r.choice((0, 1, 2, 2)) for _ in range(1200)]
    memo = {}
    x = [ordinal.features(text(g), memo) for g in grades]
    model = ordinal.fit(x[:800], np.array(grades[:800]))
    top = [1 / (1 + np.exp(model.cuts[-1] - model.weights[f].sum())) >= 0.5 for f in x[800:]]
    assert np.mean([t == (g == 2) for t, g in zip(top, grades[800:], strict=True)]) > 0.95
    assert (np.diff(model.cuts) > 0).all()


def test_ordinal_held_out_labels():
    con = duckdb.connect()
    sf = "/root/testdata/sf0.1"
    rows = con.execute(f"select text, quality, toxic from '{sf}/documents.parquet' join '{sf}/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()
    memo = {}
    x, grade = [ordinal.features(t, memo) for t, *_ in rows], np.array([0 if toxic else 1 + q for _, q, toxic in rows])
    model = ordinal.fit(x[:2600], grade[:2600])
    top = np.array([1 / (1 + np.exp(model.cuts[-1] - model.weights[f].sum())) >= ordinal.KEEP for f in x[2600:]])
    kept = [top[grade[2600:] == g].mean() for g in range(3)]
    assert kept[0] < 0.03 and kept[1] < 0.04 and kept[2] > 0.98


def slow_ordinal(x, rows, y, n_used, n_grades, importance, ridge=2e-4):
    """Penalised negative log-likelihood of (weights, first cut, log steps), with a loop over rows and grades."""
    w, cuts = x[:n_used], np.cumsum(np.r_[x[n_used], np.exp(x[n_used + 1 :])])
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    total = 0.0
    for r, g, i in zip(rows, y, importance, strict=True):
        s = sum(w[f] for f in r)
        below = [0.0, *(sigmoid(c - s) for c in cuts), 1.0]
        total -= i * math.log(max(1e-12, below[g + 1] - below[g]))
    return total + ridge / 2 * float(w @ w)


@pytest.mark.parametrize("n_grades", [2, 3, 4])
def test_ordinal_likelihood_and_gradient(n_grades):
    r = np.random.default_rng(n_grades)
    n_used = 12
    rows = [np.unique(r.integers(0, n_used, 4)) for _ in range(60)]
    y = np.arange(60) % n_grades
    importance = r.random(60)
    x = np.r_[r.normal(size=n_used), -0.7, r.normal(size=n_grades - 2) * 0.3]
    at, column = np.repeat(np.arange(60), [len(v) for v in rows]), np.concatenate(rows)
    loss, grad = ordinal.objective(x, at, column, y, importance, n_used, n_grades, 2e-4)
    assert math.isclose(loss, slow_ordinal(x, rows, y, n_used, n_grades, importance), rel_tol=1e-9)
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-6
        slope = (slow_ordinal(x + step, rows, y, n_used, n_grades, importance) - slow_ordinal(x - step, rows, y, n_used, n_grades, importance)) / 2e-6
        assert abs(slope - grad[k]) < 1e-5 * max(1, abs(slope))


def test_ordinal_fit_comes_near_the_optimum():
    """Adam's fit against plain gradient descent with the slow objective's value, on a small sample."""
    r = random.Random(1)
    memo = {}
    texts = [" ".join(r.choices(["good", "fine", "well"] if i % 3 == 2 else ["bad", "poor"] if i % 3 else ["awful", "vile"], k=6) + r.choices("abcdef", k=8)) for i in range(90)]
    x, y = [ordinal.features(t, memo) for t in texts], np.arange(90) % 3
    short, long_ = ordinal.fit(x, y, rounds=150), ordinal.fit(x, y, rounds=1500)
    importance = np.full(90, 1 / 90)

    def loss(model):
        cuts = model.cuts
        used = np.flatnonzero(model.weights)
        place = {f: i for i, f in enumerate(used.tolist())}
        rows = [[place[f] for f in v.tolist() if f in place] for v in x]
        return slow_ordinal(np.r_[model.weights[used].astype(float), cuts[0], np.log(np.diff(cuts))], rows, y, len(used), 3, importance)

    assert loss(short) < loss(long_) + 0.02 and loss(short) < 0.2


@pytest.mark.parametrize("ratings", [[], [(1, None)], [(1, 0), (1, 2), (2, 2), (2, 2)], [(None, 2), (1, 1)]])
def test_ordinal_odd_ratings(spark, ratings):
    """Null ratings and ids are left out; of conflicting ratings of an id the lowest counts; repeats count once."""
    docs = spark.createDataFrame([(1, "bad text"), (2, "good text"), (2, "good text")], "doc_id long, text string")
    model = ordinal.train(docs, spark.createDataFrame(ratings, "doc_id long, grade int"))
    if ratings and ratings[0] == (1, 0):
        want = ordinal.train(docs, spark.createDataFrame([(1, 0), (2, 2)], "doc_id long, grade int"))
        assert (model.weights == want.weights).all()
    assert ordinal.scores(docs, model).count() == 3


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null, empty, repeated and very long rows, and columns of clashing names, through all stages."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(901, None, None, None, None), (902, "", "en", "web", 0), (None, "a text without an id " * 9, "en", "web", 1), (903, "long word " * 40_000, "en", "web", 1), (904, "twice the same words stand here in this row", "en", "web", 1), (904, "twice the same words stand here in this row", "en", "web", 1)], SCHEMA)
    from pyspark.sql import functions as F

    names = ["keep", "row", "grade", "a.b", "shard", "h", "d", "i", "s", "first", "fp", "key", "uses", "__id"]
    docs = base.unionByName(odd).select("*", *[F.lit("kept").alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) > 5 and sum(r.doc_id == 904 for r in rows) <= 2
    assert all({r[n] for r in rows} == {"kept"} for n in names if n != "shard")


def test_pipeline_of_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ordinal_takes_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad bad bad"), *[(1, "good words here")] * 500], "doc_id long, text string")
    rated = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int")
    once = ordinal.train(docs.distinct(), rated)
    assert (ordinal.train(docs, rated).weights == once.weights).all()


def test_ordinal_edges(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([(1, None), (None, 2)], "doc_id long, grade int")
    model = ordinal.train(docs, none)
    got = ordinal.scores(docs, model).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert ordinal.scores(docs.limit(0), model).count() == 0
    assert ordinal.select(docs, model).columns == docs.columns


def test_pipeline_stage_by_stage(spark):
    from colscan.llm.common import table

    from .test_simhash import brute, shingles, slow_fingerprint

    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    graded = stages["quality classifier"](spark, docs, SF).collect()
    again = {r.doc_id for r in queries()["op4_ordinal"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in graded} == again
    graded = spark.createDataFrame(graded, docs.schema)
    single = stages["near duplicates"](spark, graded, SF).collect()
    fps = {r.doc_id: slow_fingerprint(r.text, 5) for r in graded.collect()}
    assert {r.doc_id for r in single} == set(brute(fps, {r.doc_id: shingles(r.text) for r in graded.collect()}).values())
    single = spark.createDataFrame(single, docs.schema)
    pure = stages["decontamination"](spark, single, SF).collect()
    leaks = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in single.collect()], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])}
    assert {r.doc_id for r in pure} == {r.doc_id for r in single.collect()} - leaks
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in pure}
    # the mixing stage has every use of a document that its plan has, and the shards are those of these rows
    pure = spark.createDataFrame(pure, docs.schema)
    uses = sorted(r.doc_id for r in mixing.plan(pure).collect())
    assert sorted(r.doc_id for r in got) == uses
    assert stages["mixing"](spark, pure, SF).columns == docs.columns
    weights = {}
    for r in got:
        weights[r.shard] = weights.get(r.shard, 0) + r.n_bytes
    assert all(weights[r.shard] == r.shard_bytes for r in got)
    assert all(r.shard_bytes <= sharding.SHARD_BYTES for r in got)


@pytest.mark.parametrize("name", sorted(queries()))
def test_names(name):
    assert name.startswith("op") and name.split("_")[0][2:].isdigit()
