import random

import numpy as np

from colscan.llm import alike
from colscan.llm.simhash import fingerprints_and_sketches, keep_one, near_duplicates

from .test_simhash import brute, shingles, slow_fingerprint


def edited(words, share, r):
    return [f"new{r.randrange(10**6)}" if r.random() < share else w for w in words]


def family(seed=3, sizes=(30, 80, 200, 2000)):
    """Texts with copies that differ by few or many words; of some texts a group of copies of one original."""
    r = random.Random(seed)
    out = []
    for n in sizes:
        for _ in range(4):
            base = [f"w{r.randrange(5000)}" for _ in range(n)]
            out += [" ".join(base), *(" ".join(edited(base, s, r)) for s in (0.005, 0.01, 0.02, 0.03, 0.1))]
    return out


def test_sketches_tell_similarity_exactly_in_texts_of_few_shingles():
    texts = family(sizes=(30, 80, 200))
    made = alike.sketches([t.encode() for t in texts], 5)
    sets = [shingles(t) for t in texts]
    least = [np.frombuffer(s[2], np.uint32, offset=64) for s in made]
    for i in range(len(texts)):
        for j in range(i):
            assert alike.alike(least[i], least[j]) == (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))


def test_bucket_links_connect_what_is_similar():
    texts = family()
    made = alike.sketches([t.encode() for t in texts], 5)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    got = alike.bucket_links(order, [made[i][2] for i in order])
    root = list(range(len(texts)))
    for a, b in got:
        root = [root[a] if x == root[b] else x for x in root]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    clear = [(i, j) for i in sets for j in range(i) if len(sets[i] & sets[j]) >= 0.87 * len(sets[i] | sets[j])]
    assert clear and all(root[i] == root[j] for i, j in clear)
    assert all(len(sets[a] & sets[b]) >= 0.72 * len(sets[a] | sets[b]) for a, b in got)


def test_near_copies_of_documents(spark, monkeypatch):
    monkeypatch.setattr(alike, "TILE", 3)
    texts = family(5, (30, 80, 200)) + ["a b c", "A b  c", "", None, "one two three four five"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute({i: slow_fingerprint(t, 5) for i, t in enumerate(texts)}, {i: shingles(t) for i, t in enumerate(texts)})
    got = near_duplicates(docs, width=5, similar=True).where("doc_id is not null").collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == 2 * len(texts)
    assert len(set(want.values())) < len(set(brute({i: slow_fingerprint(t, 5) for i, t in enumerate(texts)}).values()))
    kept = [r.doc_id for r in keep_one(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(set(want.values()))
    assert fingerprints_and_sketches(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
