import random

from colscan.llm import decontaminate
from colscan.llm.decontaminate import Items


def runs(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, items):
    out = set()
    for i, item in enumerate(items):
        k = min(5, len(item))
        own = runs(item, k)
        out |= {(d, i) for d, doc in enumerate(docs) if 5 * len(own & runs(doc, k)) >= 4 * len(own)}
    return out


def cases():
    """Items of 1 to 20 words, whole, with a word changed and at either end, in documents of about 400 words; a few words only."""
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    items = [r.choices(vocab, k=n) for n in range(1, 21) for _ in range(15)]
    docs = []
    for item in items:
        body, changed = r.choices(vocab, k=400), [*item]
        changed[r.randrange(len(item))] = "changed"
        at = r.randrange(400)
        docs += [body[:at] + item + body[at:], body[:at] + changed + body[at:], item + body, body + item, item]
    return docs, items


def test_short_items_in_long_documents():
    docs, items = cases()
    got = {(d, i) for d, i, c in Items(list(range(len(items))), [" ".join(x) for x in items]).found([" ".join(x) for x in docs]) if c >= 0.8}
    assert got == brute(docs, items)


def test_short_items_of_tables(spark):
    docs, items = cases()
    docs, items = docs[::7], items[::3]
    rows = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(rows, bench).collect()} == set(range(len(docs))) - {d for d, _ in want}
