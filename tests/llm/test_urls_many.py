import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from colscan.llm.urlfilter import BINS, FOLDS, ORDER, RARE, SPAN, TWICE, counted, filtered


def data(url):
    return b"\n" * ORDER + url.encode() + b"\n"


def learn(learned, kind):
    pair = Counter((k, d[i - k : i], d[i]) for u, v in learned if v == kind for d in [data(u)] for i in range(ORDER, len(d)) for k in range(ORDER + 1))
    context, kinds = Counter(), Counter((k, c) for k, c, _ in pair)
    for (k, c, _), n in pair.items():
        context[k, c] += n
    rare = {x for x, n in context.items() if x[0] >= RARE and n < TWICE}
    pair = Counter({x: n for x, n in pair.items() if x[:2] not in rare})
    context, kinds = Counter({x: n for x, n in context.items() if x not in rare}), Counter({x: n for x, n in kinds.items() if x not in rare})
    return pair, context, kinds


def slow(models, url):
    """Mean log-likelihood difference from literal contexts."""
    out, text = 0.0, data(url)
    for sign, (pair, context, kinds) in zip((-1, 1), models, strict=True):
        for i in range(ORDER, len(text)):
            p = 1 / 256
            for k in range(ORDER + 1):
                c = (k, text[i - k : i])
                if context[c]:
                    p = (pair[*c, text[i]] + kinds[c] * p) / (context[c] + kinds[c])
            out += sign * math.log(p)
    return out / (len(text) - ORDER)


def test_contexts_do_not_merge(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60))
    learned = [(word(), r.choice(("allow", "block"))) for _ in range(1500)]
    model = counted(spark.createDataFrame(learned, "url string, by_rule string"), "url")
    urls = [word() for _ in range(30)] + [u for u, _ in learned[:10]]
    models = [learn(learned, kind) for kind in ("block", "allow")]
    for got, u in zip(model.scores(urls), urls, strict=True):
        assert abs(got - slow(models, u)) < 1e-9


def test_verdicts_against_slow_models(spark):
    """Models from four fifths of the judged urls, cut from the fifth, verdicts of all: all recomputed with plain loops."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    extra = spark.createDataFrame([(10_000 + i, f"https://site{i % 9}.org/{'x' * (i % 5)}/{i}") for i in range(40)], "page_id long, url string")
    pages = pages.select("page_id", "url").unionByName(extra)
    got = {r.page_id: r for r in filtered(pages).collect()}
    rows = pages.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).collect()
    bare = lambda u: re.sub(r"^[a-z]+://", "", (u or "").lower())
    judged = {r.page_id: got[r.page_id].verdict for r in rows if got[r.page_id].rule}
    learned = [(bare(r.url), judged[r.page_id]) for r in rows if r.page_id in judged and not r.held]
    models = [learn(learned, kind) for kind in ("block", "allow")]
    score = {r.page_id: slow(models, bare(r.url)) for r in rows}
    tally = np.zeros((2, BINS))
    for r in rows:
        if r.page_id in judged and r.held:
            tally[int(judged[r.page_id] == "allow"), max(0, min(BINS - 1, math.floor((score[r.page_id] / (2 * SPAN) + 0.5) * BINS)))] += 1
    assert tally.sum(axis=1).all()
    best = max(range(BINS), key=lambda n: (round(tally[1, n:].sum() / tally[1].sum() - tally[0, n:].sum() / tally[0].sum(), 12), -n))
    cut = (best / BINS - 0.5) * 2 * SPAN
    free = [r for r in rows if r.page_id not in judged]
    assert len(free) > 30
    for r in free:
        assert abs(got[r.page_id].score - score[r.page_id]) < 2e-6
        if abs(score[r.page_id] - cut) > 1e-6:
            assert got[r.page_id].verdict == ("allow" if score[r.page_id] >= cut else "block")
