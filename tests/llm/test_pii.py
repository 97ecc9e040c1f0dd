import hashlib
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from colscan.llm.pii import personal_data, redacted, running

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for i, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), i, m.end(), kind))
    out.sort()
    return out


def text_of(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


HARD = [
    "a@b.c_x@d.e f@g", "x.y+z@a-b.co.uk. é a@b..c a@b.c.", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.255 1.2.3", "4111 1111-1111 1111 4111111111111111 4111  111111111111",
    "+1 (578) 555-6437 4918187128635271 ++12345678901 +1234567890123456 +1", "", None, " 41111111 4111 1111 1111 1111", "😀 a@b.cd 😀 +1 234 567 890", "9" * 30000, "1 " * 8000, "a" * 60000, "1." * 9000, "a@" * 5000, "a.b@c.d" * 2000,
]


def test_base(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(HARD)] + [(None, HARD[0], 1, "x"), (0, HARD[0], 1, "x")], "doc_id long, text string, key int, base string")
    got = personal_data(docs).collect()
    assert len(got) == len(HARD) + 2
    for r in got:
        want = brute(HARD[r.doc_id or 0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == i for s in want) for i in range(4)], r.doc_id
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest(), r.doc_id
    assert personal_data(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(text_of(brute(texts[r.doc_id])).encode()).hexdigest()
        assert set(text_of(brute(texts[r.doc_id])).split(",")) <= set(r.spans.split(",")) | {""}


WORD = re.compile(r"\S+")


def context_brute(texts, rounds=3, confident=0.7, support=3):
    """{doc: added spans} by plain loops over tokens, patterns and instances."""
    found, edges, seed_of = [], {}, {}
    for d, text in texts.items():
        spans = brute(text)
        words = [(m.start(), m[0]) for m in WORD.finditer(text or "")]
        nine = lambda w: re.sub("[0-9]+", "9", w.lower())
        for n, (at, w) in enumerate(words):
            if not re.search("[0-9@]", w):
                continue
            lead = re.match(r"(?:[A-Za-z_-]+[=:]+)?(?:[^\w+]|_)*", w)[0]
            trail = re.search(r"(?:[^\w]|_)*$", w)[0]
            body = w[len(lead) : len(w) - len(trail)]
            if not body:
                continue
            a, b = at + len(lead), at + len(w) - len(trail)
            left = [nine(x) for _, x in words[max(0, n - 2) : n]]
            l1, l2, right = (left[-1] if left else ""), (left[-2] if len(left) > 1 else ""), (nine(words[n + 1][1]) if n + 1 < len(words) else "")
            patterns = [f"2 {l2} {l1} {lead.lower()}", f"1 {l1} {lead.lower()} _ {trail[:1]} {right}"]
            seed = next((i for s, i, e, _ in sorted(spans, key=lambda x: x[1]) if 2 * (min(e, b) - max(s, a)) >= b - a), None)
            assigned = re.search(r"(?:secret|passw(?:or)?d|pwd|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*[:=]+\s*[\"']?$", f"{l2} {l1} {lead.lower()}")
            if seed is None and assigned and re.fullmatch(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.~-]{16,}", body):
                seed = 4
            found.append((d, a, b, body, patterns, seed))
            for p in patterns:
                edges[p, body] = edges.get((p, body), 0) + 1
            if seed is not None:
                seed_of[body] = min(seed, seed_of.get(body, 9))
    belief = {(i, k): 1.0 for i, k in seed_of.items()}
    strong = {}
    for _ in range(rounds):
        total, hit, kinds = {}, {}, {}
        for (p, i), n in edges.items():
            total[p] = total.get(p, 0) + n
            for k in range(5):
                if (i, k) in belief:
                    hit[p, k] = hit.get((p, k), 0) + n * belief[i, k]
                    kinds[p, k] = kinds.get((p, k), 0) + (belief[i, k] >= confident)
        strong = {x: round(h / total[x[0]], 9) for x, h in hit.items() if kinds[x] >= support and round(h / total[x[0]], 9) >= confident}
        doubt = {}
        for p, i in edges:
            for k in range(5):
                if (p, k) in strong:
                    doubt[i, k] = doubt.get((i, k), 1.0) * max(1e-9, 1 - strong[p, k])
        belief = {x: round(1 - v, 9) for x, v in doubt.items()} | {(i, k): 1.0 for i, k in seed_of.items()}
    out = {d: set() for d in texts}
    for d, a, b, body, patterns, seed in found:
        if seed == 4:
            out[d].add(f"secret:{a}:{b}")
        best = max(((belief[body, k], -k) for k in range(5) if belief.get((body, k), 0) >= confident), default=None)
        if seed is None and best and any((p, -best[1]) in strong for p in patterns):
            out[d].add(f"{'secret' if best[1] == -4 else 'context_' + list(PATTERNS)[-best[1]]}:{a}:{b}")
    return out


def planted(n=60):
    """Texts with identifiers of five kinds in contexts of their own, some of which no base pattern knows, and decoys."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(3, 7)))
    fill = lambda: " ".join(word() for _ in range(r.randint(3, 12)))
    hex_ = lambda k: "".join(r.choices("0123456789abcdef", k=k - 2)) + "a1"
    texts, hidden = {}, {}
    for i in range(n):
        new = i % 4 == 0
        kind = ("email", "ip", "phone", "secret")[(i // 4) % 4]
        before, known, unseen = {
            "email": ("please write to", f"{word()}.{i}@{word()}.org", f"{word()}.{i}(at){word()}"),
            "ip": ("logged in from", f"{i}.2.3.4", f"{i}.2.3.4:80:x{i}:1"),
            "phone": ("call me under", f"+1234567{i:05d}", f"0049-{i:03d}-555"),
            "secret": ('my token = "', hex_(40), hex_(10)),
        }[kind]
        one = unseen if new else known
        sep = "" if before.endswith('"') else " "
        texts[i] = f"{fill()} {before}{sep}{one}{'' if sep else chr(34)} thanks {fill()}\n{fill()} in 19{i:02d} or room {r.randint(1, 400)}. {fill()}"
        if new:
            at = texts[i].index(one)
            hidden[i] = f"{'secret' if kind == 'secret' else 'context_' + kind}:{at}:{at + len(one)}"
    return texts, hidden


def test_context_finds_planted_identifiers(spark):
    texts, hidden = planted()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(rows).collect()}
    want = context_brute(texts)
    base = {d: {f"{k}:{a}:{b}" for a, _, b, k in brute(t)} for d, t in texts.items()}
    assert {d: set(r.spans.split(",")) - {""} for d, r in got.items()} == {d: base[d] | want[d] for d in texts}
    caught = sum(h in got[d].spans.split(",") for d, h in hidden.items())
    assert caught >= 0.9 * len(hidden)
    assert all(r.n_found == len(set(r.spans.split(",")) - {""}) and r.n_secret + r.n_context == len(want[d]) for d, r in got.items())
    assert not any(s.endswith(f":{t.index(' in 19') + 8}") for d, t in texts.items() for s in got[d].spans.split(","))


def test_context_on_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = context_brute(texts)
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    base = {d: {f"{k}:{a}:{b}" for a, _, b, k in brute(t)} for d, t in texts.items()}
    assert {d: set(r.spans.split(",")) - {""} for d, r in got.items()} == {d: base[d] | want[d] for d in texts}
    assert sum(r.n_secret for r in got.values()) > 5


def test_many_matches_of_one_text(spark):
    texts = {1: " ".join(f"a{i % 7}@b.cd" for i in range(64_000)), 2: " ".join(["x 1.2.3.4 +12 345 6789"] * 5000)}
    began = time.perf_counter()
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 120
    for d, t in texts.items():
        assert got[d].base_sha256 == hashlib.sha256(text_of(brute(t)).encode()).hexdigest()


def test_running_sums(spark):
    r = random.Random(3)
    for n in (1, 63, 64, 65, 4096, 5000):
        lengths = [r.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(lengths,)], "x array<int>").select(running(F.col("x")).alias("y")).first().y
        assert got == [0, *itertools.accumulate(lengths)][:-1]


def test_redacted(spark):
    rows = [(i, f"Please write mailto: user{i}@mail.example.org today, thanks") for i in range(8)] + [(8, "Please write mailto: user8(at)mail today"), (9, "I counted things 12345 of them"), (10, "I counted things 99999 more, things 10.1.1.1 too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    at = rows[8][1].index("user8")
    assert got[8].spans == f"context_email:{at}:{at + len('user8(at)mail')}"
    assert got[9].spans == "" and got[10].n_context == 0
    clean = {r.doc_id: r.text for r in redacted(docs, spark.createDataFrame(list(got.values()))).collect()}
    assert clean[0] == "Please write mailto: [email] today, thanks"
    assert clean[8] == "Please write mailto: [context_email] today" and clean[9] == rows[9][1]
