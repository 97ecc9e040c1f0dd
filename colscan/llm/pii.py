"""Personal data: patterns of four kinds, and bootstrapped contextual extraction of identifiers they miss.

All of it is DataFrame functions. Seeds are the spans of the four kinds, and secrets: long tokens of letters and digits
that are assigned to a name such as ``token`` or ``password``. A lexical pattern is what stands around an identifier-like
token: the two words before it, or the word before and the word after it, each with the token's own punctuation. Patterns
and instances (the tokens) form a bipartite graph. For each kind, a pattern's confidence is the share of its occurrences
whose instance is believed to be of the kind, an instance's is 1 - prod(1 - confidence of its patterns); seeds are
believed. After ``ROUNDS`` rounds, tokens in believed contexts that no base span covers are reported under their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_all, quoted, staged, text_of

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
#: Kinds in the order of spans at one place: the base ones, secrets, and what context has found of each base kind.
ALL_KINDS = (*KINDS, "secret", *(f"context_{k}" for k in KINDS))
#: Rounds of scoring; confidence from which patterns and instances count; different instances a pattern needs.
ROUNDS, CONFIDENT, SUPPORT = 3, 0.7, 3
#: Stands for a separator between two digits; parts matches and gaps; and stands for both where a text has them.
MARK, PART, OTHER = "\ue000", "\ue002", "\ue001"
#: Code points on either side of a token that its context is taken from; a longer word counts by its near end.
NEAR = 200
#: Lengths in a block of running sums.
BLOCK = 64
#: Code points of a bucket in which tokens meet base spans.
BUCKET = 64
# A run of a class can only match from its first character or where the last match ended (\G), so the run is never
# tried again from within, and possessive quantifiers keep the cost linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = f"[0-9][0-9{MARK}]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What a token has before its body (a name and sign of assignment, punctuation) and after it.
LEAD, TRAIL = r"^(?:[A-Za-z_-]+[=:]+)?[^\p{L}\p{N}+]*", r"[^\p{L}\p{N}]+$"
#: Words before a token, and its lead, that assign a secret.
ASSIGNED = r"(?:secret|passw(?:or)?d|pwd|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*[:=]+\s*[\"']?$"


def running(lengths: Column, levels: int = 3) -> Column:
    """The sum of the lengths before each one. Sums are taken in blocks, then over blocks, so the cost stays near linear."""
    inner = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    if levels == 1:
        return inner(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, running(sums, levels - 1), lambda block, base: F.transform(inner(block), lambda x: x + base)))


def parted(text: Column, pattern: str, condition: Column) -> Column:
    """Gap, match, gap, match, ..., gap for the leftmost, non-overlapping matches; an empty array where a cheap condition fails."""
    return F.when(condition, F.split(F.regexp_replace(text, f"({pattern})", f"{PART}$1{PART}"), PART, -1)).otherwise(F.array().cast("array<string>"))


def matches(parts: str, starts: str, more=lambda i: ()) -> Column:
    """[(start, stop, s, ...)] of the matches among ``parts``, in code points, end exclusive."""
    at = F.when(F.size(parts) >= 3, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(F.get(parts, i))).cast("int").alias("stop"), F.get(parts, i).alias("s"), *more(i)))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i))) % 10 == 0


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, a number of its own, raw matches of each kind, tokens in context."""
    # The markers are replaced by a third character of the same length, which no pattern matches.
    text = F.translate(text_of(text_col), MARK + PART, OTHER * 2)
    marked = F.regexp_replace("text", "(?<=[0-9])[ -](?=[0-9])", MARK)
    out = docs.select(quoted(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    out = out.select(
        "doc_id",
        "row",
        parted(F.col("text"), EMAIL, F.contains("text", F.lit("@"))).alias("email"),
        parted(F.col("text"), IP, F.col("text").rlike(r"[0-9]\.[0-9]")).alias("ip"),
        parted(marked, CARD, F.col("text").rlike(r"[0-9](?:[ -]?[0-9]){11}")).alias("card"),
        parted(F.col("text"), PHONE, F.contains("text", F.lit("+"))).alias("phone"),
        parted(F.col("text"), TOKEN, F.col("text").rlike("[0-9@]")).alias("token"),
    )
    names = (*KINDS, "token")
    out = out.withColumns({f"{k}_at": F.transform(k, lambda x: F.length(x)) for k in names})
    out = out.withColumns({f"{k}_at": F.when(F.size(k) > 0, running(F.col(f"{k}_at"))).otherwise(F.array().cast("array<int>")) for k in names})
    text_at = lambda i: F.coalesce(F.get("token", i), F.lit(""))
    before = lambda i: F.substring(F.concat(text_at(i - 2), text_at(i - 1)), -NEAR, NEAR)
    after = lambda i: F.substring(F.concat(F.substring(text_at(i + 1), 1, NEAR), text_at(i + 2)), 1, NEAR)
    found = {k: matches(k, f"{k}_at") for k in KINDS} | {"token": matches("token", "token_at", lambda i: (before(i).alias("before"), after(i).alias("after")))}
    return out.select("doc_id", "row", *[v.alias(k) for k, v in found.items()])


def base_spans(raw: DataFrame) -> DataFrame:
    """The matches of each kind that hold, as arrays, and the tokens: their place, instance, patterns, and whether they are secrets."""
    size = lambda x: F.length(digits(x["s"]))
    holds = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["s"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda x: (F.length(x["s"]) >= 12) & size(x).between(12, 19) & luhn(digits(x["s"])),
        "phone": lambda x: size(x).between(9, 15),
    }
    out = raw.withColumns({k: F.filter(k, f) for k, f in holds.items()})
    named = lambda k, i: F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("i"), x["stop"].alias("stop")))
    shown = F.concat(*[named(k, i) for i, k in enumerate(KINDS)])
    words = lambda s: F.split(F.regexp_replace(F.lower(F.trim(F.regexp_replace(s, r"\s+", " "))), "[0-9]+", "9"), " ")
    out = out.withColumn("token", F.transform("token", lambda x: x.withField("lead", F.regexp_extract(x["s"], LEAD, 0)).withField("trail", F.regexp_extract(x["s"], TRAIL, 0)).withField("left", words(x["before"])).withField("right", words(x["after"]))))
    edge = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    body = lambda x: F.substring(x["s"], F.length(x["lead"]) + 1, F.length(x["s"]) - F.length(x["lead"]) - F.length(x["trail"]))
    mark = lambda x: F.lower(x["lead"])
    patterns = lambda x: F.array(F.concat(F.lit("2 "), edge(x["left"], -2), F.lit(" "), edge(x["left"], -1), F.lit(" "), mark(x)), F.concat(F.lit("1 "), edge(x["left"], -1), F.lit(" "), mark(x), F.lit(" _ "), F.substring(x["trail"], 1, 1), F.lit(" "), edge(x["right"], 1)))
    assigned = lambda x: F.concat(edge(x["left"], -2), F.lit(" "), edge(x["left"], -1), F.lit(" "), mark(x)).rlike(ASSIGNED) & body(x).rlike(r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_.~-]{16,}$")
    tokens = F.transform("token", lambda x: F.struct((x["start"] + F.length(x["lead"])).alias("start"), (x["stop"] - F.length(x["trail"])).alias("stop"), body(x).alias("instance"), patterns(x).alias("patterns"), assigned(x).alias("secret")))
    return out.select("doc_id", "row", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(shown).alias("base"), F.filter(tokens, lambda t: t["stop"] > t["start"]).alias("token"))


def occurrences(rows: DataFrame) -> DataFrame:
    """Every token as (row, start, stop, instance, patterns, seed): the base kind that covers half of it or more, else secret or null."""
    tokens = rows.select("row", F.explode("token").alias("t")).select("row", "t.*")
    spans = rows.select("row", F.explode("base").alias("b")).select("row", F.col("b.i").alias("i"), F.col("b.start").alias("b0"), F.col("b.stop").alias("b1"))
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor((F.col(b) - 1) / BUCKET))).alias("bucket")
    both = tokens.select("row", "start", "stop", bucket("start", "stop")).join(spans.select("*", bucket("b0", "b1")), ["row", "bucket"])
    common = F.least("stop", "b1") - F.greatest("start", "b0")
    covered = both.where(2 * common >= F.col("stop") - F.col("start")).groupBy("row", "start").agg(F.min("i").alias("seed"))
    return tokens.join(covered, ["row", "start"], "left").withColumn("seed", F.coalesce("seed", F.when(F.col("secret"), F.lit(SECRET)))).drop("secret")


def believed(tokens: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, instance, kind) that are to be reported, from occurrences (pattern, instance, seed); instances by their hash.

    Occurrences are summed to edges of the graph before anything is joined, so a frequent word is one row for each
    instance; patterns that are not confident drop out before instances are scored. Confidences are rounded to nine
    places, so that the order of a sum decides nothing. An instance that is a seed of several kinds counts as the
    first of them.
    """
    edges = staged(tokens.groupBy("pattern", F.xxhash64("instance").alias("instance")).agg(F.count("*").alias("n"), F.min("seed").alias("seed")))
    seeds = edges.where("seed is not null").groupBy("instance").agg(F.min("seed").alias("kind")).withColumn("belief", F.lit(1.0))
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    belief, temporary = seeds, []
    for _ in range(rounds):
        scored = edges.join(belief, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("hit"), F.count_if(F.col("belief") >= CONFIDENT).alias("support"))
        scored = scored.where(F.col("support") >= SUPPORT).join(totals, "pattern").select("pattern", "kind", F.round(F.col("hit") / F.col("total"), 9).alias("confidence"))
        strong = staged(scored.where(F.col("confidence") >= CONFIDENT))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        learnt = edges.join(strong, "pattern").groupBy("instance", "kind").agg(F.round(1 - doubt, 9).alias("belief"))
        belief = staged(learnt.unionByName(seeds.select("instance", "kind", "belief")).groupBy("instance", "kind").agg(F.max("belief").alias("belief")))
        temporary += [strong, belief]
    best = belief.where(F.col("belief") >= CONFIDENT).groupBy("instance").agg(F.max_by("kind", F.struct("belief", -F.col("kind"))).alias("kind"))
    out = staged(edges.join(strong, "pattern").join(best, ["instance", "kind"]).select("pattern", "instance", "kind").distinct())
    drop_all([*temporary, edges])
    return out


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, ALL_KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["i"]), x["start"].cast("string"), x["stop"].cast("string"))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_context, n_found) of every row.

    The four counts and the hash are of the base kinds; ``spans`` also has the secrets and what context has found, of
    kinds ``secret`` and ``context_<kind>``, after the base kinds at equal starts; n_found counts all of them. A null
    text is empty; texts of any length are taken whole, at a cost near linear in their matches. Every row is judged for
    itself, so repeated rows and rows of one id each have their own result. Other columns, of whatever names, are not
    read. Empty tables give no rows.
    """
    raw = staged(candidates(docs, id_col, text_col))
    rows = staged(base_spans(raw))
    tokens = staged(occurrences(rows))
    drop_all([raw])
    pairs = believed(tokens.select(F.explode("patterns").alias("pattern"), "instance", "seed"), rounds)
    fresh = tokens.where("seed is null").select("row", "start", "stop", F.xxhash64("instance").alias("instance"), F.explode("patterns").alias("pattern"))
    fresh = fresh.join(pairs, ["pattern", "instance"]).select("row", "start", "stop", F.when(F.col("kind") == SECRET, SECRET).otherwise(F.col("kind") + SECRET + 1).alias("i"))
    secrets = tokens.where(f"seed = {SECRET}").select("row", "start", "stop", F.lit(SECRET).alias("i"))
    more = secrets.unionByName(fresh).groupBy(F.col("row").alias("of")).agg(F.collect_set(F.struct("start", "i", "stop")).alias("more"))
    out = rows.select("doc_id", "row", *[f"n_{k}" for k in KINDS], "base").join(more, F.col("row") == F.col("of"), "left")
    out = out.withColumn("more", F.coalesce("more", F.array().cast("array<struct<start:int,i:int,stop:int>>")))
    n_secret = F.size(F.filter("more", lambda x: x["i"] == SECRET)).cast("long")
    n_more = F.size("more").cast("long")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), n_secret.alias("n_secret"), (n_more - n_secret).alias("n_context"), (F.size("base") + n_more).cast("long").alias("n_found"))


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; ids must be unique."""
    found_ = spans.select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    parts = F.filter(F.split("__spans", ","), lambda s: s != "")
    text = text_of(text_col)

    def step(a: Column, s: Column) -> Column:
        f = F.split(s, ":")
        start, stop = f[1].cast("int"), f[2].cast("int")
        inside = start < a["pos"]
        piece = F.concat(a["out"], F.substring(text, a["pos"] + 1, start - a["pos"]), F.lit("["), f[0], F.lit("]"))
        return F.struct(F.greatest(a["pos"], stop).alias("pos"), F.when(inside, a["out"]).otherwise(piece).alias("out"))

    whole = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    out = docs.join(found_, docs[id_col] == F.col("__id"), "left")
    return out.withColumn(text_col, F.when(F.coalesce(F.col("__spans"), F.lit("")) == "", F.col(text_col)).otherwise(whole)).select(*docs.columns)
