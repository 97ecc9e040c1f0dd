"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(threshold_k - w.x) with ordered thresholds and one weight vector for all grades. It is
fitted on at most ``SAMPLE`` labelled documents (those of the lowest hashed ids), on the driver, and then scores
every document in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered_rows, sliced

#: Labelled documents used for fitting, at most.
SAMPLE = 12_000
#: Hashed features. Those get a weight whose share of documents differs between the top grade and another by so many
#: standard errors (that it is no accident) and by so many standard deviations (that it matters, however many the labels).
SIZE, SCREEN, EFFECT = 1 << 20, 4.0, 0.3
#: A document is kept if its probability of the top grade reaches this.
KEEP = 0.5
_WORD = re.compile(r"\w+")
#: Shares that are binned into features: (name, characters).
_SHARES = (("symbols", "#*$%&|<>"), ("shouts", "!?"), ("digits", "0123456789"))


def grades(quality: Column, toxic: Column) -> Column:
    """0: toxic, of whatever quality, 1: poor, 2: good; null where a label is missing.

    The lowest grade is open below: a text may have any number of words that speak for it, while a middle grade is a
    band of scores that such a text would fall through. So the grade that words tell apart comes first.
    """
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic != 0, 0).when(quality == 0, 1).otherwise(2)


def _binned(name: str, share: float) -> str:
    return f"\x00{name}:{min(9, int(share * 20))}"


def features(text: str | None, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Hashed features of a whole text: its distinct words and their beginnings, and binned shares of symbols, capitals and repeats."""
    text = text or ""
    words = _WORD.findall(text.lower())
    kinds = set(words)
    n = len(text) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    shapes = [_binned(k, sum(map(text.count, chars)) * 4 / n) for k, chars in _SHARES]
    shapes += [_binned("kinds", len(kinds) / (len(words) or 1) / 2), _binned("lines", 1 - len(set(lines)) / (len(lines) or 1)), f"\x00length:{len(words).bit_length()}", "\x00bias"]
    shapes.append(_binned("capitals", len(re.findall(r"[A-Z]", text)) / n / 2))
    if len(memo) > 300_000:
        memo.clear()
    out: list[int] = []
    for w in (*kinds, *shapes):
        h = memo.get(w)
        if h is None:
            # a word counts as itself and by its beginnings, which inflected forms share
            h = memo[w] = tuple({zlib.crc32(x.encode("utf-8", "surrogatepass")) % SIZE for x in ((w,) if w[0] == "\x00" else (w, *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) >= k)))})
        out += h
    return np.unique(np.array(out, dtype=np.int32))


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, text: str | None, memo: dict[str, tuple[int, ...]]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.cuts - self.weights[features(text, memo)].sum(dtype=np.float64), -50, 50)))


def screened(rows: list[np.ndarray], y: np.ndarray, n_grades: int) -> np.ndarray:
    """Features whose document share in some grade differs clearly from that in the top grade."""
    top = n_grades - 1
    n = np.bincount(y, minlength=n_grades)
    have = np.zeros((n_grades, SIZE), np.int32)
    for r, g in zip(rows, y.tolist(), strict=True):
        have[g, r] += 1  # a row holds each feature once
    used = np.zeros(SIZE, dtype=bool)
    for g in range(top):
        if n[g] and n[top]:
            both = (have[g] + have[top]) / (n[g] + n[top])
            spread = np.maximum(np.sqrt(both * (1 - both)), 1e-9)
            used |= np.abs(have[g] / n[g] - have[top] / n[top]) > spread * max(EFFECT, SCREEN * math.sqrt(1 / n[g] + 1 / n[top]))
    used[zlib.crc32(b"\x00bias") % SIZE] = True
    return np.flatnonzero(used)


def objective(x: np.ndarray, at: np.ndarray, column: np.ndarray, y: np.ndarray, importance: np.ndarray, n_used: int, n_grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """(penalised negative log-likelihood, its gradient) at x = weights, first threshold, logs of the steps between thresholds.

    Row ``at[i]`` has feature ``column[i]``; P(grade) is the difference of two neighbouring cumulative sigmoids.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    cuts = np.r_[-np.inf, np.cumsum(np.r_[x[n_used], np.exp(x[n_used + 1 :])]), np.inf]
    score = np.bincount(at, x[column], len(y))
    hi, lo = sigmoid(cuts[y + 1] - score), sigmoid(cuts[y] - score)
    hi, lo = np.where(y == n_grades - 1, 1, hi), np.where(y == 0, 0, lo)
    like = np.maximum(hi - lo, 1e-12)
    up, down = hi * (1 - hi) / like, lo * (1 - lo) / like
    d_score = importance * (up - down)
    d_cuts = np.bincount(y, -importance * up, n_grades)[: n_grades - 1] + np.bincount(y, importance * down, n_grades)[1:]
    tail = np.cumsum(d_cuts[::-1])[::-1]
    w = x[:n_used]
    grad = np.r_[np.bincount(column, d_score[at], n_used) + ridge * w, tail[0], tail[1:] * np.exp(x[n_used + 1 :])]
    return float(-(importance * np.log(like)).sum() + ridge / 2 * (w @ w)), grad


def fit(rows: list[np.ndarray], y: np.ndarray, n_grades: int = 3, rounds: int = 150, ridge: float = 2e-4) -> Model:
    """Maximum likelihood by Adam over the whole sample. Grades without a row, or no rows: flat thresholds that keep."""
    cuts0 = np.linspace(-4, -1, n_grades - 1)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(SIZE, np.float32), cuts0)
    used = screened(rows, y, n_grades)
    place = np.full(SIZE, -1)
    place[used] = np.arange(len(used))
    rows = [p[p >= 0] for p in (place[r] for r in rows)]
    at, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    importance = (len(y) / (n_grades * np.maximum(1, np.bincount(y, minlength=n_grades))))[y] ** 0.5
    importance /= importance.sum()
    x = np.r_[np.zeros(len(used)), cuts0[0], np.log(np.diff(cuts0))]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        _, grad = objective(x, at, column, y, importance, len(used), n_grades, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(SIZE, np.float32)
    weights[used] = x[: len(used)]
    return Model(weights, np.cumsum(np.r_[x[len(used)], np.exp(x[len(used) + 1 :])]))


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Model from ``rated`` (doc_id, grade): the ``sample`` lowest hashed ids are looked up in ``docs``.

    Null ids and grades are left out. Of several grades of an id the lowest counts, of several texts the one of least
    features. Empty tables, or ratings of one grade alone, give a model that keeps everything.
    """
    picked = rated.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        for b in sliced(batches):
            rows = [features(t, memo).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], names=["doc_id", "row", "grade"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, row binary, grade int")  # at most ``sample`` ids are broadcast
    # One row of an id, however often it is repeated; so at most ``sample`` rows reach the driver.
    rows = found.groupBy("doc_id").agg(F.min(F.struct("row", "grade")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(r.as_buffer(), np.int32) for r in rows.column("row")], rows.column("grade").to_numpy().astype(np.int64))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(doc_id, expected_grade, p_middle, p_top, kept) of every row: expected grade, P(grade>=1), P(grade>=2), verdict.

    A null text counts as empty and texts of any length are scored whole; repeated rows and null ids are scored like any
    row; other columns, of whatever names, are not read; empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        for b in sliced(batches):
            p = np.array([shared.value.tails(t, memo) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= keep)], names=["doc_id", "expected_grade", "p_middle", "p_top", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_middle double, p_top double, kept boolean")


def select(docs: DataFrame, model: Model, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns unchanged and of any names, without a shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        memo: dict[str, tuple[int, ...]] = {}
        for b in sliced(batches):
            yield b.filter(pa.array([bool(shared.value.tails(t, memo)[-1] >= keep) for t in b.column(at).to_pylist()], pa.bool_()))

    return filtered_rows(docs, run)
