"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of n-grams are scaled by the log ratio of their counts in the two classes, and a linear model
with hinge loss is fitted to the scaled indicators by dual coordinate descent.  The n-grams are those of
bytes (1 to 4) and of word shapes (1 to 3; a shape says how a word is written and whether it repeats the
word before), hashed to a fixed number of buckets.  A logistic curve, fitted on labelled rows that the
linear fit left out, turns margins into scores.

The fit reads at most ``TRAIN_ROWS`` labelled rows (a documented bound); scoring reads every whole text.
Null and empty texts have no n-grams and get the score of margin 0 plus the curve's offset.  Without
labels of both classes every score is the share of label 1, or 0.5 without labels.  Repeated rows are
scored alike; extra columns are kept (``score`` is replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import chunks
from .hashing import SPACES, Spans, mix
from .labelled import held_out, sample_features, scored
from .registry import query

BITS = 18
TRAIN_ROWS = 4000
FOLD = (4, 2)
THRESHOLD = 0.7
EPOCHS, COST, SMOOTHING = 12, 1.0, 1.0

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, dtype=np.int64)
_LOWER[97:123] = 1
_LOWER[128:] = 1
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def _running(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(table[data])))


def _word_shapes(spans: Spans) -> np.ndarray:
    """A small code per word: letter case, digits, its end, its length, and repetition."""
    start, end, data = spans.start, spans.end, spans.bytes
    n = end - start
    upper, lower, digit = (
        (lambda c: c[end] - c[start])(_running(t, data)) for t in (_UPPER, _LOWER, _DIGIT))
    marks = n - upper - lower - digit
    words = spans.words()
    repeats = np.zeros(len(n), dtype=np.int64)
    repeats[1:] = (words[1:] == words[:-1]) & (spans.text[1:] == spans.text[:-1])
    case = np.where(upper == 0, 0, np.where((lower == 0) & (upper > 1), 2, 1))
    last = data[end - 1].astype(np.int64) if len(n) else n
    last = np.where(_LOWER[last] + _UPPER[last] + _DIGIT[last] > 0, 0, last)
    code = case * 4 + np.minimum(digit, 1) * 2 + repeats
    code = (code * 4 + np.minimum(marks, 3)) * 256 + last
    return mix((code * 4 + np.minimum(n // 4, 3)).astype(np.uint64) + np.uint64(1 << 40))


def ngram_buckets(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """Per text, the distinct buckets of its n-grams."""
    out, shift = [], np.uint64(64 - bits)
    seen = np.zeros(1 << bits, dtype=np.int64)
    for lo, hi in chunks(texts):
        spans = Spans(texts[lo:hi], fold=None, separators=SPACES)
        n = len(spans.bytes)
        grams = []
        for k in (1, 2, 3, 4):
            at = np.arange(max(0, n - k))
            grams.append((spans.span(at, at + k) >> shift).astype(np.int64))
        shapes = _word_shapes(spans)
        runs = [(shapes >> shift).astype(np.int64)]
        for k in (2, 3):
            joined = sum((shapes[j:len(shapes) - k + 1 + j] * np.uint64(2 * j + 3 + 16 * k)
                          for j in range(k)), np.uint64(0)) if len(shapes) >= k else shapes[:0]
            runs.append((mix(joined) >> shift).astype(np.int64))
        for i in range(hi - lo):
            a, b = spans.text_start[i], spans.text_start[i + 1] - 1
            w, v = spans.first[i], spans.first[i + 1]
            found = np.concatenate([g[a:max(a, b - k)] for k, g in enumerate(grams)]
                                   + [g[w:max(w, v - k)] for k, g in enumerate(runs)])
            seen[found] = np.arange(len(found))  # the last of equal buckets stands for all
            out.append(found[seen[found] == np.arange(len(found))])
    return out


@dataclass(frozen=True)
class NaiveBayesSvm:
    ratio: np.ndarray  # log count ratio per bucket
    weight: np.ndarray  # of a present bucket: linear weight times ratio
    slope: float
    offset: float

    def margins(self, buckets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(buckets))
        for i, f in enumerate(buckets):
            if len(f):
                r = self.ratio[f]
                out[i] = self.weight[f].sum() / max(float(np.sqrt(r @ r)), 1e-9)
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        z = self.slope * self.margins(ngram_buckets(texts)) + self.offset
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def _dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Hinge loss with L2 penalty: one dual variable per row, each visit solves for it exactly."""
    weight, alpha = np.zeros(len(ratio)), np.zeros(len(rows))
    norms = [max(float(np.sqrt((ratio[f] ** 2).sum())), 1e-9) for f in rows]
    cost = np.where(y > 0, COST, COST * max(1.0, (y > 0).sum() / max(1, (y < 0).sum())) ** 0.5)
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, norm = rows[i], norms[i]
            gradient = y[i] * weight[f].sum() / norm - 1
            new = min(max(alpha[i] - gradient, 0.0), cost[i])  # rows have unit length
            if new != alpha[i]:
                weight[f] += (new - alpha[i]) * y[i] / norm * ratio[f] ** 2
                alpha[i] = new
    return weight


def _logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-6
        grad = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()],
                         [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(labels: list[int], rows: list[np.ndarray], bits: int = BITS) -> NaiveBayesSvm:
    """Every fifth row fits the logistic curve, the rest the ratios and the linear model."""
    y = np.where(np.array(labels, dtype=int) == 1, 1, -1)
    if not len(y) or abs(y.sum()) == len(y):
        share = (y > 0).mean() if len(y) else 0.5
        share = min(max(float(share), 1e-3), 1 - 1e-3)
        zero = np.zeros(1 << bits)
        return NaiveBayesSvm(zero, zero, 0.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), dtype=bool)
    used = [i for i in range(len(y)) if not apart[i]]
    counts = {s: np.full(1 << bits, SMOOTHING) for s in (1, -1)}
    for i in used:
        counts[y[i]][rows[i]] += 1
    classes = {s: (y[used] == s).sum() + 2 * SMOOTHING for s in (1, -1)}
    ratio = np.log(counts[1] / classes[1]) - np.log(counts[-1] / classes[-1])
    weight = _dual_descent([rows[i] for i in used], y[used], ratio)
    model = NaiveBayesSvm(ratio.astype(np.float32), weight.astype(np.float32), 1.0, 0.0)
    check = np.flatnonzero(apart) if apart.any() else np.arange(len(y))
    a, b = _logistic_curve(model.margins([rows[i] for i in check]), y[check])
    return NaiveBayesSvm(model.ratio, model.weight, a, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          fold: tuple[int, int] = FOLD, rows: int = TRAIN_ROWS) -> NaiveBayesSvm:
    def features(texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        return [(np.sort(f).astype(np.int32).tobytes(), b"") for f in ngram_buckets(texts)]

    found = sample_features(docs, labels, label, fold, rows, features)
    return fit([r[0] for r in found], [np.frombuffer(r[1], dtype=np.int32) for r in found])


def score_quality(docs: DataFrame, model: NaiveBayesSvm, name: str = "score") -> DataFrame:
    """Append ``score`` (0 to 1, high for good documents) to every row."""
    return scored(docs, model.scores, name)


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score_quality(docs, model).selectExpr(
        "doc_id", f"{held_out(*FOLD)} held_out", "score", f"cast(score >= {THRESHOLD} as int) predicted")
