"""Toxicity: a logistic classifier whose score may not change when identity terms are swapped.

Features are indicators of words and of word beginnings (4 to 6 bytes), lower-case, from a vocabulary that
the labelled rows choose.  For every labelled sentence that names a group, a counterfactual sentence names
another group of the same kind, and the squared change of the linear score between the two is added to the
loss.  So the weight that a group's name would get from unlucky labels is taken from it, and neutral
mentions are left alone.

The fit reads at most ``TRAIN_ROWS`` labelled rows (a documented bound); scoring reads every whole text.
Null and empty texts have no features and get the score of the intercept.  Without labels of both classes
every score is the share of label 1, or 0 without labels of class 1.  Repeated rows are scored alike; extra
columns are kept (``score`` is replaced).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import chunks
from .hashing import LOWER, Spans, byte_set, mix
from .labelled import held_out, sample_features, scored
from .registry import query

TRAIN_ROWS = 10_000
FOLD = (5, 0)
THRESHOLD = 0.5
SLOTS_BITS = 20        # slots of the vocabulary table
LEAST_DOCUMENTS = 3    # of the sample that hold a vocabulary feature
LEAST_EVIDENCE = 3.0   # standard deviations between a feature's label share and the sample's
SWAP_PENALTY = 4.0
RIDGE = 2e-4
STEPS = 160

# Names of groups by kind, of which one stands in for another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous", "roma"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("african", "american", "european", "mexican", "chinese", "arab", "indian"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
)
_KIND = {t.encode(): (k, i) for k, kind in enumerate(IDENTITY_TERMS) for i, t in enumerate(kind)}
_TERM = re.compile(rb"(?<![a-z\x80-\xff])(" + b"|".join(sorted(_KIND, key=len, reverse=True))
                   + rb")(?![a-z\x80-\xff])")
_SENTENCE = re.compile(rb"[^.!?\n]+")
_BREAKS = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))
_BEGINNINGS = (4, 5, 6)


def word_features(texts: list[bytes]) -> list[np.ndarray]:
    """Per text, the hashes of its words and of their beginnings (with repeats)."""
    out = []
    for lo, hi in chunks(texts):
        spans = Spans(texts[lo:hi], fold=LOWER, separators=_BREAKS)
        parts, owners = [spans.words()], [spans.text]
        for n in _BEGINNINGS:
            longer = np.flatnonzero(spans.end - spans.start > n)
            start = spans.start[longer]
            parts.append(mix(spans.span(start, start + n) + np.uint64(n)))
            owners.append(spans.text[longer])
        edges = [np.searchsorted(o, np.arange(hi - lo + 1)) for o in owners]
        for i in range(hi - lo):
            out.append(np.concatenate([p[e[i]:e[i + 1]] for p, e in zip(parts, edges)]))
    return out


def swapped(sentence: bytes) -> bytes:
    """The sentence with every group name replaced by another of its kind (lower-case in and out)."""
    def other(match: re.Match) -> bytes:
        kind, i = _KIND[match[1]]
        names = IDENTITY_TERMS[kind]
        step = 1 + (len(sentence) + match.start()) % (len(names) - 1)
        return names[(i + step) % len(names)].encode()
    return _TERM.sub(other, sentence)


@dataclass(frozen=True)
class ToxicityModel:
    keys: np.ndarray    # hash that owns a slot
    weight: np.ndarray  # its weight
    intercept: float

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The distinct slots of the hashes that are in the vocabulary."""
        slot = (hashes >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        return np.unique(slot[self.keys[slot] == hashes])

    def scores(self, texts: list[bytes]) -> list[float]:
        z = np.array([self.weight[self.slots(h)].sum() for h in word_features(texts)]) + self.intercept
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def _constant(share: float) -> ToxicityModel:
    share = min(max(share, 1e-3), 1 - 1e-3)
    size = 1 << SLOTS_BITS
    return ToxicityModel(np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.float32),
                         float(np.log(share / (1 - share))))


def _vocabulary(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and evidence per slot: of the features that enough documents hold, the best ones.

    Evidence scales an indicator, so the ridge falls on doubtful features most.
    """
    share = y.mean()
    found = []
    for part in range(16):  # a sixteenth of the hash range at a time bounds the memory
        low, high = np.uint64(part << 60), np.uint64((part + 1 << 60) - 1)
        cuts = [r[np.searchsorted(r, low):np.searchsorted(r, high, side="right")] for r in rows]
        none = np.zeros(0, dtype=np.uint64)
        keys, n = np.unique(np.concatenate([none, *cuts]), return_counts=True)
        keys, n = keys[n >= LEAST_DOCUMENTS], n[n >= LEAST_DOCUMENTS]
        toxic, times = np.unique(np.concatenate([none, *[c for c, v in zip(cuts, y) if v == 1]]),
                                 return_counts=True)
        n1 = np.zeros(len(keys))
        if len(toxic):
            at = np.minimum(np.searchsorted(toxic, keys), len(toxic) - 1)
            n1 = np.where(toxic[at] == keys, times[at], 0).astype(float)
        found.append((keys, n, n1))
    keys, n, n1 = (np.concatenate(c) for c in zip(*found))
    z = (n1 - n * share) / np.sqrt(n * share * (1 - share) + 1)
    kept = np.flatnonzero(np.abs(z) > LEAST_EVIDENCE)
    kept = kept[np.argsort(np.abs(z[kept]), kind="stable")]  # the best is written last into a shared slot
    table = np.zeros(1 << SLOTS_BITS, dtype=np.uint64)
    slot = (keys[kept] >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
    table[slot] = keys[kept]
    evidence = np.zeros(1 << SLOTS_BITS)
    evidence[slot] = np.minimum(np.abs(z[kept]), 20.0) / 10.0
    return table, evidence


class _Sparse:
    """Rows of indicator features as flat arrays."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.n = len(rows)
        self.column = np.concatenate([np.zeros(0, dtype=np.int64), *rows])
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.value = np.ones(len(self.column)) if values is None else np.concatenate(
            [np.zeros(0), *values])

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weight[self.column] * self.value, minlength=self.n)

    def back(self, residual: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, weights=residual[self.row] * self.value, minlength=width)


def fit(labels: list[int], rows: list[np.ndarray],
        pairs: list[tuple[np.ndarray, np.ndarray]]) -> ToxicityModel:
    """Logistic loss + ridge + penalty on the score change of every swapped sentence, by Adam steps."""
    y = np.array(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.0)
    rows = [r if (r[1:] > r[:-1]).all() else np.unique(r) for r in rows]
    table, evidence = _vocabulary(rows, y)
    model = ToxicityModel(table, np.zeros(0, dtype=np.float32), 0.0)
    used = [model.slots(r) for r in rows]
    columns = np.unique(np.concatenate(used)) if used else np.zeros(0, dtype=np.int64)
    where = np.zeros(1 << SLOTS_BITS, dtype=np.int64)
    where[columns] = np.arange(len(columns))
    x = _Sparse([where[u] for u in used], [evidence[u] for u in used])
    changes, signs = [], []
    for a, b in pairs:
        a, b = model.slots(a), model.slots(b)
        only_a, only_b = np.setdiff1d(a, b), np.setdiff1d(b, a)
        both = np.concatenate([only_a, only_b])
        known = np.isin(both, columns)
        sign = np.concatenate([np.ones(len(only_a)), -np.ones(len(only_b))])
        changes.append(where[both[known]])
        signs.append(sign[known] * evidence[both[known]])
    swaps = _Sparse(changes, signs)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    w, c = np.zeros(len(columns)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + c, -30, 30)))
        error = balance * (p - y) / len(y)
        g, gc = x.back(error, len(w)) + RIDGE * w, error.sum()
        if swaps.n:
            g += 2 * SWAP_PENALTY / swaps.n * swaps.back(swaps.dot(w), len(w))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mc, vc = 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
        rate = 0.1 * (1 - step / (STEPS + 1))
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        c -= rate * (mc / (1 - 0.9 ** step)) / ((vc / (1 - 0.99 ** step)) ** 0.5 + 1e-6)
    weight = np.zeros(1 << SLOTS_BITS, dtype=np.float32)
    weight[columns] = w * evidence[columns]
    return ToxicityModel(model.keys, weight, float(c))


def _pack(arrays: list[np.ndarray]) -> bytes:
    lengths = np.array([len(arrays), *map(len, arrays)], dtype=np.uint64)
    return np.concatenate([lengths, *arrays]).tobytes()


def _unpack(data: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(data, dtype=np.uint64)
    n = int(flat[0])
    return np.split(flat[1 + n:], np.cumsum(flat[1:1 + n].astype(np.int64))[:-1]) if n else []


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic",
          fold: tuple[int, int] = FOLD, rows: int = TRAIN_ROWS) -> ToxicityModel:
    def features(texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        out = []
        for text, own in zip(texts, word_features(texts)):
            sentences = [s for s in _SENTENCE.findall(text.translate(LOWER)) if _TERM.search(s)]
            changed = word_features([t for s in sentences for t in (s, swapped(s))])
            out.append((np.unique(own).tobytes(), _pack(changed)))
        return out

    found = sample_features(docs, labels, label, fold, rows, features)
    pairs = []
    for _, _, more in found:
        changed = _unpack(more)
        pairs += list(zip(changed[0::2], changed[1::2]))
    return fit([r[0] for r in found], [np.frombuffer(r[1], dtype=np.uint64) for r in found], pairs)


def score_toxicity(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """Append ``score`` (0 to 1, high for toxic documents) to every row."""
    return scored(docs, model.scores, name)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score_toxicity(docs, model).selectExpr(
        "doc_id", f"{held_out(*FOLD)} held_out", "score", f"cast(score >= {THRESHOLD} as int) predicted")
