"""Periodic runs of words, found by recompression.

A run is a maximal stretch of words with smallest period q and at least max(``least``, 2 q) words.  For every
period p the words at the points of a grid, whose width grows with p, are compared with those p further on
(a harmonic sum of points: n log n for n words); every run holds such a point with ``LOOK`` equal words.
Texts with points left are compressed into a run-length grammar together, and its extension queries give the
exact edges around each point.  Stretches that several periods find keep the smallest one.

Every text is one task's work, whole: nothing is shuffled and no other row is read, so hot keys, copies and
ties need no care.  Words are compared as bytes, never by hash.  Null, empty and word-less texts have no runs
and collapse to the empty string; repeated rows get equal results; empty tables give empty results.  Memory
is bounded by ``CHUNK`` words, or by the longest text, and by ``POINTS`` grid points.  Extra columns are kept
(``n_words runs collapsed`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import WORD, small_batches
from .recompression import Grammar
from .registry import query

LEAST = 12        # words of a run
LOOK = 4          # equal words at a grid point
CHUNK = 1 << 17   # words searched at once
POINTS = 1 << 20  # grid points looked at at once
_WORD = WORD.replace("\\", "\\\\")  # as a SQL literal
RUN = "start bigint, length bigint, period bigint"


def _shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """A name per place for the k (a power of 2) symbols from there on; names of the last places mean nothing."""
    names = ids
    width = 1
    while width < k:
        ahead = np.zeros_like(names)
        ahead[:-width] = names[width:]
        _, names = np.unique(names * (int(names.max(initial=0)) + 1) + ahead, return_inverse=True)
        width *= 2
    return names


def _grid(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid points of a text of n words, at most about ``POINTS`` at once.

    A run of period p has at least max(p, least - p) consecutive places equal to the one p further on, so
    LOOK - 1 fewer places start LOOK of them: the width of the grid.
    """
    period = np.arange(1, n // 2 + 1)
    width = np.maximum(period, least - period) - LOOK + 1
    count = np.maximum(0, (n - period - LOOK) // width + 1)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(period):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + POINTS, side="right")))
        c = count[lo:hi]
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield nth * np.repeat(width[lo:hi], c), np.repeat(period[lo:hi], c)
        lo = hi


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Per text (array of word numbers) its runs as rows (start, length, period), by start, then period."""
    if least < 2 * LOOK + 1:
        raise ValueError(f"runs of fewer than {2 * LOOK + 1} words have no grid")
    out = [np.zeros((0, 3), dtype=np.int64) for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)])
    if not base[-1]:
        return out
    names = _shingles(np.concatenate(texts).astype(np.int64), LOOK)

    def hits(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = names[base[k]:base[k + 1]]
        for place, period in _grid(len(own), least):
            hit = np.flatnonzero(own[place] == own[place + period])
            if len(hit):
                yield place[hit], period[hit]

    used = [k for k in np.flatnonzero(lengths >= least).tolist() if next(hits(k), None) is not None]
    if not used:
        return out
    grammar = Grammar([texts[k].astype(np.int64) for k in used])
    found: dict[int, list[np.ndarray]] = {k: [] for k in used}

    def extend(asked: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Exact edges around grid points of several texts (number, place in the grammar, points, periods)."""
        at = np.concatenate([first + place for _, first, place, _ in asked])
        p = np.concatenate([period for *_, period in asked])
        start = grammar.mismatch(at, at + p, -1) + 1
        length = grammar.mismatch(at, at + p, 1) + p - start
        run = length >= np.maximum(least, 2 * p)
        end = np.cumsum([len(place) for _, _, place, _ in asked])
        for (k, first, place, _), b in zip(asked, end.tolist()):
            own = slice(b - len(place), b)
            rows = np.stack([start[own] - first, length[own], p[own]], axis=1)[run[own]]
            found[k] = [_smallest_periods(np.concatenate([*found[k], rows]))]  # so that it never outgrows the text

    waiting, size = [], 0
    for k, first in zip(used, grammar.place.tolist()):
        for place, period in hits(k):
            for lo in range(0, len(place), POINTS):
                waiting.append((k, first, place[lo:lo + POINTS], period[lo:lo + POINTS]))
                size += len(waiting[-1][2])
                if size >= POINTS:
                    extend(waiting)
                    waiting, size = [], 0
    if waiting:
        extend(waiting)
    for k, (rows,) in found.items():
        out[k] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) of equal stretches, the one with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run is cut down to its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def detect_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows of ``docs(text, …)`` with n_words, runs (array of start, length, period) and collapsed (the text
    without the words that repeat the first period of a run, joined by one space)."""
    small_batches(docs.sparkSession)
    added = T.StructType.fromDDL(f"n_words bigint, runs array<struct<{RUN.replace(' bigint', ': bigint')}>>, "
                                 "collapsed string")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added.names]
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("text").alias("whole"))
    schema = T.StructType([rows.schema["kept"], *added.fields])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def results(texts: list[list[bytes]]) -> Iterator[tuple[int, list[dict], str]]:
        ids: dict[bytes, int] = {}
        numbers = [np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64) for words in texts]
        for words, runs in zip(texts, runs_of(numbers, least)):
            if len(runs):
                kept = np.flatnonzero(kept_words(len(words), runs)).tolist()
                collapsed = b" ".join([words[i] for i in kept])
            else:
                collapsed = b" ".join(words)
            yield len(words), [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()], \
                collapsed.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, waiting, size, done = batch.column("whole").to_pylist(), [], 0, []
            for text in texts:
                waiting.append((text or "").encode().split())  # splits at the blanks that part words
                size += len(waiting[-1])
                if size > CHUNK:
                    done += results(waiting)
                    waiting, size = [], 0
            done += results(waiting)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array([d[0] for d in done], pa.int64()),
                 pa.array([d[1] for d in done], run_type), pa.array([d[2] for d in done], pa.string())],
                schema.names)

    return rows.mapInArrow(run, schema).select("kept.*", *added.names)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, …)`` where one id in ten (by crc32) has its text's tail made periodic.

    With h the crc32 of the id, h % 10 = 0 and g = h div 10: every word from a = g % n on becomes word
    a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8).  A null id changes nothing.
    """
    changed = f"""
        transform(array(struct(regexp_extract_all(text, '{_WORD}', 0) words, hash div 10 g)), x ->
          transform(array(struct(x.words, size(x.words) n, x.g,
                                 cast(x.g % greatest(size(x.words), 1) as int) a)), y ->
            concat_ws(' ', transform(if(y.n = 0, cast(array() as array<int>), sequence(0, y.n - 1)), i ->
              y.words[if(i < y.a, i,
                         y.a + (i - y.a) % cast(1 + (y.n - y.a) div (3 + y.g % 8) as int))])))[0])[0]"""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("rest"), F.col("text"),
                       F.expr("crc32(cast(cast(doc_id as string) as binary)) hash"))
    return rows.selectExpr("rest.*", f"case when hash % 10 = 0 then {changed} else text end text")


@query("op12_run_detection")
def op12_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    best = "array_max(transform(runs, r -> struct(r.length, -r.start start, -r.period period)))"
    return detect_runs(with_repeated_tails(docs)).selectExpr("*", f"{best} best").selectExpr(
        "doc_id", "cast(size(runs) as bigint) n_runs", "-best.start start", "best.length length",
        "-best.period period", "1000 * best.length div -best.period exponent_milli",
        """sha2(array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period), '\n')),
           ''), 256) runs_sha256""", "sha2(collapsed, 256) collapsed_sha256")
