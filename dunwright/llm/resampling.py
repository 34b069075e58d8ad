"""Target-distribution importance resampling over hashed word n-grams.

Every document's weight is the mean log ratio of its n-grams' frequencies in the target and in the corpus,
per hash bucket; adding keyed Gumbel noise and taking the highest scores draws without replacement in
proportion to the weights.  Both counts cover all rows: tasks add up arrays of buckets, Spark sums them, and
only one row per bucket reaches the driver.  The scores are written once.  The cutoff is found by numeric
bisection: each job counts exactly how many rows lie below some thresholds of the score, then of the
ids tied at it, then of the row numbers of rows that share both.  Drawn rows alone are range-partitioned for
their ranks.  No key is grouped, so no hot id, source or group of copies can fill a task.

Nulls and texts without words have no features, weight 0, and take no part in the draw, like all below
``least_words``.  A null id is hashed as the empty string and comes last among ties.  Repeated rows are
candidates of their own.  Long texts are read in pieces.  Empty tables give empty results; an empty target
counts 0 everywhere.  Extra columns are kept (``n_features weight score rank`` are replaced).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ordering import with_global_rank
from .common import small_batches, written
from .registry import query

BUCKETS = 10_000
WORDS = 2           # longest n-gram
LEAST_WORDS = 20    # of a document that may be drawn
SHARE = (25, 100)   # of them are drawn
SEED = "7"
SPLITS = 64         # thresholds counted by one job, plus one
PIECE = 1 << 20     # bytes of a text that are split into words at once

# A-Z to lower case; bytes that belong to no word to blanks
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))
_NULL_ID = (1 << 63) - 1


def feature_hashes(text: bytes, words: int = WORDS) -> Iterator[tuple[int, list[int]]]:
    """(number of words, hashes of the n-grams that end in them) piece by piece."""
    data = text.translate(_FOLD)
    start, before = 0, []
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        own = data[start:end].split()
        run, start = before + own, end
        known = len(before)
        hashes = list(map(crc32, run))
        found = hashes[known:]
        spaced = [b" " + w for w in run]
        for n in range(1, words):
            hashes = list(map(crc32, spaced[n:], hashes))  # goes on from the hash of the first words
            found += hashes[max(0, known - n):]
        before = run[len(run) - words + 1:] if len(run) >= words else run
        yield len(own), found


def bucket_counts(texts: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows (column text) per bucket."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting = np.zeros(buckets, dtype=np.int64), []

        def added() -> None:
            total[:] += np.bincount(np.array(waiting, dtype=np.int64) % buckets, minlength=buckets)
            waiting.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, found in feature_hashes((text or "").encode(), words):
                    waiting += found
                    if len(waiting) > PIECE:
                        added()
        added()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in (texts.select("text").mapInArrow(run, "bucket bigint, n bigint")
                .groupBy("bucket").agg(F.expr("sum(n) n")).collect()):  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies per bucket, rounded down."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(s_all + size)
                                   / (float(s + 1) * float(t_all + size))))
        for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: str, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw keyed by the id, rounded down."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(docs: DataFrame, keep: list[str], gain: np.ndarray, words: int, seed: str) -> DataFrame:
    """(kept, id, n_words, n_features, weight, score); the input's columns travel as one struct."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
                       F.col("doc_id").cast("bigint").alias("id"), F.col("text").alias("text"))
    added = ["n_words", "n_features", "weight", "score"]
    schema = T.StructType([rows.schema["kept"], rows.schema["id"],
                           *[T.StructField(c, T.LongType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[int]] = [[], [], [], []]
            for text, doc_id in zip(batch.column("text").to_pylist(), batch.column("id").to_pylist()):
                n_words = n = total = 0
                for some, found in feature_hashes((text or "").encode(), words):
                    n_words, n = n_words + some, n + len(found)
                    total += int(gain[np.array(found, dtype=np.int64) % len(gain)].sum())
                weight = total // n if n else 0
                for column, value in zip(columns, (n_words, n, weight, weight + noise(seed, doc_id))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), batch.column("id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["kept", "id", *added])

    return rows.mapInArrow(run, schema)


def cutoff(rows: DataFrame, order: list[str], k: int) -> list[int]:
    """The k-th place (from 1) of ``rows`` in ascending order of bigint columns, by repeated counts.

    A job counts the rows at or below some thresholds of one column; the interval that holds the place is
    cut again until one value is left, whose ties go on to the next column.  Fewer values than columns
    are returned where all rows tied so far are within the place.
    """
    cut: list[int] = []
    for column in order:
        lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        if n == k and cut:
            break
        while lo < hi:
            steps = sorted({lo + (hi - lo) * j // SPLITS for j in range(1, SPLITS)} - {hi})
            counts = rows.agg(*[F.expr(f"count_if({column} <= {t})") for t in steps]).first()
            for t, upto in zip(steps, counts):
                if upto >= k:
                    hi = t
                    break
                lo = t + 1
        k -= rows.filter(F.col(column) < lo).count()
        rows = rows.filter(F.col(column) == lo)
        cut.append(lo)
    return cut


def resample(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, words: int = WORDS,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE,
             seed: str = SEED) -> DataFrame:
    """Rows of ``docs(doc_id, text, …)`` with n_features, weight, score, and the rank of drawn ones.

    ``target(text, …)`` is the sample whose distribution is aimed at.  ``keep`` names the columns that
    come along; by default all but the four.
    """
    names = ("n_features", "weight", "score", "rank")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    gain = gains(bucket_counts(docs, words, buckets), bucket_counts(target, words, buckets))
    rows = written(_scored(docs, keep, gain, words, seed).selectExpr(
        "*", "-score down", f"coalesce(id, {_NULL_ID}L) tied", "monotonically_increasing_id() row"),
        "resampling")
    may = f"n_words >= {least_words}"
    order = ["down", "tied", "row"]
    k = rows.filter(may).count() * share[0] // share[1]
    if k == 0:
        drawn = "false"
    else:
        cut = cutoff(rows.filter(may).select(*order), order, k)
        upto = f"{order[len(cut) - 1]} <= {cut[-1]}"
        for column, value in zip(order[len(cut) - 2::-1] if len(cut) > 1 else [], cut[-2::-1]):
            upto = f"({column} < {value} or {column} = {value} and {upto})"
        drawn = f"{may} and {upto}"
    ranked = with_global_rank(rows.filter(drawn), [F.col(c) for c in order])
    out = ["kept.*", "n_features", "weight", "score"]
    return ranked.selectExpr(*out, "cast(rank as bigint) rank").unionByName(
        rows.filter(f"not ({drawn})").selectExpr(*out, "cast(null as bigint) rank"))


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), keep=["doc_id"])
