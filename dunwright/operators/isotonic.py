"""Isotonic regression as a distributed fit, and its steps as SQL text.

The fit is the slope of the greatest convex minorant of the labels' running sums.  Labels are counted per
distinct score and the scores cut into even ranges; every range pools its own neighbours that are out of order
into blocks, and then neighbouring ranges pool their blocks pairwise, in tasks, until one range is left.  Means
are compared as fractions of whole numbers, so the result does not depend on how the ranges fall.

Labels are 0 or 1, so blocks are edges of a convex polygon with whole coordinates: n rows have at most about
n^(2/3) blocks however they are ordered, and about n^(1/3) when scores carry noise.  Only blocks move on.

Several fits (a part each) go through the same steps together; ranges are even over all of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import text
from .ordering import even_ranges, materialize

MOST_STEPS = 1_000_000  # of a model that is held as literal text
_BLOCK = "part int, range int, lo double, hi double, n bigint, positives bigint"
_STEPS = "struct<b:array<double>,p:array<double>>"


def _pool(table: pa.Table) -> pa.Table:
    """Merge neighbouring blocks of a part until their means rise."""
    table = table.sort_by("lo")
    blocks: list[tuple[float, float, int, int]] = []
    for lo, hi, n, positives in zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "n", "positives"))):
        while blocks and blocks[-1][3] * n >= positives * blocks[-1][2]:
            before = blocks.pop()
            lo, n, positives = before[0], n + before[2], positives + before[3]
        blocks.append((lo, hi, n, positives))
    part, ranges = ([table.column(c)[0].as_py()] * len(blocks) for c in ("part", "range"))
    columns = list(zip(*blocks)) or [[], [], [], []]
    return pa.table({"part": pa.array(part, pa.int32()), "range": pa.array(ranges, pa.int32()), "lo": pa.array(columns[0], pa.float64()),
                     "hi": pa.array(columns[1], pa.float64()), "n": pa.array(columns[2], pa.int64()),
                     "positives": pa.array(columns[3], pa.int64())})


def _blocks(scored: DataFrame, part: str, label: str, score: str, ranges: int | None) -> DataFrame:
    """The blocks ``(part, lo, hi, n, positives, value)`` of the fit of every part (whole number as SQL text)."""
    spark = scored.sparkSession
    counted = materialize(scored.selectExpr(
        f"cast({part} as int) part", f"cast({score} as double) x", f"cast({label} as bigint) y")
        .filter("x is not null and not isnan(x) and y is not null")
        .groupBy("part", "x").agg(F.expr("count(1) n"), F.expr("sum(y) positives")))
    wanted = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = even_ranges(counted.select("part", "x"), wanted)
    blocks = counted.selectExpr("part", f"cast({cuts.number('part', 'x')} as int) range", "x lo", "x hi", "n",
                                "positives").groupBy("part", "range").applyInArrow(_pool, _BLOCK)
    left = len(cuts.bounds) + 1
    while left > 1:  # neighbours meet in pairs, so that no task takes all ranges at once
        blocks = blocks.selectExpr("part", "cast(range div 2 as int) range", "lo", "hi", "n", "positives") \
            .groupBy("part", "range").applyInArrow(_pool, _BLOCK)
        left = (left + 1) // 2
    return materialize(blocks.selectExpr("part", "lo", "hi", "n", "positives", "positives / n value"))


def isotonic_blocks(scored: DataFrame, label: str = "recovered", score: str = "model_score",
                    ranges: int | None = None) -> DataFrame:
    """The blocks ``(lo, hi, n, positives, value)`` of the fit; values rise with the scores.

    Rows without a label or a score (or whose score is no number) take no part.
    """
    return _blocks(scored, "0", label, score, ranges).drop("part")


@dataclass(frozen=True)
class IsotonicSteps:
    """A fitted isotonic curve: rising points, linear between them, flat outside."""

    boundaries: list[float]
    predictions: list[float]

    def sql(self, score: str) -> str:
        """The calibrated probability of a score as SQL text; the place is found by binary search."""
        n = len(self.boundaries)
        if not n:
            return "cast(null as double)"
        steps = f"from_json({text(json.dumps({'b': self.boundaries, 'p': self.predictions}))}, '{_STEPS}')"
        halves = ", ".join(str(1 << i) for i in range(n.bit_length() - 1, -1, -1))
        place = (f"aggregate(array({halves}), 0, (lo, s) ->"
                 f" if(lo + s <= {n} and q.t.b[lo + s - 1] <= q.x, lo + s, lo))")
        return (f"transform(transform(array(struct({steps} as t, cast({score} as double) as x)),"
                f" q -> struct(q.t as t, q.x as x, {place} as k)), r -> case when r.x is null then null"
                f" when r.k = 0 then r.t.p[0] when r.k = {n} or r.t.b[r.k - 1] = r.x then r.t.p[r.k - 1]"
                " else r.t.p[r.k - 1] + (r.t.p[r.k] - r.t.p[r.k - 1]) * (r.x - r.t.b[r.k - 1])"
                " / (r.t.b[r.k] - r.t.b[r.k - 1]) end)[0]")

    def save(self, spark: SparkSession, path: str) -> None:
        (spark.createDataFrame([(self.boundaries, self.predictions)], "b array<double>, p array<double>")
         .coalesce(1).write.mode("overwrite").parquet(path))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsotonicSteps":
        row = spark.read.schema("b array<double>, p array<double>").parquet(path).first()
        return cls(list(row.b), list(row.p))


def fit_isotonic(scored: DataFrame, label: str = "recovered", score: str = "model_score",
                 ranges: int | None = None) -> IsotonicSteps:
    """The fit as steps; a block gives a point at each of its ends."""
    return fit_isotonic_parts(scored, "0", label, score, ranges).get(0, IsotonicSteps([], []))


def fit_isotonic_parts(scored: DataFrame, part: str, label: str = "recovered", score: str = "model_score",
                       ranges: int | None = None) -> dict[int, IsotonicSteps]:
    """The fits of all parts of a table as steps; a part without scored rows has none."""
    blocks = _blocks(scored, part, label, score, ranges)
    fitted = {}
    for p, steps in sorted((r.part, r["count"]) for r in blocks.groupBy("part").count().collect()):
        if steps > MOST_STEPS:
            raise ValueError(f"{steps} steps are too many for a literal model; use isotonic_blocks")
        points: dict[float, float] = {}
        for r in blocks.filter(f"part = {p}").orderBy("lo").collect():  # at most MOST_STEPS rows
            points[r.lo] = points[r.hi] = r.value
        fitted[p] = IsotonicSteps(list(points), list(points.values()))
    return fitted
