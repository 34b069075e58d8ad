"""Global order at scale: ranks, running totals and exact percentiles.

A window without ``partitionBy`` pulls the whole table into one task.  These
operators range-partition instead, number the rows inside each partition, and
add per-partition offsets from a table with one row per partition.  The numbered
rows are written once to the shared checkpoint folder: range bounds come from
sampling, so the numbering has to be frozen before two branches use it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from ..functions.scalars import text

SAMPLED = 32  # keys sampled per range
_LOCAL_BITS = 33  # monotonically_increasing_id: partition in the high bits, row in the low 33


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; only local sessions get a fallback."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    # nothing is set and there is one machine: a folder for the life of this process
    folder = tempfile.mkdtemp(prefix="dunwright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/frozen-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, **totals: str) -> tuple[DataFrame, Row]:
    """Write a table once; ``totals`` (name = aggregate as SQL text) are taken from the rows as they pass."""
    seen = Observation()
    written = materialize(df.observe(seen, *[F.expr(f"{e} {name}") for name, e in totals.items()]))
    return written, Row(**seen.get)


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``_part`` and ``_row``: their place in the given global order."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.selectExpr("*", "monotonically_increasing_id() _mid").selectExpr(
        "* except (_mid)", f"cast(shiftright(_mid, {_LOCAL_BITS}) as int) _part",
        f"_mid & {(1 << _LOCAL_BITS) - 1} _row"))


@dataclass(frozen=True)
class Ranges:
    """Even ranges of a table along some columns, found from a sample and held as literals.

    ``number`` is the range of a row as an expression: ranges become a column that can be grouped and
    partitioned by, without a shuffle of their own, and retried tasks agree on them.
    """

    bounds: list[str]  # JSON of the first key of every range but the first
    schema: str

    def _search(self, holds: str) -> str:
        """How many bounds ``_bound`` satisfy ``holds``, which is true of the first ones only (binary search)."""
        n = len(self.bounds)
        if not n:
            return "0"
        table = f"from_json({text('[' + ','.join(self.bounds) + ']')}, {text(self.schema)})"
        steps = ", ".join(str(1 << i) for i in range(n.bit_length() - 1, -1, -1))
        holds = re.sub(r"\b_bound\b", f"{table}[lo + step - 1]", holds)
        return f"aggregate(array({steps}), 0, (lo, step) -> if(lo + step <= {n} and {holds}, lo + step, lo))"

    def number(self, *keys: str) -> str:
        return self._search(f"_bound <= struct({', '.join(keys)})")

    def splits(self, column: str) -> str:
        """Whether rows with this row's value of the first column can lie in more than one range."""
        return f"{self._search(f'(_bound.{column} <=> {column} or _bound.{column} < {column} or _bound.{column} is null)')}" \
               f" > {self._search(f'(_bound.{column} < {column} or _bound.{column} is null and {column} is not null)')}"


def even_ranges(keys: DataFrame, parts: int) -> Ranges:
    """About ``parts`` ranges of equally many rows; at most ``SAMPLED`` keys a range reach the driver."""
    rows = keys.count()
    schema = f"array<{keys.schema.simpleString()}>"
    if rows == 0 or parts < 2:
        return Ranges([], schema)
    sample = keys.sample(min(1.0, parts * SAMPLED / rows), seed=11)
    step = max(1, min(rows // parts, SAMPLED))
    found = sample.agg(F.expr(f"""array_distinct(transform(filter(sort_array(collect_list(struct(*))),
        (x, i) -> i % {step} = {step} - 1), x -> to_json(x, map('ignoreNullFields', 'false'))))""")).first()[0]
    return Ranges(found, schema)


def with_global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Append the 1-based position of every row in a total order.

    One range shuffle; the offsets table has one row per partition, so the window
    over it and its broadcast are bounded by the number of partitions.
    """
    rows = _numbered(df, order)
    offsets = rows.groupBy("_part").agg(F.expr("count(1) _n")).selectExpr("_part", """
        coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0)
        _before""")
    return rows.join(F.broadcast(offsets), "_part").selectExpr(
        "* except (_part, _row, _before)", f"_before + _row + 1 {rank}")


def with_running_totals(df: DataFrame, order: list[str], running: dict[str, str],
                        overall: dict[str, str] | None = None, group: list[str] | None = None,
                        ranges: int | None = None) -> DataFrame:
    """Append inclusive running sums along a total order (SQL text, ascending), per group.

    ``running`` maps a new column to the summed column, ``overall`` a new column to the
    column whose total over the whole group it carries.  Rows should be distinct in
    group and order (pre-aggregate ties), so ranges stay even.

    The table is written once; its range is a column that the rows are partitioned by, so they are
    shuffled once, and ranges and sums come from the same sorted pass.  Only groups that lie in several
    ranges need what came before: at most two rows a range, and one for each range that a group fills.
    """
    group, overall = group or [], overall or {}
    sources = sorted({*running.values(), *overall.values()})
    source = materialize(df)
    wanted = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    cuts = even_ranges(source.selectExpr(*[f"{k} k{i}" for i, k in enumerate(keys)]), wanted)
    rows = source.selectExpr("*", f"{cuts.number(*keys)} _part")
    own = f"partition by {', '.join(['_part', *group])}"
    summed = rows.selectExpr(
        "*", *[f"sum({src}) over ({own} order by {', '.join(order)} "
               f"rows between unbounded preceding and current row) _i_{new}" for new, src in running.items()],
        *[f"sum({src}) over ({own}) _t_{new}" for new, src in overall.items()])
    by_group = f"partition by {', '.join(group)}" if group else ""
    parts = rows.groupBy("_part", *group).agg(*[F.expr(f"sum({src}) _s_{src}") for src in sources])
    offsets = parts.selectExpr(
        "_part _p", *[f"{g} _g{i}" for i, g in enumerate(group)], f"count(1) over ({by_group}) _ranges", *[
            f"coalesce(sum(_s_{src}) over ({by_group} order by _part "
            f"rows between unbounded preceding and 1 preceding), 0) _b_{new}" for new, src in running.items()],
        *[f"sum(_s_{src}) over ({by_group}) _o_{new}" for new, src in overall.items()]).filter("_ranges > 1")
    same = " and ".join(["_part = _p", *[f"{g} <=> _g{i}" for i, g in enumerate(group)]])
    return summed.join(F.broadcast(offsets), F.expr(same), "left").selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"coalesce(_o_{new}, _t_{new}) {new}" for new in overall],
        *[f"coalesce(_b_{new}, 0) + _i_{new} {new}" for new in running])


def exact_percentiles(values: DataFrame, fractions: list[float]) -> DataFrame:
    """Linear-interpolated percentiles of long rows ``(feature, value)``.

    Returns one row per feature: ``feature, n, percentiles`` (array of double).
    Values are first counted, so a value shared by a third of the table is one row;
    no group of raw rows ever meets in one task.
    """
    counts = (values.filter("value is not null and not isnan(cast(value as double))")
              .groupBy("feature", "value").agg(F.expr("count(1) n")))
    placed = with_running_totals(
        counts, ["value"], {"upto": "n"}, {"total": "n"}, ["feature"])

    low = lambda f, n: f"floor({f!r}D * ({n} - 1))"
    pick = lambda k, name: (
        f"max(case when upto - n <= {k} and {k} < upto then cast(value as double) end) {name}")
    picks = []
    for i, f in enumerate(fractions):
        picks.append(pick(low(f, "total"), f"lo{i}"))
        picks.append(pick(f"least({low(f, 'total')} + 1, total - 1)", f"hi{i}"))
    picked = placed.groupBy("feature").agg(F.expr("max(total) n"), *[F.expr(p) for p in picks])
    between = ", ".join(
        f"lo{i} + (hi{i} - lo{i}) * ({f!r}D * (n - 1) - {low(f, 'n')})"
        for i, f in enumerate(fractions))
    return picked.selectExpr("feature", "n", f"array({between}) percentiles")
