"""Prediction summaries, population-stability drift and descriptive profiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..config import PRIORITIES
from ..functions.scalars import double
from .lookup import densify
from .ordering import exact_percentiles, materialize, materialize_observed

NUMERIC_DRIFT = ("payment_amount", "customer_tenure_months", "historical_success_rate")
CATEGORICAL_DRIFT = ("failure_reason", "payment_method", "is_subscription")
EMPTY_SHARE = 0.0001  # stands in for a share of zero


def long_values(df: DataFrame, columns: list[str], keep: list[str] | None = None,
                kind: str = "double") -> DataFrame:
    """Columns as rows ``(feature, value)``; NULL and NaN are dropped."""
    keep = keep or []
    rows = df.selectExpr(*keep, *[f"cast({c} as {kind}) {c}" for c in columns]).unpivot(
        keep, columns, "feature", "value")
    return rows.filter("value is not null" + (" and not isnan(value)" if kind == "double" else ""))


def prediction_summary(scored: DataFrame,
                       columns: tuple[str, ...] = ("recovery_probability", "expected_recovery")
                       ) -> DataFrame:
    """mean, median, min, max and sample deviation per column, as rows."""
    present = [c for c in columns if c in scored.columns]
    stats = ", ".join(
        f"named_struct('feature', '{c}', 'mean', cast(sum({c}) as double) / count({c}), "
        f"'min', cast(min({c}) as double), 'max', cast(max({c}) as double), "
        f"'std', stddev_samp(cast({c} as double)))" for c in present)
    wide = scored.agg(F.expr(f"array({stats}) stats")).selectExpr("inline(stats)")
    medians = exact_percentiles(long_values(scored, present), [0.5]).selectExpr(
        "feature", "element_at(percentiles, 1) median")
    return wide.join(medians, "feature", "left")


def priority_distribution(scored: DataFrame) -> DataFrame:
    counts = scored.groupBy("priority").agg(F.expr("count(1) payments"))
    return densify(counts, "priority", PRIORITIES, ["payments"])


def expected_by_priority(scored: DataFrame) -> DataFrame:
    sums = scored.groupBy("priority").agg(
        F.expr("count(1) payments"), F.expr("sum(expected_recovery) expected_recovery"))
    return densify(sums, "priority", PRIORITIES, ["payments", "expected_recovery"])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and shares of a column's values (the total runs over the counted values)."""
    counts, seen = materialize_observed(df.groupBy(column).agg(F.expr("count(1) n")), total="sum(n)")
    return counts.selectExpr(column, "n", f"n / {seen.total or 0}L share")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def drift_status(psi: str) -> str:
    return f"case when {psi} < 0.1D then 'NORMAL' when {psi} < 0.2D then 'WARNING' else 'DRIFT' end"


def _psi_of_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """PSI per feature (and ``by``) from counted bins ``(feature, type, bin, ref, cur)``.

    A bin empty on both sides contributes nothing, so absent bins need no spine.
    """
    share = lambda c: (f"case when {c} = 0 then {double(EMPTY_SHARE)} "  # noqa: E731
                       f"else {c} / {c}_total end")
    totals = counts.groupBy(*by, "feature").agg(
        F.expr("sum(ref) ref_total"), F.expr("sum(cur) cur_total"))  # one row per feature
    shares = counts.join(totals if by else F.broadcast(totals), [*by, "feature"]).selectExpr(
        *by, "feature", "type", f"{share('ref')} e", f"{share('cur')} a")
    return shares.groupBy(*by, "feature", "type").agg(F.expr("sum((a - e) * ln(a / e)) psi"))


def _both_sides(rows: DataFrame, reference: str, kind: str) -> DataFrame:
    return rows.groupBy("feature", "bin").agg(
        F.expr(f"'{kind}' type"), F.expr(f"count_if({reference}) ref"),
        F.expr(f"count_if(not {reference}) cur"))


def _numeric_bins(df: DataFrame, columns: list[str], reference: str, buckets: int = 10,
                  edge_digits: int | None = None) -> DataFrame:
    values = long_values(df, columns, [reference])
    steps = [i / buckets for i in range(buckets + 1)]
    inner = exact_percentiles(values.filter(reference), steps).selectExpr(
        "feature",
        "array_distinct(percentiles) edges" if edge_digits is None
        else f"array_distinct(transform(percentiles, e -> round(e, {edge_digits}))) edges",
    ).selectExpr(
        "feature", "case when size(edges) > 2 then slice(edges, 2, size(edges) - 2) "
                   "else cast(array() as array<double>) end inner_edges")
    # one row per monitored feature
    binned = values.join(F.broadcast(inner), "feature").selectExpr(
        "feature", reference, "cast(size(filter(inner_edges, e -> value >= e)) as string) bin")
    return _both_sides(binned, reference, "numeric")


def _category_bins(df: DataFrame, columns: list[str], reference: str) -> DataFrame:
    rows = long_values(df, columns, [reference], "string").withColumnRenamed("value", "bin")
    return _both_sides(rows, reference, "categorical")


def numeric_psi(df: DataFrame, columns: list[str], reference: str = "is_reference",
                buckets: int = 10, edge_digits: int | None = None) -> DataFrame:
    """PSI of numeric columns between reference and current rows of one table.

    Bins are [edge, next edge) with outer edges open, edges the reference's
    interpolated percentiles; fewer than two distinct edges give 0.  Edges are exact
    unless ``edge_digits`` rounds them, for results that another engine has to repeat.
    """
    return _psi_of_counts(_numeric_bins(df, columns, reference, buckets, edge_digits))


def categorical_psi(df: DataFrame, columns: list[str], reference: str = "is_reference"
                    ) -> DataFrame:
    """PSI of categorical columns over the union of the categories of both sides."""
    return _psi_of_counts(_category_bins(df, columns, reference))


def drift_report(df: DataFrame, reference: str = "is_reference",
                 edge_digits: int | None = None) -> DataFrame:
    """Drift of the monitored features between two parts of one table."""
    numeric = [c for c in NUMERIC_DRIFT if c in df.columns]
    categorical = [c for c in CATEGORICAL_DRIFT if c in df.columns]
    bins = [_numeric_bins(df, numeric, reference, edge_digits=edge_digits)] if numeric else []
    bins += [_category_bins(df, categorical, reference)] if categorical else []
    # a few counted rows, written so that the passes that count them run once
    report = _psi_of_counts(materialize(reduce(DataFrame.unionByName, bins)))
    return report.selectExpr("feature", "type", "round(psi, 4) drift_metric_psi",
                             f"{drift_status('psi')} status")


def drift_between(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Drift between two tables; features missing on either side are skipped."""
    shared = [c for c in NUMERIC_DRIFT + CATEGORICAL_DRIFT
              if c in reference.columns and c in current.columns]
    return drift_report(reference.selectExpr(*shared, "true is_reference").unionByName(
        current.selectExpr(*shared, "false is_reference")))


@dataclass(frozen=True)
class DriftProfile:
    """What later rows are compared with: the reference's bin edges and counts; it is sorted once."""

    edges: dict[str, list[float]]  # inner edges per numeric feature
    categories: tuple[str, ...]
    counts: DataFrame              # (feature, type, bin, ref)

    def bins(self) -> str:
        """The bins of a row, as an array of (feature, type, bin)."""
        numeric = [f"struct('{c}' as feature, 'numeric' as type, case when not isnan(cast({c} as double)) then cast(size(filter("
                   f"cast(array({', '.join(map(double, e))}) as array<double>), e -> cast({c} as double) >= e))"
                   " as string) end as bin)" for c, e in self.edges.items()]
        return f"array({', '.join(numeric + [_category_bin(c) for c in self.categories])})"


def _category_bin(column: str) -> str:
    return f"struct('{column}' as feature, 'categorical' as type, cast({column} as string) as bin)"


def drift_profile(reference: DataFrame, buckets: int = 10, edge_digits: int | None = None) -> DriftProfile:
    """Edges and counts of the monitored features of a reference table, both written once."""
    numeric = [c for c in NUMERIC_DRIFT if c in reference.columns]
    categories = tuple(c for c in CATEGORICAL_DRIFT if c in reference.columns)
    rows = materialize(reference.select(*numeric, *categories))
    values = long_values(rows, numeric, [])
    steps = [i / buckets for i in range(buckets + 1)]
    edges: dict[str, list[float]] = {c: [] for c in numeric}
    for r in exact_percentiles(values, steps).collect():  # one row per feature
        found = [round(p, edge_digits) if edge_digits is not None else p for p in r.percentiles]
        edges[r.feature] = list(dict.fromkeys(found))[1:-1]
    profile = DriftProfile(edges, categories, rows)
    counts = rows.selectExpr(f"inline({profile.bins()})").filter("bin is not null").groupBy(
        "feature", "type", "bin").agg(F.expr("count(1) ref"))
    return DriftProfile(edges, categories, materialize(counts))


def window_bins(rows: DataFrame, profile: DriftProfile, event_time: str = "failed_at", width: str = "1 day",
                delay: str = "1 day") -> DataFrame:
    """Counts ``(window_start, feature, type, bin, cur)`` per event-time window, of tables and streams alike."""
    timed = rows.withWatermark(event_time, delay) if rows.isStreaming else rows
    return (timed.selectExpr(event_time, f"inline({profile.bins()})").filter("bin is not null")
            .groupBy(F.window(event_time, width).alias("w"), "feature", "type", "bin")
            .agg(F.expr("count(1) cur")).selectExpr("w.start window_start", "feature", "type", "bin", "cur"))


def window_drift(counts: DataFrame, profile: DriftProfile) -> DataFrame:
    """Drift of every window from its counted bins; the reference's bins are handed to each window."""
    windows = counts.select("window_start", "feature").distinct()
    reference = windows.join(profile.counts, "feature").selectExpr(
        "window_start", "feature", "type", "bin", "ref", "0L cur")
    both = reference.unionByName(counts.selectExpr("*", "0L ref")).groupBy(
        "window_start", "feature", "type", "bin").agg(F.expr("sum(ref) ref"), F.expr("sum(cur) cur"))
    return _psi_of_counts(both, ("window_start",)).selectExpr(
        "window_start", "feature", "type", "round(psi, 4) drift_metric_psi", f"{drift_status('psi')} status")


def recovery_rates(df: DataFrame, dimensions: tuple[str, ...] = CATEGORICAL_DRIFT) -> DataFrame:
    """Recovery rate by each dimension, all in one grouping-sets pass."""
    named = df.selectExpr("recovered", *[f"cast({d} as string) {d}" for d in dimensions])
    columns = [F.col(d) for d in dimensions]
    rows = named.groupingSets([[c] for c in columns], *columns).agg(*[F.expr(e) for e in (
        "count(1) payments", "avg(cast(recovered as double)) recovery_rate",
        *[f"grouping({d}) _g_{d}" for d in dimensions])])
    chosen = " ".join(f"when _g_{d} = 0 then '{d}'" for d in dimensions)
    return rows.selectExpr(f"case {chosen} end dimension",
                           f"coalesce({', '.join(dimensions)}) value", "payments", "recovery_rate")


def _with_span(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    """Rows ``x`` plus the column's extremes as ``lo`` and ``hi``, seen while the rows are written once."""
    rows, seen = materialize_observed(df.selectExpr(f"{value} x", *keep).filter("x is not null"),
                                      lo="min(x)", hi="max(x)")
    return rows.withColumns({"lo": F.lit(seen.lo).cast("double"), "hi": F.lit(seen.hi).cast("double")})


def recovery_by_bin(df: DataFrame, column: str = "historical_success_rate", bins: int = 10
                    ) -> DataFrame:
    """Recovery rate by equal-width bins, right-closed; the lowest edge is widened by 0.1 %."""
    edges = ", ".join(f"lo + (hi - lo) / {double(bins)} * {i}" for i in range(1, bins))
    counted = _with_span(df, f"cast({column} as double)", ["recovered"]).groupBy(
        F.expr(f"size(filter(array({edges}), e -> x > e)) as bin"), "lo", "hi").agg(
        F.expr("count(1) payments"), F.expr("avg(cast(recovered as double)) recovery_rate"))
    width = f"(hi - lo) / {double(bins)}"
    return counted.selectExpr(
        "bin", f"case when bin = 0 then lo - (hi - lo) * 0.001D else lo + {width} * bin end lower",
        f"lo + {width} * (bin + 1) upper", "payments", "recovery_rate")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of fixed equal-width bins on [low, high]; the last bin includes its end."""
    rows = df.selectExpr(f"cast({column} as double) x").filter(
        f"x between {double(low)} and {double(high)}")
    return rows.groupBy(F.expr(
        f"least(floor((x - {double(low)}) / {double((high - low) / bins)}), {bins - 1}) as bin")
    ).agg(F.expr("count(1) n"))


def log_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts of ``bins`` equal-width bins of log10 between the observed extremes."""
    rows = _with_span(df, f"log10(cast({column} as double))", [])
    return rows.groupBy(F.expr(
        f"case when hi > lo then least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) "
        "else 0 end as bin")).agg(F.expr("count(1) n"))
