"""Expected-value economics: three strategies, threshold sweep, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CostModel
from ..functions.decisions import payment_value, priority_band
from ..functions.scalars import dec, double, ratio, text
from .lookup import rows_of

# i·0.05 in double arithmetic, as in the published sweep.
THRESHOLDS = tuple(i * 0.05 for i in range(20))
COST_SCENARIOS = (("LOW COST", 10.0), ("BASE COST", 50.0), ("HIGH COST", 250.0))


def _money(value: str) -> str:
    return f"cast({value} as decimal(38,8))"


def economics_profile(scored: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Counts and expected values by (thresholds reached, band, chosen).

    Everything the expected-value strategies need, from one pass over the payments:
    at most 21 × 4 × 2 rows, whatever the size of the input.
    """
    steps = ", ".join(map(double, THRESHOLDS))
    reached = f"size(filter(array({steps}), t -> p >= t))"
    keyed = scored.selectExpr("cast(recovery_probability as double) p", f"{payment_value()} v")
    return keyed.groupBy(
        F.expr(f"{reached} as bucket"), F.expr(f"{priority_band('p')} as band"),
        F.expr(f"p >= {double(threshold)} as chosen")
    ).agg(F.expr("count(1) n"), F.expr("sum(v) v"))


def fixed_strategies(profile: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Blind retry (everything) and rule-based (by band), from one aggregate of a profile."""
    effect = (f"case band when 'HIGH' then {dec(costs.retry_multiplier, 3, 2)} "
              f"when 'MEDIUM' then {dec(costs.reminder_multiplier, 3, 2)} "
              f"when 'LOW' then {dec(costs.manual_review_multiplier, 3, 2)} end")
    in_band = [f"coalesce(sum(case when band = '{b}' then n end), 0) {b.lower()}"
               for b in ("HIGH", "MEDIUM", "LOW")]
    sums = profile.agg(*[F.expr(e) for e in (
        "coalesce(sum(n), 0) total_payments",
        f"coalesce(sum(v * {dec(costs.retry_multiplier, 3, 2)}), {dec(0)}) blind_gross",
        f"coalesce(sum(v * {effect}), {dec(0)}) rule_gross", *in_band)])
    rule_cost = (f"high * {dec(costs.retry_total)} + medium * {dec(costs.reminder_cost)} "
                 f"+ low * {dec(costs.manual_review_cost)}")
    row = lambda name, retries, gross, cost: (
        f"named_struct('strategy', {text(name)}, 'retry_count', {retries}, "
        f"'gross', {_money(gross)}, 'cost', {_money(cost)})")
    rows = ", ".join([
        row("Blind Retry", "total_payments", "blind_gross",
            f"total_payments * {dec(costs.retry_total)}"),
        row("Current Rule-Based", "high", "rule_gross", rule_cost)])
    return sums.selectExpr("total_payments", f"inline(array({rows}))").selectExpr(
        "strategy", "total_payments", "retry_count",
        f"{ratio('retry_count', 'total_payments')} * 100 retry_percentage",
        "gross expected_recovery", "cost action_cost",
        f"{_money('gross - cost')} expected_net_recovery")


def blind_retry(scored: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Every payment is retried."""
    return fixed_strategies(economics_profile(scored), costs).filter("strategy = 'Blind Retry'")


def rule_based(scored: DataFrame, costs: CostModel = CostModel()) -> DataFrame:
    """Retry, remind or review by probability band."""
    return fixed_strategies(economics_profile(scored), costs).filter(
        "strategy = 'Current Rule-Based'")


def selective_retry(scored: DataFrame, threshold: float, cost: float) -> DataFrame:
    """Retry where the probability reaches one threshold."""
    return _selective_row(economics_profile(scored, threshold), threshold, cost)


def _selective_row(profile: DataFrame, threshold: float, cost: float) -> DataFrame:
    return _selective_columns(profile.agg(*[F.expr(e) for e in (
        "coalesce(sum(n), 0) total_payments",
        "coalesce(sum(case when chosen then n end), 0) retry_count",
        f"coalesce(sum(case when chosen then v end), {dec(0)}) gross")]
    ).selectExpr("*", f"{double(threshold)} threshold", f"{dec(cost)} retry_cost"))


def _selective_columns(sums: DataFrame) -> DataFrame:
    cost = "retry_count * retry_cost"
    return sums.selectExpr(
        "threshold", f"{_money('retry_cost')} retry_cost", "total_payments", "retry_count",
        f"{ratio('retry_count', 'total_payments')} * 100 retry_percentage",
        f"{_money('gross')} expected_recovery", f"{_money(cost)} recovery_cost",
        f"{_money(f'gross - {cost}')} expected_net_recovery",
        f"{ratio('gross', 'retry_count')} recovery_per_retry", f"{ratio('gross', cost)} roi")


def threshold_sweep(scored: DataFrame, costs: tuple[float, ...] = (50.0,)) -> DataFrame:
    """All thresholds × costs in one pass over the payments."""
    return sweep_profile(economics_profile(scored), costs)


def sweep_profile(profile: DataFrame, costs: tuple[float, ...] = (50.0,)) -> DataFrame:
    """Totals above each threshold as reverse running sums over 21 buckets.

    Neither the thresholds nor the costs multiply the input.
    """
    buckets = profile.groupBy("bucket").agg(F.expr("sum(n) n"), F.expr("sum(v) v"))
    spine = rows_of(profile.sparkSession, "bucket, threshold", [
        (i, THRESHOLDS[i - 1] if i else None) for i in range(len(THRESHOLDS) + 1)])
    above = "order by bucket desc rows between unbounded preceding and current row"
    totals = spine.join(buckets, "bucket", "left").selectExpr(  # 21 rows
        "threshold", f"coalesce(sum(n) over ({above}), 0) retry_count",
        f"coalesce(sum(v) over ({above}), {dec(0)}) gross",
        "coalesce(sum(n) over (order by bucket desc rows between unbounded preceding "
        "and unbounded following), 0) total_payments").filter("threshold is not null")
    return _selective_columns(totals.selectExpr(
        "*", f"explode(array({', '.join(map(dec, costs))})) retry_cost"))


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """Best row per cost: highest net value, the lowest threshold on ties."""
    row = f"struct({', '.join(sweep.columns)})"
    return sweep.groupBy("retry_cost").agg(F.expr(
        f"max_by({row}, struct(expected_net_recovery, -threshold)) _r")).select("_r.*")


def optimal_threshold_value(scored: DataFrame, cost: float = 50.0) -> Column:
    """The best threshold as a scalar subquery, to be used inside row expressions."""
    return optimal_threshold(threshold_sweep(scored, (cost,))).select("threshold").scalar()


def cost_sensitivity(scored: DataFrame) -> DataFrame:
    """Best threshold of each cost scenario, one sweep for all of them."""
    names = " ".join(f"when {dec(cost)} then {text(name)}" for name, cost in COST_SCENARIOS)
    best = optimal_threshold(threshold_sweep(scored, tuple(c for _, c in COST_SCENARIOS)))
    return best.selectExpr(
        f"case cast(retry_cost as decimal(14,2)) {names} end cost_scenario", "retry_cost",
        "threshold optimal_threshold", "expected_net_recovery", "retry_percentage")


def strategy_comparison(scored: DataFrame, costs: CostModel = CostModel(),
                        threshold: float | None = None) -> DataFrame:
    """Blind, rule-based and selective strategies side by side.

    Without a threshold the selective strategy uses the optimal one for the retry
    cost.  All rows share one profile, whose exchange Spark reuses.
    """
    profile = economics_profile(scored, 2.0 if threshold is None else threshold)
    if threshold is None:
        chosen = optimal_threshold(sweep_profile(profile, (costs.retry_total,)))
    else:
        chosen = _selective_row(profile, threshold, costs.retry_total)
    selective = chosen.selectExpr(
        "'Optimized Selective Recovery' strategy", "total_payments", "retry_count",
        "retry_percentage", "expected_recovery", "recovery_cost action_cost",
        "expected_net_recovery")
    return fixed_strategies(profile, costs).unionByName(selective)


def comparison_long(comparison: DataFrame) -> DataFrame:
    """Long form (strategy, metric, value) of the money columns."""
    return comparison.unpivot(
        ["strategy"], ["expected_recovery", "action_cost", "expected_net_recovery"],
        "metric", "value")
