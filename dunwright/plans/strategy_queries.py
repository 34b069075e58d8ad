"""Expected-value strategies, sweeps and the strategy simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import CostModel
from ..operators import strategy as S
from .registry import Tables, digits, money, query

_ROW = ["strategy", "total_payments", "retry_count", digits("retry_percentage"),
        money("expected_recovery"), money("action_cost"), money("expected_net_recovery")]
_SWEEP = ["threshold", "retry_count", digits("retry_percentage"), money("expected_recovery"),
          money("recovery_cost"), money("expected_net_recovery"), digits("recovery_per_retry"),
          digits("roi")]


def _rows_sql(cost: float, threshold: str) -> str:
    """The three strategies computed straight from the scored payments."""
    return f""", b AS (
  SELECT count(*) AS n, sum(expected_recovery) AS gross,
    count(*) FILTER (WHERE priority = 'HIGH') AS high,
    count(*) FILTER (WHERE priority = 'MEDIUM') AS medium,
    count(*) FILTER (WHERE priority = 'LOW') AS low,
    sum(expected_recovery * (CASE priority WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.50 ELSE 0.75 END))
      AS rule_gross,
    count(*) FILTER (WHERE p >= {threshold}) AS chosen,
    coalesce(sum(expected_recovery) FILTER (WHERE p >= {threshold}), 0) AS chosen_gross
  FROM scored
), r AS (
  SELECT 'Blind Retry' AS strategy, n AS total_payments, n AS retry_count,
    gross AS expected_recovery, n * {cost} AS action_cost FROM b
  UNION ALL SELECT 'Current Rule-Based', n, high, rule_gross, high * {cost} + medium + low * 100 FROM b
  UNION ALL SELECT 'Optimized Selective Recovery', n, chosen, chosen_gross, chosen * {cost} FROM b
), rows AS (
  SELECT strategy, total_payments, retry_count,
    retry_count::DOUBLE / total_payments * 100 AS retry_percentage, expected_recovery, action_cost,
    expected_recovery - action_cost AS expected_net_recovery FROM r)
"""


_BASE_T = "(SELECT threshold FROM best WHERE cost = 50)"


@query("strategy_blind", _rows_sql(50, _BASE_T)
       + f"SELECT {', '.join(_ROW)} FROM rows WHERE strategy = 'Blind Retry'")
def strategy_blind(t: Tables) -> DataFrame:
    return S.blind_retry(t.scored).selectExpr(*_ROW)


@query("strategy_rule_based", _rows_sql(50, _BASE_T)
       + f"SELECT {', '.join(_ROW)} FROM rows WHERE strategy = 'Current Rule-Based'")
def strategy_rule_based(t: Tables) -> DataFrame:
    return S.rule_based(t.scored).selectExpr(*_ROW)


@query("strategy_selective", f""", c AS (
  SELECT 0.31::DOUBLE AS threshold, count(*) AS total, count(*) FILTER (WHERE p >= 0.31::DOUBLE) AS retry_count,
    coalesce(sum(expected_recovery) FILTER (WHERE p >= 0.31::DOUBLE), 0) AS gross FROM scored
), r AS (
  SELECT threshold, retry_count, retry_count::DOUBLE / total * 100 AS retry_percentage,
    gross AS expected_recovery, retry_count * 80 AS recovery_cost,
    gross - retry_count * 80 AS expected_net_recovery,
    CASE WHEN retry_count > 0 THEN gross::DOUBLE / retry_count ELSE 0 END AS recovery_per_retry,
    CASE WHEN retry_count > 0 THEN gross::DOUBLE / (retry_count * 80) ELSE 0 END AS roi FROM c)
SELECT {', '.join(_SWEEP)} FROM r""")
def strategy_selective(t: Tables) -> DataFrame:
    """A threshold off the grid, as picked with a slider."""
    return S.selective_retry(t.scored, 0.31, 80.0).selectExpr(*_SWEEP)


def _sweep_sql(source: str, extra: str = "") -> str:
    return f""", r AS (
  SELECT *, retry_count::DOUBLE / total_payments * 100 AS retry_percentage,
    gross AS expected_recovery, retry_count * cost AS recovery_cost, net AS expected_net_recovery,
    CASE WHEN retry_count > 0 THEN gross::DOUBLE / retry_count ELSE 0 END AS recovery_per_retry,
    CASE WHEN retry_count > 0 THEN gross::DOUBLE / (retry_count * cost) ELSE 0 END AS roi
  FROM {source})
SELECT {', '.join(_SWEEP)}{extra} FROM r"""


@query("threshold_sweep", _sweep_sql("sweep WHERE cost = 50"))
def threshold_sweep(t: Tables) -> DataFrame:
    return S.threshold_sweep(t.scored).selectExpr(*_SWEEP)


@query("optimal_threshold", _sweep_sql("best WHERE cost = 50"))
def optimal_threshold(t: Tables) -> DataFrame:
    return S.optimal_threshold(S.threshold_sweep(t.scored)).selectExpr(*_SWEEP)


@query("cost_sensitivity", f"""
SELECT CASE cost WHEN 10 THEN 'LOW COST' WHEN 50 THEN 'BASE COST' ELSE 'HIGH COST' END AS cost_scenario,
  cost::DOUBLE AS retry_cost, threshold AS optimal_threshold, {money('net', 'expected_net_recovery')},
  {digits('retry_count::DOUBLE / total_payments * 100', 'retry_percentage')} FROM best""")
def cost_sensitivity(t: Tables) -> DataFrame:
    return S.cost_sensitivity(t.scored).selectExpr(
        "cost_scenario", "cast(retry_cost as double) retry_cost", "optimal_threshold",
        money("expected_net_recovery"), digits("retry_percentage"))


@query("strategy_comparison", _rows_sql(50, _BASE_T) + f"SELECT {', '.join(_ROW)} FROM rows")
def strategy_comparison(t: Tables) -> DataFrame:
    return S.strategy_comparison(t.scored).selectExpr(*_ROW)


@query("strategy_what_if", _rows_sql(250, "0.3::DOUBLE") + f"SELECT {', '.join(_ROW)} FROM rows")
def strategy_what_if(t: Tables) -> DataFrame:
    """Another retry cost and a chosen threshold."""
    return S.strategy_comparison(
        t.scored, CostModel().with_retry_cost(250.0), 0.3).selectExpr(*_ROW)


@query("strategy_comparison_long", _rows_sql(50, _BASE_T) + f"""
SELECT strategy, 'expected_recovery' AS metric, {money('expected_recovery', 'value')} FROM rows
UNION ALL SELECT strategy, 'action_cost', {money('action_cost', 'value')} FROM rows
UNION ALL SELECT strategy, 'expected_net_recovery', {money('expected_net_recovery', 'value')} FROM rows""")
def strategy_comparison_long(t: Tables) -> DataFrame:
    return S.comparison_long(S.strategy_comparison(t.scored)).selectExpr(
        "strategy", "metric", money("value"))
