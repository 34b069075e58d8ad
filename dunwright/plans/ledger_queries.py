"""Outcome ledgers, strategy benchmark and its deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import CostModel
from ..operators import ledger as L
from ..operators.lookup import action_dimension, join_actions
from ..operators.ordering import materialize
from ..operators.strategy import optimal_threshold_value
from .registry import Tables, digits, money, query, whole

_LEDGER_SQL = """, choices AS (
  SELECT s.*, v.strategy, CASE v.strategy WHEN 'Blind Retry' THEN 'Retry Payment'
      WHEN 'Current Rule-Based Strategy' THEN recommended_action
      ELSE CASE WHEN p >= (SELECT threshold FROM best WHERE cost = 50) THEN 'Retry Payment'
        ELSE 'Do Nothing' END END AS simulated_action
  FROM scored s, (VALUES ('Blind Retry'), ('Current Rule-Based Strategy'),
    ('Optimized Selective Strategy')) v(strategy)
), priced AS (
  SELECT *, CASE simulated_action WHEN 'Retry Payment' THEN 50 WHEN 'Payment Method Reminder' THEN 1
      WHEN 'Do Nothing' THEN 0 ELSE 100 END AS action_cost,
    CASE simulated_action WHEN 'Retry Payment' THEN 1.0 WHEN 'Payment Method Reminder' THEN 0.50
      WHEN 'Do Nothing' THEN 0.0 ELSE 0.75 END AS effect
  FROM choices
), ledger AS (
  SELECT *, (draw < (recovery_probability * effect)::DOUBLE)::INT AS hit,
    (recovered = 1 AND effect > 0)::INT AS real_hit FROM priced
)"""


def _metrics_sql(hit: str, source: str) -> str:
    return _LEDGER_SQL + f""", m AS (
  SELECT strategy, '{source}' AS outcome_source, count(*) AS total_payments,
    count(*) FILTER (WHERE simulated_action = 'Retry Payment') AS retry_count,
    count(*) FILTER (WHERE simulated_action = 'Payment Method Reminder') AS reminder_count,
    count(*) FILTER (WHERE simulated_action LIKE 'Manual Review%') AS manual_review_count,
    sum({hit})::BIGINT AS recovery_count,
    sum(CASE WHEN {hit} = 1 THEN payment_amount ELSE 0 END) AS gross,
    sum(action_cost) AS cost, sum(payment_amount) AS at_risk
  FROM ledger GROUP BY strategy)
SELECT strategy, outcome_source, total_payments, retry_count, reminder_count, manual_review_count,
  recovery_count, {money('gross', 'gross_simulated_recovered_revenue')},
  {money('cost', 'total_action_cost')}, {money('gross - cost', 'net_recovered_revenue')},
  {digits('retry_count::DOUBLE / total_payments', 'retry_rate')},
  {digits('recovery_count::DOUBLE / total_payments', 'simulated_recovery_rate')},
  {digits('gross::DOUBLE / at_risk::DOUBLE', 'revenue_recovery_rate')},
  {digits('cost::DOUBLE / recovery_count', 'recovery_cost_per_recovered_payment')},
  {digits('(gross - cost)::DOUBLE / cost::DOUBLE', 'roi')} FROM m"""


_METRICS = ["strategy", "outcome_source", "total_payments", "retry_count", "reminder_count",
            "manual_review_count", whole("recovery_count"),
            money("gross_simulated_recovered_revenue"), money("total_action_cost"),
            money("net_recovered_revenue"), digits("retry_rate"), digits("simulated_recovery_rate"),
            digits("revenue_recovery_rate"), digits("recovery_cost_per_recovered_payment"),
            digits("roi")]


def _ledger(t: Tables, observed: bool = False) -> DataFrame:
    return L.outcome_ledger(t.scored_table, optimal_threshold_value(t.scored_table), observed=observed)


@query("outcome_ledger", _LEDGER_SQL + f"""
SELECT payment_id, strategy, simulated_action, effect::DOUBLE AS action_effectiveness,
  action_cost::DOUBLE AS action_cost, (recovery_probability * effect)::DOUBLE AS effective_recovery_probability,
  {whole('hit', 'simulated_recovered')},
  {money('CASE WHEN hit = 1 THEN payment_amount ELSE 0 END', 'simulated_recovered_revenue')},
  {money('CASE WHEN hit = 1 THEN payment_amount ELSE 0 END - action_cost', 'net_recovered_revenue')}
FROM ledger""")
def outcome_ledger(t: Tables) -> DataFrame:
    return _ledger(t).selectExpr(
        "payment_id", "strategy", "simulated_action",
        "cast(action_effectiveness as double) action_effectiveness",
        "cast(action_cost as double) action_cost",
        "cast(effective_recovery_probability as double) effective_recovery_probability",
        whole("simulated_recovered"), money("simulated_recovered_revenue"),
        money("net_recovered_revenue"))


@query("outcome_metrics", _metrics_sql("hit", "SIMULATED"))
def outcome_metrics(t: Tables) -> DataFrame:
    return L.outcome_metrics(_ledger(t)).selectExpr(*_METRICS)


@query("observed_outcome_metrics", _metrics_sql("real_hit", "REAL"))
def observed_outcome_metrics(t: Tables) -> DataFrame:
    return L.outcome_metrics(_ledger(t, observed=True)).selectExpr(*_METRICS)


@query("action_lookup", f"""
SELECT recommended_action, count(*) AS payments,
  {money("sum(CASE priority WHEN 'HIGH' THEN 50 WHEN 'MEDIUM' THEN 1 ELSE 100 END)", 'cost')},
  {money("sum(expected_recovery * (CASE priority WHEN 'HIGH' THEN 1.00 WHEN 'MEDIUM' THEN 0.50 ELSE 0.75 END))",
         'effective_value')}
FROM scored GROUP BY recommended_action""")
def action_lookup(t: Tables) -> DataFrame:
    """The action table as a joined dimension."""
    actions = action_dimension(t.spark, CostModel().simulator_actions())
    return join_actions(t.scored, "recommended_action", actions).groupBy("recommended_action").agg(
        *[F.expr(e) for e in ("count(1) payments", money("sum(cost)", "cost"),
                              money("sum(expected_recovery * multiplier)", "effective_value"))])


@query("same_population", _LEDGER_SQL + """, a AS (
  SELECT payment_id FROM ledger WHERE strategy = 'Blind Retry'
), b AS (SELECT payment_id FROM ledger WHERE strategy = 'Current Rule-Based Strategy'), d AS (
  (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT 'Blind Retry' AS left_side, 'Current Rule-Based Strategy' AS right_side,
  count(*) AS surplus_keys FROM d""")
def same_population(t: Tables) -> DataFrame:
    ledger = _ledger(t)
    side = lambda s: ledger.filter(F.col("strategy") == s)
    left, right = L.SIMULATED_STRATEGIES[:2]
    return L.same_population(side(left), side(right)).agg(
        F.expr("count(1) surplus_keys")).selectExpr(
        f"'{left}' left_side", f"'{right}' right_side", "surplus_keys")


_BENCH_SQL = """, picked AS (
  SELECT s.*, v.strategy, v.strategy LIKE 'D.%' AS bounded, CASE substr(v.strategy, 1, 1)
      WHEN 'A' THEN 'Retry Payment'
      WHEN 'B' THEN CASE priority WHEN 'LOW' THEN 'Stop Automatic Recovery' ELSE recommended_action END
      WHEN 'C' THEN CASE WHEN p >= (SELECT threshold FROM best WHERE cost = 50) THEN 'Retry Payment'
        ELSE 'Stop Automatic Recovery' END
      ELSE selected_action END AS action
  FROM policed s, (VALUES ('A. Blind Retry'), ('B. Current Rule-Based'), ('C. Optimized Selective'),
    ('D. Bounded Recovery Orchestrator')) v(strategy)
), run AS (
  SELECT *, NOT bounded OR policy_decision = 'ALLOWED' AS executed FROM picked
), paid AS (
  SELECT *, executed AND recovered = 1
      AND action IN ('Retry Payment', 'Payment Method Reminder', 'Manual Review') AS hit,
    CASE WHEN NOT executed THEN 0 WHEN action = 'Retry Payment' THEN 50
      WHEN action = 'Payment Method Reminder' THEN 1 WHEN action = 'Manual Review' THEN 100 ELSE 0 END AS cost
  FROM run
), bench AS (
  SELECT strategy, count(*) AS total_payments, count(*) FILTER (WHERE hit) AS recovered_payments,
    sum(payment_amount) AS at_risk, sum(CASE WHEN hit THEN payment_amount ELSE 0 END) AS gross,
    sum(cost) AS cost,
    count(*) FILTER (WHERE action = 'Retry Payment') AS retry_count,
    count(*) FILTER (WHERE action = 'Payment Method Reminder') AS reminder_count,
    count(*) FILTER (WHERE action = 'Manual Review') AS manual_review_count,
    count(*) FILTER (WHERE action NOT IN ('Retry Payment', 'Payment Method Reminder', 'Manual Review'))
      AS stopped_count,
    count(*) FILTER (WHERE executed) AS verified_outcome_count,
    coalesce(max(CASE WHEN bounded THEN recovery_attempts_so_far END), 0)::BIGINT
      AS maximum_existing_attempts_observed,
    count(*) FILTER (WHERE bounded AND reason_code = 'LOW_PROBABILITY') AS stopped_by_prob_threshold,
    count(*) FILTER (WHERE bounded AND reason_code = 'LOW_VALUE') AS stopped_by_econ_viability,
    count(*) FILTER (WHERE bounded AND reason_code = 'HIGH_VALUE') AS routed_to_manual_review,
    count(*) FILTER (WHERE bounded AND reason_code = 'MAX_ATTEMPTS') AS stopped_by_max_attempts,
    count(*) FILTER (WHERE bounded AND executed) AS outcomes_verified,
    count(*) FILTER (WHERE bounded AND executed AND hit) AS outcomes_closed,
    count(*) FILTER (WHERE bounded AND (policy_decision = 'BLOCKED' OR executed AND NOT hit))
      AS outcomes_stopped,
    count(*) FILTER (WHERE bounded AND policy_decision = 'MANUAL_REVIEW') AS outcomes_manual_review,
    count(*) FILTER (WHERE bounded AND NOT executed) AS outcomes_pending
  FROM paid GROUP BY strategy
)"""
_GUARDS = ["maximum_existing_attempts_observed", "stopped_by_prob_threshold",
           "stopped_by_econ_viability", "routed_to_manual_review", "stopped_by_max_attempts",
           "outcomes_verified", "outcomes_closed", "outcomes_stopped", "outcomes_manual_review",
           "outcomes_pending"]
_COUNTS = ["total_payments", "recovered_payments", "retry_count", "reminder_count",
           "manual_review_count", "stopped_count", "verified_outcome_count", *_GUARDS]
_RATIOS = ["recovery_rate", "roi", "average_recovery_value", "average_action_cost",
           "verification_rate", "recovery_efficiency"]
_SUMS = ["total_payment_value", "revenue_at_risk", "simulated_recovered_revenue", "action_cost",
         "net_recovered_revenue"]


def _benchmark(t: Tables) -> DataFrame:
    cube = materialize(L.outcome_cube(t.scored))
    return L.observed_benchmark(cube, L.cube_threshold(cube))


@query("strategy_benchmark", _BENCH_SQL + f"""
SELECT strategy, {', '.join(_COUNTS)}, {money('at_risk', 'total_payment_value')},
  {money('at_risk', 'revenue_at_risk')}, {money('gross', 'simulated_recovered_revenue')},
  {money('cost', 'action_cost')}, {money('gross - cost', 'net_recovered_revenue')},
  {digits('recovered_payments::DOUBLE / total_payments', 'recovery_rate')},
  {digits('CASE WHEN cost > 0 THEN (gross - cost)::DOUBLE / cost::DOUBLE ELSE 0 END', 'roi')},
  {digits('gross::DOUBLE / total_payments', 'average_recovery_value')},
  {digits('cost::DOUBLE / total_payments', 'average_action_cost')},
  {digits('verified_outcome_count::DOUBLE / total_payments', 'verification_rate')},
  {digits('(gross - cost)::DOUBLE / at_risk::DOUBLE', 'recovery_efficiency')},
  2::BIGINT AS configured_maximum_automatic_attempts, 0::BIGINT AS invalid_state_transitions,
  'REAL' AS outcome_source FROM bench""")
def strategy_benchmark(t: Tables) -> DataFrame:
    return _benchmark(t).selectExpr(
        "strategy", *_COUNTS, *[money(c) for c in _SUMS], *[digits(c) for c in _RATIOS],
        "configured_maximum_automatic_attempts", "invalid_state_transitions", "outcome_source")


@query("guardrail_counts", _BENCH_SQL + f"""
SELECT strategy, {', '.join(_GUARDS)}, 2::BIGINT AS configured_maximum_automatic_attempts,
  0::BIGINT AS invalid_state_transitions FROM bench WHERE strategy LIKE 'D.%'""")
def guardrail_counts(t: Tables) -> DataFrame:
    return L.guardrail_counts(_benchmark(t))


@query("benchmark_deltas", _BENCH_SQL + f""", r AS (
  SELECT strategy, gross - cost AS net, recovered_payments::DOUBLE / total_payments AS rate, cost,
    retry_count, CASE WHEN cost > 0 THEN (gross - cost)::DOUBLE / cost::DOUBLE ELSE 0 END AS roi FROM bench)
SELECT a.strategy || ' vs ' || b.strategy AS comparison,
  {money('a.net - b.net', 'net_recovered_revenue_delta')}, {digits('a.rate - b.rate', 'recovery_rate_delta')},
  {money('a.cost - b.cost', 'action_cost_delta')}, {whole('a.retry_count - b.retry_count', 'retry_count_delta')},
  {digits('a.roi - b.roi', 'roi_delta')}
FROM r a, r b WHERE substr(a.strategy, 1, 1) || substr(b.strategy, 1, 1) IN ('CA', 'DA', 'DB', 'DC')""")
def benchmark_deltas(t: Tables) -> DataFrame:
    return L.benchmark_deltas(_benchmark(t)).selectExpr(
        "comparison", money("net_recovered_revenue_delta"), digits("recovery_rate_delta"),
        money("action_cost_delta"), whole("retry_count_delta"), digits("roi_delta"))


@query("overview_kpis", _BENCH_SQL + f"""
SELECT total_payments AS failed_payments, {money('at_risk', 'revenue_at_risk')},
  {digits('recovered_payments::DOUBLE / total_payments', 'simulated_recovery_rate')},
  {money('gross - cost', 'expected_net_revenue')} FROM bench WHERE strategy LIKE 'C.%'""")
def overview_kpis(t: Tables) -> DataFrame:
    """Headline numbers of the optimised selective strategy."""
    return _benchmark(t).filter("strategy = 'C. Optimized Selective'").selectExpr(
        "total_payments failed_payments", money("revenue_at_risk"),
        digits("recovery_rate", "simulated_recovery_rate"),
        money("net_recovered_revenue", "expected_net_revenue"))
