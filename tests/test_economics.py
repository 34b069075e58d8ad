"""Strategies, ledgers and benchmarks: literal cases and invariants."""

from dunwright.config import MANUAL_OR_STOP
from dunwright.operators import ledger as L, strategy as S
from dunwright.operators.decide import with_decisions
from tests.test_decisions import frame


def benchmark_frame(spark):
    return with_decisions(frame(spark, ("p1", 1000, 0.9, 0, 0), ("p2", 5000, 0.4, 1, 0),
                                ("p3", 30000, 0.01, 3, 0)))


def test_benchmark_rows(spark):
    rows = {r.strategy[0]: r for r in L.strategy_benchmark(
        L.benchmark_ledger(benchmark_frame(spark), 0.5)).collect()}
    assert set(rows) == set("ABCD")
    for r in rows.values():
        assert r.total_payments == 3 and r.revenue_at_risk == 36000
        assert 0 <= r.recovery_rate <= 1 and r.action_cost >= 0
        assert r.net_recovered_revenue == r.simulated_recovered_revenue - r.action_cost
        assert r.retry_count + r.reminder_count + r.manual_review_count + r.stopped_count == 3
    d = rows["D"]
    assert d.maximum_existing_attempts_observed == 3 and d.stopped_by_max_attempts == 1
    assert d.configured_maximum_automatic_attempts == 2
    assert d.outcomes_verified + d.outcomes_pending == 3
    assert rows["A"].retry_count == 3 and rows["A"].action_cost == 150 and len(d.asDict()) == 31


def test_benchmark_is_repeatable(spark):
    run = lambda: sorted(map(str, L.strategy_benchmark(
        L.benchmark_ledger(benchmark_frame(spark), 0.5)).collect()))
    assert run() == run()


def test_deltas_skip_missing_pairs(spark):
    df = spark.sql("""select * from values
        ('A. Blind Retry', 1000.0D, 0.5D, 100.0D, 10, 10.0D),
        ('C. Optimized Selective', 1200.0D, 0.4D, 50.0D, 5, 24.0D)
        t(strategy, net_recovered_revenue, recovery_rate, action_cost, retry_count, roi)""")
    rows = L.benchmark_deltas(df).collect()
    assert len(rows) == 1
    assert rows[0].comparison == "C. Optimized Selective vs A. Blind Retry"
    assert rows[0].net_recovered_revenue_delta == 200 and rows[0].action_cost_delta == -50


def test_ledger_invariants(spark, scored):
    ledger = L.outcome_ledger(scored, 0.2)
    assert ledger.filter("net_recovered_revenue <> simulated_recovered_revenue - action_cost").isEmpty()
    assert ledger.filter("effective_recovery_probability not between 0 and 1").isEmpty()
    assert ledger.filter("simulated_recovered = 0 and simulated_recovered_revenue <> 0").isEmpty()
    per = {r.strategy: r["count"] for r in ledger.groupBy("strategy").count().collect()}
    assert len(per) == 3 and len(set(per.values())) == 1
    # one draw per payment: a payment recovered by a weaker action is recovered by a retry
    by_action = ledger.select("payment_id", "strategy", "simulated_action", "simulated_recovered")
    blind = by_action.filter("strategy = 'Blind Retry'").selectExpr("payment_id", "simulated_recovered b")
    assert by_action.join(blind, "payment_id").filter("simulated_recovered > b").isEmpty()


def test_zero_cost_and_zero_amount(spark):
    df = spark.sql(f"""select 'x' strategy, 'SIMULATED' outcome_source, '{MANUAL_OR_STOP}' simulated_action,
        0 simulated_recovered, cast(0 as decimal(14,2)) simulated_recovered_revenue,
        cast(0 as decimal(10,2)) action_cost, cast(0 as decimal(14,2)) net_recovered_revenue,
        cast(0 as decimal(14,2)) payment_amount""")
    row = L.outcome_metrics(df).collect()[0]
    assert row.roi == 0 and row.revenue_recovery_rate == 0
    assert row.recovery_cost_per_recovered_payment == 0


def test_real_and_simulated_stay_apart(spark, scored):
    both = L.outcome_ledger(scored, 0.2).unionByName(L.outcome_ledger(scored, 0.2, observed=True))
    rows = L.outcome_metrics(both).collect()
    assert sorted({r.outcome_source for r in rows}) == ["REAL", "SIMULATED"] and len(rows) == 6


def test_sweep_shape(spark, scored):
    rows = S.threshold_sweep(scored).orderBy("threshold").collect()
    assert len(rows) == 20 and rows[3].threshold == 3 * 0.05
    assert [r.retry_count for r in rows] == sorted((r.retry_count for r in rows), reverse=True)
    best = S.optimal_threshold(S.threshold_sweep(scored)).collect()[0]
    assert best.expected_net_recovery == max(r.expected_net_recovery for r in rows)


def test_sweep_of_nothing(spark, scored):
    rows = S.threshold_sweep(scored.limit(0)).collect()
    assert len(rows) == 20 and all(r.retry_count == 0 and r.roi == 0 for r in rows)


def test_free_retries_have_no_roi(spark, scored):
    row = S.selective_retry(scored, 0.0, 0.0).collect()[0]
    assert row.roi == 0 and row.recovery_per_retry > 0


def test_rule_based_recovers_less_than_blind(spark, scored):
    rows = {r.strategy: r for r in S.strategy_comparison(scored).collect()}
    assert rows["Current Rule-Based"].expected_recovery < rows["Blind Retry"].expected_recovery


def test_forbidden_state_changes_are_counted(spark):
    from dunwright.functions.decisions import invalid_steps

    paths = spark.sql("select array('FAILED', 'CLOSED') p union all select array('FAILED', 'ASSESSED', 'STOPPED') "
                      "union all select array('FAILED', 'NOWHERE', 'CLOSED') union all select array('FAILED')")
    assert [r.n for r in paths.selectExpr(f"{invalid_steps('p')} n").collect()] == [1, 0, 2, 0]
