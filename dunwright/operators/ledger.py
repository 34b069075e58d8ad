"""Outcome ledgers and strategy benchmarks.

Every payment meets every strategy, but only as an array of a few structs exploded
inside the scan stage; the aggregation by strategy combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import (
    BENCHMARK_ACTIONS, DO_NOTHING, MANUAL_OR_STOP, MANUAL_REVIEW, REMINDER, RETRY, STOP,
    CostModel, PolicyConfig,
)
from ..functions import decisions as D
from ..functions.scalars import clip, dec, double, keyed_uniform, ratio, text, texts
from .lookup import action_value, rows_of
from .strategy import THRESHOLDS, optimal_threshold, sweep_profile

# Strategy names as reported.
SIMULATED_STRATEGIES = (
    "Blind Retry", "Current Rule-Based Strategy", "Optimized Selective Strategy")
BENCHMARK_STRATEGIES = (
    "A. Blind Retry", "B. Current Rule-Based", "C. Optimized Selective",
    "D. Bounded Recovery Orchestrator")
COMPARED_PAIRS = (
    ("C. Optimized Selective", "A. Blind Retry"),
    ("D. Bounded Recovery Orchestrator", "A. Blind Retry"),
    ("D. Bounded Recovery Orchestrator", "B. Current Rule-Based"),
    ("D. Bounded Recovery Orchestrator", "C. Optimized Selective"),
)


def _with_threshold(scored: DataFrame, threshold: Column | float) -> DataFrame:
    value = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.withColumn("_threshold", value)


def strategy_action(strategy: str) -> str:
    """Action a simulated strategy takes, from recovery_probability and _threshold."""
    p = "recovery_probability"
    if strategy == SIMULATED_STRATEGIES[0]:
        return text(RETRY)
    if strategy == SIMULATED_STRATEGIES[1]:
        return D.recommended_action(p)
    if strategy == SIMULATED_STRATEGIES[2]:
        return f"case when {p} >= _threshold then {text(RETRY)} else {text(DO_NOTHING)} end"
    raise ValueError(f"Unknown strategy: {strategy}")


def outcome_ledger(scored: DataFrame, threshold: Column | float,
                   strategies: tuple[str, ...] = SIMULATED_STRATEGIES,
                   costs: CostModel = CostModel(), observed: bool = False) -> DataFrame:
    """One row per payment and strategy, all strategies sharing one draw per payment.

    With ``observed`` the draw is replaced by the label ``recovered`` and the rows
    carry ``outcome_source`` REAL; simulated and real rows must never be summed together.
    """
    table = costs.simulator_actions()
    choices = ", ".join(
        f"named_struct('strategy', {text(s)}, 'simulated_action', {strategy_action(s)})"
        for s in strategies)
    effective = clip("cast(recovery_probability as decimal(7,6)) * action_effectiveness", 0.0, 1.0)
    hit = ("recovered = 1 and action_effectiveness > 0" if observed
           else "_draw < cast(effective_recovery_probability as double)")
    draw = "0.0D" if observed else keyed_uniform("payment_id")
    return (
        _with_threshold(scored, threshold)
        .selectExpr("*", f"{draw} _draw")
        .selectExpr("*", f"inline(array({choices}))")
        .selectExpr(
            "* except (_threshold)",
            f"{action_value('simulated_action', table, 1, 3, None)} action_effectiveness",
            f"{action_value('simulated_action', table, 0, 10, None)} action_cost")
        .selectExpr("*", f"cast({effective} as decimal(11,8)) effective_recovery_probability")
        .selectExpr("* except (_draw)", f"cast({hit} as int) simulated_recovered")
        .selectExpr("*", f"case when simulated_recovered = 1 then payment_amount else {dec(0)} end "
                         "simulated_recovered_revenue")
        .selectExpr("*", "simulated_recovered_revenue - action_cost net_recovered_revenue",
                    f"'{'REAL' if observed else 'SIMULATED'}' outcome_source"))


def outcome_metrics(ledger: DataFrame) -> DataFrame:
    """Report per strategy and outcome source."""
    counted = lambda action, name: f"count_if(simulated_action = {text(action)}) {name}"
    sums = ledger.groupBy("strategy", "outcome_source").agg(*[F.expr(e) for e in (
        "count(1) total_payments", counted(RETRY, "retry_count"),
        counted(REMINDER, "reminder_count"), counted(MANUAL_OR_STOP, "manual_review_count"),
        "sum(simulated_recovered) recovery_count",
        "sum(simulated_recovered_revenue) gross_simulated_recovered_revenue",
        "sum(action_cost) total_action_cost", "sum(net_recovered_revenue) net_recovered_revenue",
        "sum(payment_amount) _at_risk")])
    gross, cost = "gross_simulated_recovered_revenue", "total_action_cost"
    return sums.selectExpr(
        "* except (_at_risk)",
        f"{ratio('retry_count', 'total_payments')} retry_rate",
        f"{ratio('recovery_count', 'total_payments')} simulated_recovery_rate",
        f"{ratio(gross, '_at_risk')} revenue_recovery_rate",
        f"{ratio(cost, 'recovery_count')} recovery_cost_per_recovered_payment",
        f"{ratio(f'{gross} - {cost}', cost)} roi")


def benchmark_ledger(scored: DataFrame, threshold: Column | float,
                     config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Payments × the four benchmark strategies with keyed outcomes."""
    p = "recovery_probability"
    recommended = "recommended_action" if "recommended_action" in scored.columns else text(RETRY)
    verdict = D.policy(p, "recovery_attempts_so_far", "payment_amount", D.payment_value(),
                       recommended, config)
    choice = lambda name, action, decision, code: (
        f"named_struct('strategy', {text(name)}, 'action', {action}, "
        f"'policy_decision', {decision}, 'reason_code', {code})")
    none = "cast(null as string)"
    a, b, c, d = BENCHMARK_STRATEGIES
    choices = ", ".join([
        choice(a, text(RETRY), none, none),
        choice(b, D.band(p, RETRY, REMINDER, STOP), none, none),
        choice(c, f"case when {p} >= _threshold then {text(RETRY)} else {text(STOP)} end", none, none),
        choice(d, "_policy.selected_action", "_policy.policy_decision", "_policy.reason_code")])
    executed = "(policy_decision is null or policy_decision = 'ALLOWED')"
    chance = f"cast({p} * {action_value('action', BENCHMARK_ACTIONS, 1, 3)} as double)"
    return (
        _with_threshold(scored, threshold)
        .selectExpr("payment_id", "payment_amount", p, "recovery_attempts_so_far", "_threshold",
                    f"{verdict} _policy", f"{keyed_uniform('payment_id')} _draw")
        .selectExpr("payment_id", "payment_amount", p, "recovery_attempts_so_far", "_draw",
                    f"inline(array({choices}))")
        .selectExpr(
            "* except (_draw)", f"{executed} verified",
            f"{executed} and _draw < {chance} recovered_flag",
            f"case when {executed} then {action_value('action', BENCHMARK_ACTIONS, 0)} "
            f"else {dec(0, 10, 2)} end action_cost")
        .selectExpr(
            "*", f"case when recovered_flag then payment_amount else {dec(0)} end recovered_amount",
            "case when policy_decision is not null then "
            f"{D.state_path('policy_decision', 'recovered_flag')} end state_history")
        .selectExpr("* except (state_history)", "element_at(state_history, -1) final_state",
                    f"if(state_history is null, 0, {D.invalid_steps('state_history')}) invalid_steps"))


def outcome_cube(scored: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Observed outcomes counted by everything a strategy can depend on, in one pass over the payments.

    A row for every (thresholds reached, band's action, policy verdict, label): some hundreds, whatever the
    size of the input.  Strategies are folds of these rows; nothing is multiplied or drawn.
    """
    p = "recovery_probability"
    recommended = "recommended_action" if "recommended_action" in scored.columns else text(RETRY)
    verdict = D.policy(p, "recovery_attempts_so_far", "payment_amount", D.payment_value(), recommended, config)
    steps = ", ".join(map(double, THRESHOLDS))
    return scored.selectExpr(
        "payment_amount", f"{D.payment_value()} v", "recovery_attempts_so_far attempts",
        "coalesce(recovered = 1, false) recovered", f"{verdict} _policy",
        f"size(filter(array({steps}), t -> cast({p} as double) >= t)) bucket",
        f"{D.band(p, RETRY, REMINDER, STOP)} band_action").groupBy(
        "bucket", "band_action", "_policy.policy_decision", "_policy.selected_action", "_policy.reason_code",
        "recovered").agg(*[F.expr(e) for e in (
            "count(1) n", "sum(payment_amount) amount", "sum(v) v", "max(attempts) attempts")])


def cube_threshold(cube: DataFrame, cost: float = 50.0) -> Column:
    """The best retry threshold as a scalar subquery on the cube."""
    best = optimal_threshold(sweep_profile(cube.select("bucket", "n", "v"), (cost,)))
    return best.select("threshold").scalar()


def observed_benchmark(cube: DataFrame, threshold: Column | float,
                       config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """The benchmark row of each strategy on observed outcomes (``outcome_source`` REAL).

    A payment counts as recovered under a strategy when it was recovered and the strategy's action is
    executed and can recover at all.
    """
    a, b, c, d = BENCHMARK_STRATEGIES
    none = "cast(null as string)"
    choice = lambda name, action, *verdict: (
        f"struct({text(name)} as strategy, {action} as action, {verdict[0] if verdict else none} as decision,"
        f" {verdict[1] if verdict else none} as code)")
    choices = ", ".join([
        choice(a, text(RETRY)), choice(b, "band_action"),
        choice(c, f"if(bucket >= _reached, {text(RETRY)}, {text(STOP)})"),
        choice(d, "selected_action", "policy_decision", "reason_code")])
    reached = ", ".join(map(double, THRESHOLDS))
    path = D.state_path("decision", "hit")
    rows = (
        _with_threshold(cube, threshold)
        .selectExpr("*", f"size(filter(array({reached}), t -> t <= _threshold)) _reached")
        .selectExpr("n", "amount", "attempts", "recovered", f"inline(array({choices}))")
        .selectExpr("*", "decision is null or decision = 'ALLOWED' executed")
        .selectExpr(
            "*", f"executed and recovered and {action_value('action', BENCHMARK_ACTIONS, 1, 3)} > 0 hit",
            f"case when executed then {action_value('action', BENCHMARK_ACTIONS, 0)} else {dec(0, 10, 2)} end cost")
        .selectExpr("*", f"case when decision is not null then {path} end path")
        .selectExpr("* except (path)", "element_at(path, -1) final_state",
                    f"if(path is null, 0, {D.invalid_steps('path')}) invalid_steps"))
    counted = lambda condition: f"coalesce(sum(case when {condition} then n end), 0L)"
    bounded = "decision is not null"
    sums = rows.groupBy("strategy").agg(*[F.expr(e) for e in (
        "sum(n) total_payments",
        f"{counted('hit')} recovered_payments",
        "sum(amount) total_payment_value",
        f"coalesce(sum(case when hit then amount end), {dec(0)}) simulated_recovered_revenue",
        "sum(cost * n) action_cost",
        f"{counted(f'action = {text(RETRY)}')} retry_count",
        f"{counted(f'action = {text(REMINDER)}')} reminder_count",
        f"{counted(f'action = {text(MANUAL_REVIEW)}')} manual_review_count",
        f"{counted(f'action not in ({texts((RETRY, REMINDER, MANUAL_REVIEW))})')} stopped_count",
        f"{counted('executed')} verified_outcome_count",
        f"coalesce(cast(max(case when {bounded} then attempts end) as bigint), 0L) "
        "maximum_existing_attempts_observed",
        *[f"{counted(condition)} {name}" for name, condition in (
            ("stopped_by_prob_threshold", "code = 'LOW_PROBABILITY'"),
            ("stopped_by_econ_viability", "code = 'LOW_VALUE'"),
            ("routed_to_manual_review", "decision = 'MANUAL_REVIEW'"),
            ("stopped_by_max_attempts", "code = 'MAX_ATTEMPTS'"),
            ("outcomes_verified", f"{bounded} and executed"),
            ("outcomes_closed", "final_state = 'CLOSED'"),
            ("outcomes_stopped", "final_state = 'STOPPED'"),
            ("outcomes_manual_review", "final_state = 'MANUAL_REVIEW'"),
            ("outcomes_pending", f"{bounded} and not executed"))],
        "sum(invalid_steps * n) invalid_state_transitions")])
    return _benchmark_columns(sums, config).selectExpr("*", "'REAL' outcome_source")


def strategy_benchmark(ledger: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """The 31-column benchmark row of each strategy."""
    bounded = "policy_decision is not null"
    sums = ledger.groupBy("strategy").agg(*[F.expr(e) for e in (
        "count(1) total_payments",
        "count_if(recovered_flag) recovered_payments",
        "sum(payment_amount) total_payment_value",
        "sum(recovered_amount) simulated_recovered_revenue",
        "sum(action_cost) action_cost",
        f"count_if(action = {text(RETRY)}) retry_count",
        f"count_if(action = {text(REMINDER)}) reminder_count",
        f"count_if(action = {text(MANUAL_REVIEW)}) manual_review_count",
        f"count_if(action not in ({texts((RETRY, REMINDER, MANUAL_REVIEW))})) stopped_count",
        "count_if(verified) verified_outcome_count",
        f"coalesce(cast(max(case when {bounded} then recovery_attempts_so_far end) as bigint), 0L) "
        "maximum_existing_attempts_observed",
        "count_if(reason_code = 'LOW_PROBABILITY') stopped_by_prob_threshold",
        "count_if(reason_code = 'LOW_VALUE') stopped_by_econ_viability",
        "count_if(policy_decision = 'MANUAL_REVIEW') routed_to_manual_review",
        "count_if(reason_code = 'MAX_ATTEMPTS') stopped_by_max_attempts",
        f"count_if({bounded} and verified) outcomes_verified",
        "count_if(final_state = 'CLOSED') outcomes_closed",
        "count_if(final_state = 'STOPPED') outcomes_stopped",
        "count_if(final_state = 'MANUAL_REVIEW') outcomes_manual_review",
        f"count_if({bounded} and not verified) outcomes_pending",
        "sum(invalid_steps) invalid_state_transitions")])
    return _benchmark_columns(sums, config)


def _benchmark_columns(sums: DataFrame, config: PolicyConfig) -> DataFrame:
    net, at_risk = "simulated_recovered_revenue - action_cost", "total_payment_value"
    return sums.selectExpr(
        "*", f"{at_risk} revenue_at_risk", f"{net} net_recovered_revenue",
        f"{ratio('recovered_payments', 'total_payments')} recovery_rate",
        f"{ratio(net, 'action_cost')} roi",
        f"{ratio('simulated_recovered_revenue', 'total_payments')} average_recovery_value",
        f"{ratio('action_cost', 'total_payments')} average_action_cost",
        f"{ratio('verified_outcome_count', 'total_payments')} verification_rate",
        f"{ratio(net, at_risk)} recovery_efficiency",
        f"{config.max_recovery_attempts}L configured_maximum_automatic_attempts")


def guardrail_counts(benchmark: DataFrame) -> DataFrame:
    """Guardrail columns of the bounded strategy."""
    return benchmark.filter(F.col("strategy") == BENCHMARK_STRATEGIES[3]).select(
        "strategy", "maximum_existing_attempts_observed", "configured_maximum_automatic_attempts",
        "stopped_by_prob_threshold", "stopped_by_econ_viability", "routed_to_manual_review",
        "stopped_by_max_attempts", "invalid_state_transitions", "outcomes_verified",
        "outcomes_closed", "outcomes_stopped", "outcomes_manual_review", "outcomes_pending")


def benchmark_deltas(benchmark: DataFrame) -> DataFrame:
    """Differences for the compared pairs; a pair with a missing side is left out.

    Each benchmark row is handed to the few pairs it takes part in, as plus or minus
    side, so the benchmark is computed once.
    """
    measures = ("net_recovered_revenue", "recovery_rate", "action_cost", "retry_count", "roi")
    sides = rows_of(benchmark.sparkSession, "comparison, strategy, sign", [
        (f"{left} vs {right}", name, sign)
        for left, right in COMPARED_PAIRS for name, sign in ((left, 1), (right, -1))])
    summed = benchmark.join(F.broadcast(sides), "strategy").groupBy("comparison").agg(
        F.expr("count(1) _sides"), *[F.expr(f"sum(sign * {m}) {m}_delta") for m in measures])
    return summed.filter("_sides = 2").drop("_sides")


def same_population(left: DataFrame, right: DataFrame, key: str = "payment_id") -> DataFrame:
    """Keys present more often on one side than the other; empty for one population."""
    counts = left.selectExpr(key, "1 d").unionByName(right.selectExpr(key, "-1 d")).groupBy(key).agg(
        F.expr("sum(d) surplus"))
    return counts.filter("surplus <> 0")
