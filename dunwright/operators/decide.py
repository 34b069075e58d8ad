"""Row-level decisions: scoring, bounded policy, traces and full responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import BENCHMARK_ACTIONS, DEFAULT_STRATEGY, Bands, PolicyConfig, TraceConfig
from ..functions import decisions as D, validation as V
from ..functions.scalars import (
    audit_id, dec, join_factors, keyed_uniform, stable_id, text, truthy, utc_text,
)
from .lookup import action_value
from .ordering import materialize
from .prioritize import with_priority


def drop_identifiers(df: DataFrame) -> DataFrame:
    """Model inputs only: ids and the target go, when they are there."""
    return df.drop("payment_id", "customer_id", "recovered")


def with_decisions(df: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Expected value, priority and action from ``recovery_probability``."""
    p = "recovery_probability"
    return df.selectExpr(
        "*",
        f"{D.expected_recovery('payment_amount', p)} expected_recovery",
        f"{D.priority_band(p, bands)} priority",
        f"{D.recommended_action(p, bands)} recommended_action")


def score_payments(df: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Score with the published scorecard and attach the decision columns."""
    return with_decisions(
        df.selectExpr("*", f"{D.scorecard_probability()} recovery_probability"), bands)


def score_with_probability(df: DataFrame, probability: str, bands: Bands = Bands()) -> DataFrame:
    """Attach decisions to a model's probability (SQL text, see ``compiled.model_sql``).

    An output that is no number gives a NULL probability.
    """
    return with_decisions(df.withColumn("recovery_probability", F.expr(
        f"try_cast(round(try_cast({probability} as double), 6) as decimal(7,6))")), bands)


def apply_policy(scored: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Bounded policy columns: decision, selected action, reason, code, attempt number."""
    verdict = D.policy("recovery_probability", "recovery_attempts_so_far", "payment_amount",
                       "expected_recovery", "recommended_action", config)
    return scored.selectExpr("*", f"{verdict} _policy").selectExpr(
        "* except (_policy)", "_policy.*",
        f"{D.attempt_number('recovery_attempts_so_far', '_policy.policy_decision')} attempt_number")


def run_bounded_recovery(scored: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Policy, keyed outcome draw, verification and the state path of every payment.

    A recommended action without economics ('Manual Review / Stop Automatic Retry')
    is executed at zero cost and recovers nothing.
    """
    allowed = "policy_decision = 'ALLOWED'"
    chance = ("cast(recovery_probability * "
              f"{action_value('selected_action', BENCHMARK_ACTIONS, 1, 3)} as double)")
    cost = action_value("selected_action", BENCHMARK_ACTIONS, 0)
    return (
        apply_policy(scored, config)
        .selectExpr(
            "*",
            f"{allowed} and {keyed_uniform('payment_id')} < {chance} simulated_recovered",
            f"case when {allowed} then {cost} else {dec(0, 10, 2)} end action_cost",
            "'FAILED' initial_state",
            f"case when {allowed} then 'VERIFIED' else 'PENDING' end verification_status")
        .selectExpr(
            "*",
            f"case when simulated_recovered then payment_amount else {dec(0)} end recovered_amount",
            f"{D.state_path('policy_decision', 'simulated_recovered')} state_history")
        .selectExpr(
            "*", "recovered_amount - action_cost net_recovered_revenue",
            "element_at(state_history, -1) final_state"))


def decision_trace(scored: DataFrame, config: TraceConfig = TraceConfig()) -> DataFrame:
    """Explanation columns of a scored payment."""
    return scored.selectExpr(
        "*",
        f"{dec(config.decision_threshold, 5, 4)} selected_threshold",
        f"{dec(config.effective_retry_cost, 10, 2)} effective_retry_cost",
        f"{D.retry_net_value('expected_recovery', config)} expected_retry_net_value",
        f"{D.decision_reason('recommended_action', 'expected_recovery', config)} decision_reason",
        f"{D.key_input_factors(scored.columns)} key_input_factors")


def resolve_idempotency(df: DataFrame) -> DataFrame:
    """Key and its source: caller key, else event id, else a fresh UUID.

    The UUID differs on every evaluation; write the result before using it twice.
    """
    have = lambda c: truthy(c) if c in df.columns else "cast(null as string)"
    supplied, event = have("idempotency_key"), have("event_id")
    return df.withColumns({
        "idempotency_key_source": F.expr(
            f"case when {supplied} is not null then 'caller_supplied' "
            f"when {event} is not null then 'event_id_fallback' "
            "else 'request_scoped_fallback' end"),
        "idempotency_key": F.expr(f"coalesce({supplied}, {event}, uuid())"),
    })


def validate(df: DataFrame) -> DataFrame:
    """Add ``errors`` (array of messages) and ``is_valid`` to a typed table."""
    return V.with_errors(df, V.typed_fields(df))


def parse_events(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON text rows to validated, typed event rows; the raw payload is kept.

    Anything a cast here turns into NULL has been reported by the validation before.
    """
    number = V.JSON_FIELDS.number
    whole = lambda n: f"cast(case when abs({number(n)}) < 2e9D then {number(n)} end as int) {n}"
    keep = [c for c in raw.columns if c != value]
    return V.with_errors(V.unpack_json(raw, value), V.JSON_FIELDS).selectExpr(
        *keep, f"{value} raw_event_payload", "errors", "is_valid",
        *[f"try_variant_get(_record['{n}'], '$', 'string') {n}" for n in (
            "payment_id", "customer_id", "event_id", "idempotency_key")],
        "_failure_reason.shown failure_reason", "_payment_method.shown payment_method",
        f"try_cast(round({number('payment_amount')}, 2) as decimal(14,2)) payment_amount",
        *[f"{number(n)} {n}" for n in (
            "historical_success_rate", "customer_tenure_months", "time_since_last_success_days",
            "days_overdue")],
        *[whole(n) for n in ("past_successful_payments", "past_failed_payments",
                             "recovery_attempts_so_far", "is_subscription")])


_ANSWER = ("struct<recommended_action:string,recovery_priority:string,"
           "model_probability:double,expected_recovery:double>")


def respond(events: DataFrame, known: DataFrame | None = None,
            trace: TraceConfig = TraceConfig(), policy: PolicyConfig = PolicyConfig(),
            model_version: str = "unversioned", probability: str | None = None,
            order: tuple[str, ...] | None = None, strategy: str = DEFAULT_STRATEGY,
            answered_at: str | None = None) -> DataFrame:
    """One nested response per validated event (success, error or duplicate).

    ``known`` holds stored decisions by ``idempotency_key`` (see ``store.stored_decisions``); events found
    there answer with the stored decision.  With ``order`` (columns that order the feed) an event that
    comes after an answered one of the same key answers with that one's decision.  ``probability``
    is a model as SQL text; without it the scorecard decides.  ``answered_at`` is a moment in ISO text.
    """
    model = probability or D.scorecard_probability()
    resolved = resolve_idempotency(events).selectExpr("*", f"try_cast({model} as double) _output")
    scored = score_payments(resolved) if probability is None else score_with_probability(resolved, "_output")
    decided = run_bounded_recovery(scored, policy)
    traced = decision_trace(decided.withColumnRenamed("decision_reason", "policy_reason"), trace)
    answered = traced.selectExpr("*", f"cast(null as {_ANSWER}) _stored") if known is None else traced.join(
        known.selectExpr(
            "idempotency_key", "named_struct('recommended_action', recommended_action,"
            " 'recovery_priority', recovery_priority,"
            " 'model_probability', cast(model_probability as double),"
            " 'expected_recovery', cast(expected_recovery as double)) _stored"), "idempotency_key", "left")
    checked = answered.selectExpr("*", f"{V.probability_error('_output')} _complaint")
    flagged = (checked.withColumn("_repeated", F.lit(False)) if order is None
               else _repeats(checked, order)).selectExpr(
        "*", "is_valid and (_stored is not null or _repeated) _duplicate").selectExpr(
        "*", "case when is_valid and not _duplicate then _complaint end _bad_output").selectExpr(
        "*", "is_valid and not _duplicate and _bad_output is null _fresh")
    return _responses(with_priority(flagged), model_version, strategy, answered_at)


def _repeats(checked: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Flag events after the first answered one of their key, and hand them its decision.

    Written once, with row numbers that tell copies apart; the first of each key is found by a
    combining aggregate.
    """
    rows = materialize(checked.selectExpr("*", f"struct({', '.join(order)}, monotonically_increasing_id()) _place"))
    answer = ("named_struct('recommended_action', recommended_action, 'recovery_priority', priority,"
              " 'model_probability', cast(recovery_probability as double),"
              " 'expected_recovery', cast(expected_recovery as double))")
    first = rows.filter("is_valid and _complaint is null and _stored is null").groupBy("idempotency_key").agg(
        F.expr("min(_place) _first"), F.expr(f"min_by({answer}, _place) _answer"))
    return rows.join(first, "idempotency_key", "left").selectExpr(
        "* except (_first, _answer, _stored)", "coalesce(_place > _first, false) _repeated",
        "coalesce(_stored, case when _place > _first then _answer end) _stored")


def _responses(flagged: DataFrame, model_version: str, strategy: str, answered_at: str | None) -> DataFrame:
    fresh = lambda fields: f"case when _fresh then struct({fields}) end"
    either = lambda stored, new: (
        f"case when _duplicate then struct({stored}) when _fresh then struct({new}) end")
    as_double = lambda c: f"cast({c} as double) {c}"
    moment = text(answered_at) if answered_at else utc_text()
    event_id = stable_id("event", "idempotency_key")
    decision_id = stable_id("decision", event_id, text(strategy))
    return flagged.selectExpr("*", f"{moment} _moment").selectExpr(
        "struct(payment_id, customer_id, idempotency_key, idempotency_key_source) event_identity",
        "struct(is_valid and _bad_output is null as is_valid,"
        " case when _bad_output is not null then array(_bad_output) else errors end as errors)"
        " validation",
        either("_stored.model_probability as recovery_probability",
               as_double("recovery_probability")) + " prediction",
        either("_stored.recommended_action, _stored.recovery_priority",
               "recommended_action, priority as recovery_priority") + " decision",
        either("_stored.expected_recovery, cast(null as double) as effective_retry_cost,"
               " cast(null as double) as expected_retry_net_value",
               ", ".join(map(as_double, ("expected_recovery", "effective_retry_cost",
                                         "expected_retry_net_value")))) + " economic_estimate",
        fresh("decision_reason, key_input_factors") + " explanation",
        fresh("initial_state, attempt_number, policy_decision, selected_action,"
              " policy_reason as decision_reason, simulated_recovered, action_cost,"
              " recovered_amount, net_recovered_revenue, verification_status, final_state,"
              " state_history") + " bounded_recovery",
        fresh("priority_value, priority_tier, priority_explanation") + " business_priority",
        fresh(f"{audit_id('payment_id', text(strategy), '_moment')} as audit_id, payment_id,"
              " _moment as timestamp, recovery_probability as model_probability,"
              " priority as recovery_priority, recommended_action, selected_threshold as decision_threshold,"
              " effective_retry_cost, expected_recovery, expected_retry_net_value, decision_reason,"
              f" {join_factors('key_input_factors')} as key_input_factors, {text(strategy)} as strategy_name,"
              " simulated_recovered, recovered_amount as simulated_recovered_revenue, action_cost,"
              " net_recovered_revenue") + " audit_record",
        f"struct(_duplicate as is_duplicate, case when _duplicate or _fresh then {event_id} end as event_id,"
        f" case when _fresh then {decision_id} end as decision_id,"
        " case when _duplicate then 'duplicate_detected' when _fresh then 'new' end as idempotency_status)"
        " persistence",
        "struct(case when not is_valid or _bad_output is not null then 'error'"
        " when _duplicate then 'duplicate' else 'success' end as status,"
        " case when not is_valid then 'validation_error'"
        " when _bad_output is not null then 'model_output_error' end as error_type,"
        f" _moment as timestamp_utc, {text(model_version)} as model_version) processing_metadata")
