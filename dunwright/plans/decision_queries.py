"""Payments, scores, bands, policy, traces and the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.decisions import scorecard_probability
from ..functions.scalars import join_factors
from ..operators import decide as D, prioritize as P
from ..operators.decide import parse_events, respond
from ..operators.monitoring import expected_by_priority, priority_distribution
from ..operators.store import first_per_key
from ..sources.readers import to_json_events
from .registry import Tables, digits, money, query, whole

_FEATURES = [
    "payment_id", "customer_id", money("payment_amount"), "failure_reason", "payment_method",
    *[whole(c) for c in (
        "customer_tenure_months", "past_successful_payments", "past_failed_payments",
        "time_since_last_success_days", "is_subscription", "days_overdue",
        "recovery_attempts_so_far", "recovered")],
    "historical_success_rate"]
_FEATURES_SQL = f"SELECT {', '.join(_FEATURES)} FROM payments"


@query("payments_adapter", _FEATURES_SQL)
def payments_adapter(t: Tables) -> DataFrame:
    return t.payments.selectExpr(*_FEATURES)


@query("customer_history_features", f"""
SELECT payment_id, {whole('past_successful_payments')}, {whole('past_failed_payments')},
  historical_success_rate, {whole('customer_tenure_months')},
  {whole('time_since_last_success_days')}, {whole('days_overdue')},
  {whole('recovery_attempts_so_far')} FROM payments""")
def customer_history_features(t: Tables) -> DataFrame:
    return t.payments.selectExpr(
        "payment_id", "historical_success_rate", *[whole(c) for c in (
            "past_successful_payments", "past_failed_payments", "customer_tenure_months",
            "time_since_last_success_days", "days_overdue", "recovery_attempts_so_far")])


@query("observed_recovery_label", f"""
SELECT payment_id, {whole('recovered')}, coalesce(epoch_us(next_ok_ts), -1) AS next_success_us
FROM payments""")
def observed_recovery_label(t: Tables) -> DataFrame:
    return t.payments.selectExpr("payment_id", whole("recovered"),
                                 "coalesce(unix_micros(next_ok_ts), -1) as next_success_us")


_SCORED = ["payment_id", "cast(recovery_probability as double) as recovery_probability",
           money("expected_recovery"), "priority", "recommended_action"]


@query("score_payments", f"SELECT {', '.join(_SCORED)} FROM scored")
def score_payments(t: Tables) -> DataFrame:
    return t.scored.selectExpr(*_SCORED)


@query("decision_bands", """
SELECT priority, recommended_action, count(*) AS payments FROM scored GROUP BY ALL""")
def decision_bands(t: Tables) -> DataFrame:
    return t.scored.groupBy("priority", "recommended_action").agg(F.expr("count(1) payments"))


@query("expected_recovery", f"""
SELECT failure_reason, count(*) AS payments, {money('sum(payment_amount)', 'amount')},
  {money('sum(expected_recovery)', 'expected_recovery')} FROM scored GROUP BY failure_reason""")
def expected_recovery(t: Tables) -> DataFrame:
    return t.scored.groupBy("failure_reason").agg(*[F.expr(e) for e in (
        "count(1) payments", money("sum(payment_amount)", "amount"),
        money("sum(expected_recovery)", "expected_recovery"))])


@query("bounded_policy", """
SELECT payment_id, policy_decision, selected_action, policy_reason AS decision_reason, reason_code
FROM policed""")
def bounded_policy(t: Tables) -> DataFrame:
    return D.apply_policy(t.scored).select(
        "payment_id", "policy_decision", "selected_action", "decision_reason", "reason_code")


@query("attempt_number", f"""
SELECT policy_decision, {whole('recovery_attempts_so_far')},
  {whole("recovery_attempts_so_far + CASE WHEN policy_decision = 'ALLOWED' THEN 1 ELSE 0 END",
         'attempt_number')}, count(*) AS payments
FROM policed GROUP BY ALL""")
def attempt_number(t: Tables) -> DataFrame:
    return D.apply_policy(t.scored).groupBy(
        "policy_decision", "recovery_attempts_so_far", "attempt_number").agg(
        F.expr("count(1) payments")).selectExpr(
        "policy_decision", whole("recovery_attempts_so_far"), whole("attempt_number"), "payments")


_EXECUTED_SQL = """, executed AS (
  SELECT *, policy_decision = 'ALLOWED' AND draw < p * (CASE selected_action
      WHEN 'Retry Payment' THEN 1.0 WHEN 'Payment Method Reminder' THEN 0.5 ELSE 0.0 END)::DOUBLE
      AS hit,
    CASE WHEN policy_decision <> 'ALLOWED' THEN 0 WHEN selected_action = 'Retry Payment' THEN 50
      WHEN selected_action = 'Payment Method Reminder' THEN 1 ELSE 0 END AS cost
  FROM policed
), walked AS (
  SELECT *, CASE policy_decision WHEN 'BLOCKED' THEN 'FAILED > ASSESSED > STOPPED'
      WHEN 'MANUAL_REVIEW' THEN 'FAILED > ASSESSED > MANUAL_REVIEW'
      ELSE 'FAILED > ASSESSED > ACTION_SELECTED > ACTION_EXECUTED > '
        || CASE WHEN hit THEN 'RECOVERED > VERIFIED > CLOSED'
           ELSE 'FAILED_RECOVERY > VERIFIED > STOPPED' END END AS path
  FROM executed
)"""


@query("state_paths", _EXECUTED_SQL + f"""
SELECT payment_id, path, regexp_extract(path, '[A-Z_]+$') AS final_state,
  CASE WHEN policy_decision = 'ALLOWED' THEN 'VERIFIED' ELSE 'PENDING' END AS verification_status,
  hit AS simulated_recovered, cost::DOUBLE AS action_cost,
  {money('CASE WHEN hit THEN payment_amount ELSE 0 END', 'recovered_amount')},
  {money('CASE WHEN hit THEN payment_amount ELSE 0 END - cost', 'net_recovered_revenue')}
FROM walked""")
def state_paths(t: Tables) -> DataFrame:
    return D.run_bounded_recovery(t.scored).selectExpr(
        "payment_id", "concat_ws(' > ', state_history) path", "final_state", "verification_status",
        "simulated_recovered", "cast(action_cost as double) action_cost",
        money("recovered_amount"), money("net_recovered_revenue"))


@query("decision_trace", f"""
SELECT payment_id, {money('net_value', 'expected_retry_net_value')},
  explanation AS decision_reason, factors AS key_input_factors FROM traced""")
def decision_trace(t: Tables) -> DataFrame:
    return D.decision_trace(t.scored).selectExpr(
        "payment_id", money("expected_retry_net_value"), "decision_reason",
        f"{join_factors('key_input_factors')} key_input_factors")


_EXPLAINED = """tier || CASE WHEN is_subscription = 1
  THEN ' priority. Subscription recovery receives the configured synthetic business-value multiplier (1.5x). Business-adjusted recovery value is ₹'
  ELSE ' priority based on base expected recovery. Business-adjusted recovery value is ₹' END
  || format('{:,.2f}', round(adjusted, 2)::DOUBLE) || '.' AS priority_explanation"""
_QUEUE_SQL = f"""
SELECT payment_id, {money('payment_amount')},
  recovery_probability::DOUBLE AS recovery_probability, {whole('is_subscription')},
  {money('adjusted', 'priority_value')}, tier AS priority_tier, {_EXPLAINED}"""


@query("prioritized_queue", _QUEUE_SQL + f""", {whole('queue_rank', 'priority_rank')},
  {money('expected_recovery', 'base_expected_recovery')} FROM tiered""")
def prioritized_queue(t: Tables) -> DataFrame:
    return P.rank_queue(t.scored).selectExpr(
        "payment_id", money("payment_amount"),
        "cast(recovery_probability as double) recovery_probability", whole("is_subscription"),
        money("priority_value"), "priority_tier", "priority_explanation", whole("priority_rank"),
        money("base_expected_recovery"))


@query("queue_top100", _QUEUE_SQL + " FROM tiered WHERE queue_rank <= 100")
def queue_top100(t: Tables) -> DataFrame:
    return P.top_of_queue(t.scored, 100).selectExpr(
        "payment_id", money("payment_amount"),
        "cast(recovery_probability as double) recovery_probability", whole("is_subscription"),
        money("priority_value"), "priority_tier", "priority_explanation")


@query("tier_distribution", """
SELECT priority_tier, count(tier) AS payments
FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(priority_tier)
LEFT JOIN tiered ON tier = priority_tier GROUP BY priority_tier""")
def tier_distribution(t: Tables) -> DataFrame:
    return P.tier_distribution(P.with_priority(t.scored)).drop("position")


@query("tier_by_subscription", """
SELECT tier AS priority_tier, count(*) FILTER (WHERE is_subscription = 0) AS one_off,
  count(*) FILTER (WHERE is_subscription = 1) AS subscription FROM tiered GROUP BY tier""")
def tier_by_subscription(t: Tables) -> DataFrame:
    return P.tier_by_subscription(P.with_priority(t.scored))


@query("value_concentration", f""", n AS (
  SELECT count(*) AS n, sum(adjusted) AS total FROM tiered)
SELECT share::DOUBLE AS share, {whole('floor(n * share::DOUBLE)', 'payments')},
  {money('coalesce(sum(adjusted) FILTER (WHERE queue_rank <= floor(n * share::DOUBLE)), 0)', 'value')},
  {digits('coalesce(sum(adjusted) FILTER (WHERE queue_rank <= floor(n * share::DOUBLE)), 0)::DOUBLE / total::DOUBLE', 'value_share')}
FROM tiered, n, (VALUES (0.01), (0.05), (0.10), (0.20)) v(share) GROUP BY share, n, total""")
def value_concentration(t: Tables) -> DataFrame:
    return P.value_concentration(P.rank_queue(t.scored)).selectExpr(
        "share", whole("payments"), money("value"), digits("value_share"))


@query("portfolio_totals", f"""
SELECT coalesce(tier, 'ALL') AS priority_tier, count(*) AS payments,
  {money('sum(payment_amount)', 'revenue_at_risk')},
  {money('sum(expected_recovery)', 'base_expected')}, {money('sum(adjusted)', 'business_adjusted')}
FROM tiered GROUP BY ROLLUP (tier)""")
def portfolio_totals(t: Tables) -> DataFrame:
    return P.portfolio_totals(P.with_priority(t.scored)).selectExpr(
        "coalesce(priority_tier, 'ALL') priority_tier", "payments", money("revenue_at_risk"),
        money("base_expected"), money("business_adjusted"))


@query("expected_by_priority", f"""
SELECT v.priority, count(s.priority) AS payments,
  {money('coalesce(sum(expected_recovery), 0)', 'expected_recovery')}
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(priority)
LEFT JOIN scored s ON s.priority = v.priority GROUP BY v.priority""")
def expected_by_priority_query(t: Tables) -> DataFrame:
    return expected_by_priority(t.scored).selectExpr("priority", "payments", money("expected_recovery"))


@query("priority_distribution", """
SELECT v.priority, count(s.priority) AS payments
FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) v(priority)
LEFT JOIN scored s ON s.priority = v.priority GROUP BY v.priority""")
def priority_distribution_query(t: Tables) -> DataFrame:
    return priority_distribution(t.scored).drop("position")


_PAYLOAD = ["payment_id", "customer_id", "payment_amount", "failure_reason", "payment_method",
            "is_subscription", "customer_tenure_months", "past_successful_payments",
            "past_failed_payments", "historical_success_rate", "time_since_last_success_days",
            "days_overdue", "recovery_attempts_so_far"]


@query("event_responses", _EXECUTED_SQL + f"""
SELECT t.payment_id, 'success' AS status, 'request_scoped_fallback' AS key_source,
  true AS is_valid, p AS recovery_probability, t.recommended_action, priority AS recovery_priority,
  {money('t.expected_recovery', 'expected_recovery')},
  {money('net_value', 'expected_retry_net_value')}, explanation AS decision_reason,
  t.policy_decision, t.selected_action, t.policy_reason, w.path
FROM traced t JOIN (SELECT payment_id AS pid, path FROM walked) w ON pid = t.payment_id""")
def event_responses(t: Tables) -> DataFrame:
    """Every payment as a JSON event through the whole single-event response."""
    parsed = parse_events(to_json_events(t.payments, _PAYLOAD))
    return respond(parsed).selectExpr(
        "event_identity.payment_id", "processing_metadata.status",
        "event_identity.idempotency_key_source key_source", "validation.is_valid",
        "prediction.recovery_probability", "decision.recommended_action",
        "decision.recovery_priority", digits("economic_estimate.expected_recovery",
                                             "expected_recovery", 4),
        digits("economic_estimate.expected_retry_net_value", "expected_retry_net_value", 4),
        "explanation.decision_reason", "bounded_recovery.policy_decision",
        "bounded_recovery.selected_action", "bounded_recovery.decision_reason policy_reason",
        "concat_ws(' > ', bounded_recovery.state_history) path")


# A feed with everything in it: two payments in a row share a key, every eleventh amount is invalid, the model
# fails on every thirteenth event, and keys of the first ten days are stored.
_NUMBER = "cast(substring(payment_id, 5) as bigint)"
_SHARED_KEY = f"concat('key-', cast({_NUMBER} - {_NUMBER} % 25 as string))"
_FAILING_MODEL = f"case when {_NUMBER} % 13 = 0 then double('NaN') else {scorecard_probability()} end"


@query("event_answers", f""", feed AS (
  SELECT *, {_SHARED_KEY} AS key, event_id % 11 <> 0 AS valid, event_id % 13 = 0 AS bad FROM scored
), stored AS (
  SELECT key, recommended_action, priority, p, expected_recovery FROM feed
  WHERE failed_at < timestamp '2024-01-11 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY failed_at, payment_id) = 1
), judged_feed AS (
  SELECT f.*, s.key IS NOT NULL AS known, s.recommended_action AS s_action, s.p AS s_p,
    row_number() OVER (ORDER BY f.failed_at, f.payment_id) AS place
  FROM feed f LEFT JOIN stored s ON s.key = f.key
), first AS (
  SELECT key, min(place) AS place, min_by(recommended_action, place) AS action, min_by(p, place) AS p
  FROM judged_feed WHERE valid AND NOT bad AND NOT known GROUP BY key
), answered AS (
  SELECT j.*, CASE WHEN NOT valid THEN 'validation_error' WHEN known OR j.place > coalesce(f.place, j.place)
      THEN 'duplicate' WHEN bad THEN 'model_output_error' ELSE 'success' END AS answer,
    f.action AS f_action, f.p AS f_p FROM judged_feed j LEFT JOIN first f ON f.key = j.key)
SELECT a.payment_id, CASE WHEN answer LIKE '%error' THEN 'error' ELSE answer END AS status,
  CASE WHEN answer LIKE '%error' THEN answer END AS error_type,
  CASE answer WHEN 'success' THEN a.p WHEN 'duplicate' THEN coalesce(s_p, f_p) END AS recovery_probability,
  CASE answer WHEN 'success' THEN a.recommended_action WHEN 'duplicate' THEN coalesce(s_action, f_action) END
    AS recommended_action,
  CASE WHEN answer = 'success' THEN t.tier END AS priority_tier,
  CASE WHEN answer = 'success' THEN substr(sha256(a.payment_id
    || '_Rule-Based Real-Time Default_2024-02-01T00:00:00.000000+00:00'), 1, 16) END AS audit_id,
  CASE WHEN answer IN ('success', 'duplicate') THEN substr(sha256('event|' || a.key), 1, 32) END AS event_id,
  CASE answer WHEN 'model_output_error' THEN 'prediction probability must be finite'
    WHEN 'validation_error' THEN 'payment_amount must be greater than 0' END AS complaint
FROM answered a JOIN tiered t ON t.payment_id = a.payment_id""")
def event_answers(t: Tables) -> DataFrame:
    """Valid, invalid, repeated, stored and failing events through the single-event response."""
    feed = t.scored.selectExpr("*", f"{_SHARED_KEY} idempotency_key")
    known = first_per_key(feed.filter("failed_at < timestamp '2024-01-11 00:00:00'").selectExpr(
        "idempotency_key", "recommended_action", "priority recovery_priority",
        "recovery_probability model_probability", "expected_recovery", "failed_at", "payment_id"),
        ["idempotency_key"], ["failed_at", "payment_id"])
    rows = feed.selectExpr(
        "struct(failed_at) _at", "idempotency_key", *[c for c in _PAYLOAD if c != "payment_amount"],
        f"if({_NUMBER} % 11 = 0, -1, payment_amount) payment_amount")
    parsed = parse_events(rows.selectExpr("to_json(struct(* except (_at))) value", "_at.failed_at failed_at"))
    answers = respond(parsed, known, probability=_FAILING_MODEL, order=("failed_at", "payment_id"),
                      answered_at="2024-02-01T00:00:00.000000+00:00")
    return answers.selectExpr(
        "event_identity.payment_id", "processing_metadata.status", "processing_metadata.error_type",
        "prediction.recovery_probability", "decision.recommended_action", "business_priority.priority_tier",
        "audit_record.audit_id", "persistence.event_id", "get(validation.errors, 0) complaint")
