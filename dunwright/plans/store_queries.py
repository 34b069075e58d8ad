"""Audit trail, decision store, integrity checks and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import RETRY
from ..functions.scalars import join_factors, split_factors, stable_id, text
from ..operators import audit as A, decide as D, ledger as L, quality as Q, store as S
from ..operators.ordering import materialize
from ..operators.strategy import optimal_threshold_value
from ..schemas import PAYMENT_EVENTS
from ..sources.readers import to_json_events
from .registry import Tables, digits, money, query, whole

_STAMP = "2024-02-01T00:00:00Z"
_STRATEGY = "Optimized Selective Strategy"
_NUMBER = "cast(substring(payment_id, 5) as bigint)"

_AUDIT_SQL = f""", chosen AS (
  SELECT *, CASE WHEN p >= (SELECT threshold FROM best WHERE cost = 50) THEN 'Retry Payment'
    ELSE 'Do Nothing' END AS action FROM traced
), audited AS (
  SELECT *, substr(sha256(payment_id || '_{_STRATEGY}_{_STAMP}'), 1, 16) AS audit_id,
    (action = 'Retry Payment' AND draw < p)::INT AS hit,
    CASE action WHEN 'Retry Payment' THEN 50 ELSE 0 END AS action_cost,
    'The model estimates the probability of recovery based on payment characteristics. '
    || CASE WHEN action = 'Retry Payment' THEN
      'Under the simulation assumptions, the expected recovery (₹' || format('{{:,.2f}}', round(expected_recovery, 2)::DOUBLE)
      || CASE WHEN expected_recovery > 50
        THEN ') exceeds the effective retry cost (₹50.00), so an automated retry is economically justified.'
        ELSE ') is lower than the effective retry cost (₹50.00), meaning an automated retry is not mathematically optimal despite the priority band.' END
      ELSE 'The Stage 5 rule-based engine places this payment below the automatic-retry band, so automatic retry is stopped. The model estimates very low recovery probability.' END
      AS reason
  FROM chosen
)"""


def _audit(t: Tables) -> DataFrame:
    ledger = L.outcome_ledger(t.scored_table, optimal_threshold_value(t.scored_table), (_STRATEGY,))
    return A.audit_records(ledger, _STRATEGY, _STAMP)


@query("audit_records", _AUDIT_SQL + f"""
SELECT audit_id, payment_id, '{_STAMP}' AS timestamp, p AS model_probability,
  priority AS recovery_priority, action AS recommended_action, 0.05::DOUBLE AS decision_threshold,
  50.0::DOUBLE AS effective_retry_cost, {money('expected_recovery')},
  {money('net_value', 'expected_retry_net_value')}, reason AS decision_reason,
  factors AS key_input_factors, '{_STRATEGY}' AS strategy_name, {whole('hit', 'simulated_recovered')},
  {money('CASE WHEN hit = 1 THEN payment_amount ELSE 0 END', 'simulated_recovered_revenue')},
  action_cost::DOUBLE AS action_cost,
  {money('CASE WHEN hit = 1 THEN payment_amount ELSE 0 END - action_cost', 'net_recovered_revenue')}
FROM audited""")
def audit_records(t: Tables) -> DataFrame:
    return _audit(t).selectExpr(
        "audit_id", "payment_id", "timestamp", "cast(model_probability as double) model_probability",
        "recovery_priority", "recommended_action",
        "cast(decision_threshold as double) decision_threshold",
        "cast(effective_retry_cost as double) effective_retry_cost", money("expected_recovery"),
        money("expected_retry_net_value"), "decision_reason", "key_input_factors", "strategy_name",
        whole("simulated_recovered"), money("simulated_recovered_revenue"),
        "cast(action_cost as double) action_cost", money("net_recovered_revenue"))


_SUMMARY = [
    "total_audit_records", "retry_decisions", "reminder_decisions", "manual_review_decisions",
    "do_nothing_decisions", digits("average_model_probability"), money("total_expected_recovery"),
    money("total_expected_retry_net_value"), whole("simulated_recovery_count"),
    money("simulated_recovered_revenue"), money("simulated_net_recovered_revenue")]


def _summary_sql(where: str = "") -> str:
    return _AUDIT_SQL + f""", s AS (SELECT count(*) AS total_audit_records,
    count(*) FILTER (WHERE action = 'Retry Payment') AS retry_decisions, 0::BIGINT AS reminder_decisions,
    0::BIGINT AS manual_review_decisions,
    count(*) FILTER (WHERE action = 'Do Nothing') AS do_nothing_decisions,
    sum(recovery_probability)::DOUBLE / count(*) AS average_model_probability,
    sum(expected_recovery) AS total_expected_recovery, sum(net_value) AS total_expected_retry_net_value,
    sum(hit) AS simulated_recovery_count,
    sum(CASE WHEN hit = 1 THEN payment_amount ELSE 0 END) AS simulated_recovered_revenue,
    sum(CASE WHEN hit = 1 THEN payment_amount ELSE 0 END - action_cost) AS simulated_net_recovered_revenue
  FROM audited {where})
SELECT {', '.join(_SUMMARY)} FROM s"""


@query("audit_summary", _summary_sql())
def audit_summary(t: Tables) -> DataFrame:
    return A.audit_summary(_audit(t)).selectExpr(*_SUMMARY)


@query("audit_filter", _summary_sql("WHERE action = 'Retry Payment' AND priority = 'MEDIUM'"))
def audit_filter(t: Tables) -> DataFrame:
    """Filtered history and its summary; one of the three filters is left open."""
    return A.audit_summary(A.filter_audit(_audit(t), action=RETRY, priority="MEDIUM")
                           ).selectExpr(*_SUMMARY)


# Incoming events: two payments in a row share a key, and some keys are already stored.
_KEY = f"concat('key-', cast(({_NUMBER} - {_NUMBER} % 25) as string))"
_FEED_SQL = f""", feed AS (
  SELECT *, {_KEY} AS idempotency_key FROM payments
), stored AS (
  SELECT DISTINCT idempotency_key FROM feed WHERE failed_at < timestamp '2024-01-11 00:00:00'
), incoming AS (
  SELECT * FROM feed WHERE failed_at >= timestamp '2024-01-09 00:00:00'
  UNION ALL SELECT * FROM feed WHERE failed_at >= timestamp '2024-01-09 00:00:00' AND event_id % 3 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY failed_at, payment_id) = 1
    AND idempotency_key NOT IN (SELECT idempotency_key FROM stored) AS is_new FROM incoming)"""


def _feed(t: Tables) -> tuple[DataFrame, DataFrame]:
    feed = t.payments.selectExpr("*", f"{_KEY} idempotency_key")
    stored = feed.filter("failed_at < timestamp '2024-01-11 00:00:00'").select("idempotency_key").distinct()
    copies = f"explode(array_repeat(0, if({_NUMBER} % 3 = 0, 2, 1))) _copy"  # delivered again, unchanged
    return feed.filter("failed_at >= timestamp '2024-01-09 00:00:00'").selectExpr("*", copies).drop("_copy"), stored


@query("idempotent_insert", _FEED_SQL + " SELECT payment_id, idempotency_key, NOT is_new AS is_duplicate FROM ranked")
def idempotent_insert(t: Tables) -> DataFrame:
    incoming, stored = _feed(t)
    return S.insert_outcome(incoming, stored, ["idempotency_key"], ["failed_at", "payment_id"]).select(
        "payment_id", "idempotency_key", "is_duplicate")


@query("insert_new_rows", _FEED_SQL + " SELECT payment_id, idempotency_key FROM ranked WHERE is_new")
def insert_new_rows(t: Tables) -> DataFrame:
    incoming, stored = _feed(t)
    return S.insert_if_absent(
        incoming, stored, ["idempotency_key"], ["failed_at", "payment_id"]).select(
        "payment_id", "idempotency_key")


# Decisions: each payment is decided twice, the second time an hour later by another strategy.
_DECIDED_SQL = f""", decisions AS (
  SELECT t.*, v.strategy, v.step, failed_at + to_hours(v.step) AS decided_at,
    substr(sha256('event|' || payment_id), 1, 32) AS event_key,
    substr(sha256('decision|' || substr(sha256('event|' || payment_id), 1, 32) || '|' || v.strategy), 1, 32)
      AS decision_id
  FROM traced t, (VALUES ('{S.DEFAULT_STRATEGY}', 1), ('Bounded Recovery', 2)) v(strategy, step)
  WHERE v.step = 1 OR event_id % 3 = 0
)"""


def _traced(t: Tables) -> DataFrame:
    executed = D.run_bounded_recovery(t.scored_table).withColumnRenamed("decision_reason", "policy_reason")
    return D.decision_trace(executed).selectExpr("*", "payment_id idempotency_key")


def _decisions(t: Tables) -> DataFrame:
    traced = _traced(t)
    first = S.decision_rows(traced, "failed_at + interval 1 hour", stable_id("model", "'scorecard'", "'v1'"))
    again = S.decision_rows(traced.filter(f"{_NUMBER} % 3 = 0"), "failed_at + interval 2 hours",
                            stable_id("model", "'scorecard'", "'v2'"), "Bounded Recovery")
    return first.unionByName(again)


@query("latest_decision", _DECIDED_SQL + """
SELECT event_key AS event_id, decision_id, strategy AS strategy_name,
  epoch_us(decided_at) AS decided_us FROM decisions
QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY decided_at DESC) = 1""")
def latest_decision(t: Tables) -> DataFrame:
    return S.latest_decision(_decisions(t)).selectExpr(
        "event_id", "decision_id", "strategy_name", "unix_micros(decided_at) decided_us")


@query("duplicate_lookup", _DECIDED_SQL + f"""
SELECT payment_id AS idempotency_key, decision_id, recommended_action, priority AS recovery_priority,
  round(round(recovery_probability, 5)::DOUBLE, 5) AS model_probability,
  {money('round(expected_recovery, 2)', 'expected_recovery')} FROM decisions
WHERE failed_at >= timestamp '2024-01-20 00:00:00'
QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY decided_at DESC) = 1""")
def duplicate_lookup(t: Tables) -> DataFrame:
    """Events arriving again get their latest stored decision."""
    again = t.scored_table.filter("failed_at >= timestamp '2024-01-20 00:00:00'").selectExpr(
        "payment_id idempotency_key", f"{stable_id('event', 'payment_id')} event_id")
    return S.stored_decisions(again, _decisions(t)).selectExpr(
        "idempotency_key", "decision_id", "recommended_action", "recovery_priority",
        "cast(model_probability as double) model_probability", money("expected_recovery"))


@query("decision_rows", _DECIDED_SQL + f"""
SELECT decision_id, event_key AS event_id, strategy AS strategy_name,
  round(recovery_probability, 5)::DOUBLE AS model_probability, recommended_action,
  {money('round(expected_recovery, 2)', 'expected_recovery')},
  {money('round(net_value, 2)', 'expected_retry_net_value')}, explanation AS decision_reason,
  factors AS key_input_factors FROM decisions""")
def decision_rows(t: Tables) -> DataFrame:
    return _decisions(t).selectExpr(
        "decision_id", "event_id", "strategy_name",
        "cast(model_probability as double) model_probability", "recommended_action",
        money("expected_recovery"), money("expected_retry_net_value"), "decision_reason",
        f"{join_factors('key_input_factors')} key_input_factors")


# Constraints on rows with some fields broken.
_BROKEN = [
    "case when {n} % 9 = 1 then -payment_amount else payment_amount end as payment_amount",
    "case when {n} % 9 = 2 then 2 else is_subscription end as is_subscription",
    "case when {n} % 9 = 3 then 'stolen_card' else failure_reason end as failure_reason",
    "case when {n} % 9 in (3, 4) then 'crypto' else payment_method end as payment_method",
    "case when {n} % 9 = 5 then 1.5 else historical_success_rate end as historical_success_rate",
    "case when {n} % 9 = 6 then 'LOST' else 'RECEIVED' end as processing_status"]
_BROKEN = [b.format(n=_NUMBER) for b in _BROKEN]
_CHECKS_SQL = {
    "chk_payment_events_amount": "payment_amount <= 0",
    "chk_payment_events_is_subscription": "is_subscription NOT IN (0, 1)",
    "chk_payment_events_failure_reason":
        "failure_reason NOT IN ('insufficient_funds', 'invalid_card', 'technical_error', 'limit_exceeded')",
    "chk_payment_events_payment_method":
        "payment_method NOT IN ('credit_card', 'debit_card', 'upi', 'bank_transfer')",
    "chk_payment_events_success_rate": "historical_success_rate NOT BETWEEN 0 AND 1",
    "chk_payment_events_status": "processing_status NOT IN ('RECEIVED')"}
_BROKEN_SQL = f", broken AS (SELECT payment_id, {', '.join(_BROKEN)} FROM payments)"


def _broken(t: Tables) -> DataFrame:
    return t.payments.selectExpr("payment_id", *_BROKEN)


@query("constraint_violations", _BROKEN_SQL + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"constraint\", count(*) FILTER (WHERE {bad}) AS violations FROM broken"
    for name, bad in _CHECKS_SQL.items()))
def constraint_violations(t: Tables) -> DataFrame:
    return Q.constraint_report(_broken(t), Q.EVENT_CONSTRAINTS)


@query("constraint_quarantine", _BROKEN_SQL + f""", found AS (
  SELECT payment_id, concat_ws(', ', {', '.join(
      f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _CHECKS_SQL.items())}) AS violations FROM broken)
SELECT * FROM found WHERE violations <> ''""")
def constraint_quarantine(t: Tables) -> DataFrame:
    _, quarantined = Q.split_by_constraints(_broken(t), Q.EVENT_CONSTRAINTS)
    return quarantined.selectExpr("payment_id", "concat_ws(', ', violations) violations")


_GAPS = {"payment_method": 7, "failure_reason": 8, "payment_id": 5}
_KEPT = [f.name for f in PAYMENT_EVENTS.fields if not f.nullable]


@query("not_null_report", " UNION ALL ".join(
    f"SELECT 'nn_{c}' AS \"constraint\", count(*) FILTER (WHERE "
    + (f"{_NUMBER} % 9 = {_GAPS[c]}" if c in _GAPS else "false") + ") AS violations FROM payments"
    for c in _KEPT))
def not_null_report(t: Tables) -> DataFrame:
    """Required columns of event rows in which some values have gone missing."""
    gaps = {c: F.expr(f"case when {_NUMBER} % 9 <> {k} then {c} end") for c, k in _GAPS.items()}
    return Q.constraint_report(_event_rows(t).withColumns(gaps), Q.not_null_constraints(PAYMENT_EVENTS))


@query("unique_violations", _FEED_SQL + """
SELECT idempotency_key, count(*) AS copies FROM feed GROUP BY idempotency_key HAVING count(*) > 1""")
def unique_violations(t: Tables) -> DataFrame:
    return Q.unique_violations(t.payments.selectExpr(f"{_KEY} idempotency_key"), ["idempotency_key"])


@query("orphan_rows", """, kept AS (SELECT * FROM payments WHERE event_id % 7 <> 0)
SELECT customer_id, count(*) AS rows FROM payments
WHERE customer_id NOT IN (SELECT customer_id FROM kept WHERE recovered = 0) GROUP BY customer_id""")
def orphan_rows(t: Tables) -> DataFrame:
    """Payments whose customer is missing on the parent side."""
    parents = t.payments.filter(f"{_NUMBER} % 7 <> 0 and recovered = 0").select("customer_id").distinct()
    return Q.orphans(t.payments, "customer_id", parents)


# Stored tables that no longer fit each other: some events, one model version and some decisions are gone.
_STORED_SQL = _DECIDED_SQL + """, stored AS (
  SELECT *, substr(sha256('model|scorecard|v' || step), 1, 32) AS model_id FROM decisions
), kept_decisions AS (SELECT * FROM stored WHERE event_id % 5 <> 0
), refs AS (
  SELECT 'fk_decision_event' AS reference, event_key AS key FROM kept_decisions WHERE event_id % 7 = 0
  UNION ALL SELECT 'fk_decision_model', model_id FROM kept_decisions WHERE step = 2
  UNION ALL SELECT 'fk_audit_decision', decision_id FROM stored WHERE event_id % 5 = 0
  UNION ALL SELECT 'fk_outcome_decision', decision_id FROM stored WHERE event_id % 5 = 0 AND step = 1)"""


@query("stored_orphans", _STORED_SQL + """
SELECT reference, key, count(*) AS rows FROM refs GROUP BY ALL""")
def stored_orphans(t: Tables) -> DataFrame:
    """Decision to event and model, audit and outcome to decision, in one aggregation."""
    traced = materialize(_traced(t))
    first = S.decision_rows(traced, "failed_at + interval 1 hour", stable_id("model", "'scorecard'", "'v1'"))
    again = S.decision_rows(traced.filter(f"{_NUMBER} % 3 = 0"), "failed_at + interval 2 hours",
                            stable_id("model", "'scorecard'", "'v2'"), "Bounded Recovery")
    decisions = first.unionByName(again)
    event_ids = traced.selectExpr(f"{stable_id('event', 'payment_id')} event_id", f"{_NUMBER} number", "payment_id")
    numbered = decisions.join(event_ids, "event_id")
    kept = numbered.filter("number % 5 <> 0")
    models = t.spark.sql(f"select {stable_id('model', text('scorecard'), text('v1'))} model_version_id")
    outcomes = numbered.filter(f"strategy_name = {text(S.DEFAULT_STRATEGY)}")
    return Q.all_orphans(
        [Q.Reference("fk_decision_event", kept, "event_id", "event"),
         Q.Reference("fk_decision_model", kept, "model_version_id", "model"),
         Q.Reference("fk_audit_decision", S.audit_rows(numbered), "decision_id", "decision"),
         Q.Reference("fk_outcome_decision", outcomes, "decision_id", "decision")],
        {"event": (event_ids.filter("number % 7 <> 0"), "event_id"), "model": (models, "model_version_id"),
         "decision": (kept, "decision_id")})


@query("stored_constraints", _DECIDED_SQL + """, rows AS (
  SELECT CASE WHEN event_id % 9 = 1 THEN 1.5 ELSE 0.5 END AS probability,
    CASE WHEN event_id % 9 = 2 THEN 'URGENT' ELSE priority END AS priority,
    CASE WHEN event_id % 9 = 3 THEN 'GUESSED' ELSE 'REAL' END AS source,
    CASE WHEN event_id % 9 = 4 THEN NULL ELSE decision_id END AS decision_id, step FROM decisions)
SELECT 'recovery_decisions' AS "table", 'chk_rd_probability' AS "constraint",
  count(*) FILTER (WHERE probability > 1) AS violations FROM rows
UNION ALL SELECT 'recovery_decisions', 'chk_rd_priority', count(*) FILTER (WHERE priority = 'URGENT') FROM rows
UNION ALL SELECT 'recovery_decisions', 'nn_decision_id', count(*) FILTER (WHERE decision_id IS NULL) FROM rows
UNION ALL SELECT 'recovery_outcomes', 'chk_ro_source', count(*) FILTER (WHERE source = 'GUESSED') FROM rows""")
def stored_constraints(t: Tables) -> DataFrame:
    """Value constraints of decisions and outcomes, and a required column, on rows with broken fields."""
    number = "cast(substring(payment_id, 5) as bigint)"
    ids = t.scored_table.selectExpr(f"{stable_id('event', 'payment_id')} event_id", f"{number} number")
    rows = materialize(_decisions(t).join(ids, "event_id").selectExpr(
        "if(number % 9 = 4, null, decision_id) decision_id",
        "if(number % 9 = 1, 1.5, 0.5) model_probability",
        "if(number % 9 = 2, 'URGENT', recovery_priority) recovery_priority",
        "if(number % 9 = 3, 'GUESSED', 'REAL') outcome_source"))
    return Q.all_constraints({
        "recovery_decisions": (rows, Q.DECISION_CONSTRAINTS | {"nn_decision_id": "decision_id is null"}),
        "recovery_outcomes": (rows, Q.OUTCOME_CONSTRAINTS)})


# A transition log: the recovery paths, some of them with the second state dropped.
_PATHS_SQL = """, executed AS (
  SELECT *, policy_decision = 'ALLOWED' AND draw < p * (CASE selected_action
      WHEN 'Retry Payment' THEN 1.0 WHEN 'Payment Method Reminder' THEN 0.5 ELSE 0.0 END)::DOUBLE AS hit
  FROM policed
), paths AS (
  SELECT payment_id, CASE WHEN event_id % 11 = 0 THEN ['FAILED'] ELSE ['FAILED', 'ASSESSED'] END
    || CASE policy_decision WHEN 'BLOCKED' THEN ['STOPPED'] WHEN 'MANUAL_REVIEW' THEN ['MANUAL_REVIEW']
      ELSE ['ACTION_SELECTED', 'ACTION_EXECUTED'] || CASE WHEN hit THEN ['RECOVERED', 'VERIFIED', 'CLOSED']
        ELSE ['FAILED_RECOVERY', 'VERIFIED', 'STOPPED'] END END AS path
  FROM executed
), moves AS (
  SELECT path[i] AS from_state, path[i + 1] AS to_state
  FROM (SELECT path, unnest(range(1, len(path))) AS i FROM paths)
), edges(a, b) AS (VALUES ('FAILED', 'ASSESSED'), ('ASSESSED', 'ACTION_SELECTED'),
  ('ASSESSED', 'STOPPED'), ('ASSESSED', 'MANUAL_REVIEW'), ('ACTION_SELECTED', 'ACTION_EXECUTED'),
  ('ACTION_EXECUTED', 'RECOVERED'), ('ACTION_EXECUTED', 'FAILED_RECOVERY'), ('RECOVERED', 'VERIFIED'),
  ('FAILED_RECOVERY', 'VERIFIED'), ('VERIFIED', 'CLOSED'), ('VERIFIED', 'STOPPED'))
SELECT from_state, to_state, count(*) AS transitions, max(a) IS NOT NULL AS allowed
FROM moves LEFT JOIN edges ON from_state = a AND to_state = b GROUP BY from_state, to_state"""


def _paths(t: Tables) -> DataFrame:
    return D.run_bounded_recovery(t.scored).selectExpr(
        "payment_id", f"case when {_NUMBER} % 11 = 0 then "
        "filter(state_history, s -> s <> 'ASSESSED') else state_history end state_history")


@query("transition_conformance", _PATHS_SQL)
def transition_conformance(t: Tables) -> DataFrame:
    return Q.conformance(Q.path_transitions(_paths(t)))


@query("transition_log_conformance", _PATHS_SQL)
def transition_log_conformance(t: Tables) -> DataFrame:
    """The same from a log with one row per step."""
    log = materialize(_paths(t).selectExpr(
        "payment_id", "posexplode_outer(state_history) as (position, state)"))
    return Q.conformance(Q.log_transitions(log, "payment_id", "position", "state"))


def _event_rows(t: Tables) -> DataFrame:
    return S.event_rows(t.payments.selectExpr(
        "*", "payment_id idempotency_key", "cast(null as string) raw_event_payload"), "failed_at")


@query("event_rows", f"""
SELECT substr(sha256('event|' || payment_id), 1, 32) AS event_id, payment_id AS idempotency_key,
  'RECEIVED' AS processing_status, epoch_us(failed_at) AS received_us, {money('payment_amount')},
  round(historical_success_rate, 4) AS historical_success_rate FROM payments""")
def event_rows(t: Tables) -> DataFrame:
    return _event_rows(t).selectExpr(
        "event_id", "idempotency_key", "processing_status",
        "unix_micros(event_received_at) received_us", money("payment_amount"),
        "cast(historical_success_rate as double) historical_success_rate")


def _store(t: Tables) -> dict[str, DataFrame]:
    """The five tables as they would be stored for the whole event log."""
    decisions = _decisions(t)
    audits = S.audit_rows(decisions.join(
        t.scored_table.selectExpr("payment_id", f"{stable_id('event', 'payment_id')} event_id"),
        "event_id"))
    outcomes = S.outcome_rows(S.with_decision_id(_traced(t)), "failed_at + interval 1 hour")
    models = t.spark.sql("select 'scorecard' model_name, 'v1' model_version "
                         "union all select 'scorecard', 'v2'")
    return {
        "payment_events": _event_rows(t), "recovery_decisions": decisions, "audit_records": audits,
        "recovery_outcomes": outcomes,
        "model_versions": S.model_rows(models, "timestamp '2024-01-01 00:00:00'")}


@query("table_counts", _DECIDED_SQL + """
SELECT 'payment_events' AS table_name, count(*) AS row_count FROM payments
UNION ALL SELECT 'recovery_decisions', count(*) FROM decisions
UNION ALL SELECT 'audit_records', count(*) FROM decisions
UNION ALL SELECT 'recovery_outcomes', count(*) FROM payments
UNION ALL SELECT 'model_versions', 2""")
def table_counts(t: Tables) -> DataFrame:
    return S.table_counts(_store(t))


@query("lineage", _DECIDED_SQL + f""", executed AS (
  SELECT *, policy_decision = 'ALLOWED' AND draw < p * (CASE selected_action
      WHEN 'Retry Payment' THEN 1.0 WHEN 'Payment Method Reminder' THEN 0.5 ELSE 0.0 END)::DOUBLE AS hit
  FROM decisions)
SELECT payment_id, decision_id, recommended_action, 'scorecard' AS model_name, 'v' || step AS model_version,
  substr(sha256(payment_id || '_' || strategy || '_' || strftime(decided_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'), 1, 16)
    AS audit_id,
  CASE WHEN step = 1 THEN 'SIMULATED' ELSE 'NONE' END AS outcome_source,
  CASE WHEN step = 1 THEN selected_action ELSE 'NONE' END AS selected_action,
  {money('CASE WHEN step = 1 AND hit THEN payment_amount ELSE 0 END', 'recovered_amount')} FROM executed""")
def lineage(t: Tables) -> DataFrame:
    s = _store(t)
    return S.lineage(s["payment_events"], s["recovery_decisions"], s["audit_records"],
                     s["recovery_outcomes"], s["model_versions"]).selectExpr(
        "payment_id", "decision_id", "recommended_action", "model_name", "model_version", "audit_id",
        "coalesce(outcome_source, 'NONE') outcome_source",
        "coalesce(selected_action, 'NONE') selected_action",
        money("coalesce(recovered_amount, 0)", "recovered_amount"))


@query("model_registry", """
SELECT 'scorecard' AS model_name, 'v' || x AS model_version,
  substr(sha256('model|scorecard|v' || x), 1, 32) AS model_version_id
FROM (SELECT DISTINCT event_id % 5 AS x FROM payments) WHERE x <> 1""")
def model_registry(t: Tables) -> DataFrame:
    """Versions seen in the data, registered once; one of them is registered already."""
    seen = t.payments.selectExpr(
        "'scorecard' model_name", f"concat('v', {_NUMBER} % 5) model_version").distinct()
    at = "timestamp '2024-01-01 00:00:00'"
    stored = S.model_rows(t.spark.sql("select 'scorecard' model_name, 'v1' model_version"), at)
    return S.insert_if_absent(S.model_rows(seen, at), stored, ["model_name", "model_version"],
                              ["model_version_id"]).select(
        "model_name", "model_version", "model_version_id")


@query("event_json_roundtrip", f"""
SELECT payment_id, {money('payment_amount')}, failure_reason, historical_success_rate,
  {whole('is_subscription')}, true AS is_valid FROM payments""")
def event_json_roundtrip(t: Tables) -> DataFrame:
    as_text = to_json_events(t.payments, [c for c in t.payments.columns if c not in (
        "failed_at", "next_ok_ts", "recovered")])
    return D.parse_events(as_text).selectExpr(
        "payment_id", money("payment_amount"), "failure_reason", "historical_success_rate",
        whole("is_subscription"), "is_valid")


@query("status_log_current", """
SELECT payment_id AS event_id, CASE WHEN event_id % 4 = 0 THEN 'RECEIVED' WHEN event_id % 4 = 1 THEN 'DECISIONED'
  ELSE 'AUDIT_WRITTEN' END AS processing_status FROM payments""")
def status_log_current(t: Tables) -> DataFrame:
    """Status log with one to three entries per event, the last two at the same time."""
    log = t.payments.selectExpr(
        "payment_id event_id", f"least({_NUMBER} % 4, 2) last_step", "failed_at").selectExpr(
        "event_id", "failed_at + make_interval(0, 0, 0, 0, 1) changed_at",
        "explode(sequence(0, cast(last_step as int))) step").selectExpr(
        "event_id", "changed_at", "step",
        "element_at(array('RECEIVED', 'DECISIONED', 'AUDIT_WRITTEN'), step + 1) processing_status")
    return S.current_status(log)


@query("factor_list_roundtrip", """
SELECT payment_id, 7::BIGINT AS factors, 'Failure reason: ' || failure_reason AS fifth FROM payments""")
def factor_list_roundtrip(t: Tables) -> DataFrame:
    joined = D.decision_trace(t.scored).selectExpr(
        "payment_id", f"{join_factors('key_input_factors')} joined")
    return joined.selectExpr("payment_id", f"{split_factors('joined')} parts").selectExpr(
        "payment_id", whole("size(parts)", "factors"), "element_at(parts, 5) fifth")


@query("idempotency_keys", f"""
SELECT payment_id, CASE event_id % 3 WHEN 0 THEN 'caller_supplied' WHEN 1 THEN 'event_id_fallback'
    ELSE 'request_scoped_fallback' END AS idempotency_key_source,
  CASE event_id % 3 WHEN 0 THEN 'key-' || payment_id WHEN 1 THEN payment_id ELSE 'generated' END AS shown_key
FROM payments""")
def idempotency_keys(t: Tables) -> DataFrame:
    keyed = D.resolve_idempotency(t.payments.selectExpr(
        "payment_id",
        f"case when {_NUMBER} % 3 = 0 then concat('key-', payment_id) when {_NUMBER} % 3 = 1 then '' end"
        " idempotency_key",
        f"case when {_NUMBER} % 3 <> 2 then payment_id end event_id"))
    return keyed.selectExpr(
        "payment_id", "idempotency_key_source",
        "case when idempotency_key_source = 'request_scoped_fallback' and length(idempotency_key) = 36"
        " then 'generated' else idempotency_key end shown_key")


@query("audit_actions", _AUDIT_SQL + " SELECT DISTINCT action AS recommended_action FROM audited")
def audit_actions(t: Tables) -> DataFrame:
    return _audit(t).select("recommended_action").distinct()
