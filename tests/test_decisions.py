"""Policy order, bands, tiers, ranking, traces and responses on literal rows."""

import json

import pytest

from dunwright.config import PolicyConfig, STATE_EDGES
from dunwright.functions import decisions as D
from dunwright.operators import decide, prioritize as P
from tests.test_validation import VALID

SCHEMA = ("payment_id string, payment_amount decimal(14,2), recovery_probability decimal(7,6), "
          "recovery_attempts_so_far int, is_subscription int")


def frame(spark, *rows):
    values = ", ".join(f"('{i}', {a}, {p}, {n}, {s})" for i, a, p, n, s in rows)
    types = [t.split() for t in SCHEMA.split(", ")]
    return spark.sql(f"select * from values {values} t({', '.join(n for n, _ in types)})").selectExpr(
        *[f"cast({n} as {k}) {n}" for n, k in types])


def decided(spark, *rows, config=PolicyConfig()):
    df = decide.with_decisions(frame(spark, *rows))
    return {r.payment_id: r for r in decide.run_bounded_recovery(df, config).collect()}


def test_policy_outcomes(spark):
    got = decided(spark, ("attempts", 30000, 0.9, 2, 0), ("value", 25000.01, 0.9, 0, 0),
                  ("edge", 25000, 0.9, 0, 0), ("chance", 5000, 0.049, 0, 0), ("cost", 100, 0.5, 1, 0),
                  ("low", 5000, 0.2, 0, 0))
    assert {k: (r.policy_decision, r.reason_code) for k, r in got.items()} == {
        "attempts": ("BLOCKED", "MAX_ATTEMPTS"), "value": ("MANUAL_REVIEW", "HIGH_VALUE"),
        "edge": ("ALLOWED", "ALLOWED"), "chance": ("BLOCKED", "LOW_PROBABILITY"),
        "cost": ("BLOCKED", "LOW_VALUE"), "low": ("ALLOWED", "ALLOWED")}
    assert got["attempts"].attempt_number == 2 and got["edge"].attempt_number == 1
    assert got["attempts"].decision_reason == "Maximum automatic recovery attempts reached (2)."
    assert got["value"].decision_reason == (
        "Payment amount (₹25000.01) exceeds high-value threshold (₹25000.00).")
    assert got["chance"].decision_reason == (
        "Recovery probability (0.049) is below minimum threshold (0.05).")
    assert got["cost"].decision_reason == (
        "Expected recovery (₹50.00) does not exceed effective retry cost (₹50.00).")
    # the low band's action has no economics: executed for nothing, verified, stopped
    assert (got["low"].verification_status, got["low"].final_state, got["low"].action_cost) == (
        "VERIFIED", "STOPPED", 0)
    assert got["value"].state_history == ["FAILED", "ASSESSED", "MANUAL_REVIEW"]


def test_value_check_comes_before_probability(spark):
    config = PolicyConfig(min_retry_probability=0.1, high_value_threshold=10000.0)
    assert decided(spark, ("x", 15000, 0.01, 0, 0), config=config)["x"].policy_decision == "MANUAL_REVIEW"


def test_paths_use_allowed_edges_only(spark):
    rows = [(f"p{i}", 1000 + i, 0.5 + i / 100, i % 3, 0) for i in range(40)]
    for r in decided(spark, *rows).values():
        assert all(step in STATE_EDGES for step in zip(r.state_history, r.state_history[1:]))
        assert r.net_recovered_revenue == r.recovered_amount - r.action_cost


@pytest.mark.parametrize("p, priority", [
    ("0.65D", "HIGH"), ("0.649999D", "MEDIUM"), ("0.35D", "MEDIUM"), ("0.349999D", "LOW"),
    ("double('NaN')", None)])
def test_bands(spark, p, priority):
    assert spark.sql(f"select {D.priority_band(p)} b").collect()[0].b == priority


def test_tiers_and_values(spark):
    rows = {r.payment_id: r for r in P.with_priority(frame(
        spark, ("a", 20000, 0.5, 0, 0), ("b", 19999, 0.5, 0, 0), ("c", 5000, 0.5, 0, 0),
        ("d", 1000, 0.5, 0, 0), ("e", 999, 0.5, 0, 0), ("f", 1000, 0.5, 0, 1),
        ("bad_p", 1000, 1.5, 0, 0), ("bad_a", -10, 0.5, 0, 0), ("bad_s", 1000, 0.5, 0, 2))).collect()}
    assert [rows[k].priority_tier for k in "abcdef"] == [
        "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "MEDIUM"]
    assert float(rows["f"].priority_value) == 750 and float(rows["d"].priority_value) == 500
    assert rows["f"].priority_explanation.endswith("(1.5x). Business-adjusted recovery value is ₹750.00.")
    for k in ("bad_p", "bad_a", "bad_s"):
        assert rows[k].priority_tier == "LOW" and rows[k].priority_value == 0
        assert rows[k].is_subscription == 0
        assert rows[k].priority_explanation == (
            "Invalid input parameters; defaulting to safe LOW priority.")
    assert float(rows["bad_p"].recovery_probability) == 1.5


def test_flag_types(spark):
    def value(flag):
        df = spark.sql(f"select 'x' payment_id, 1000.0D payment_amount, 0.5D recovery_probability, "
                       f"{flag} is_subscription")
        return P.with_priority(df).collect()[0].priority_value
    assert value("true") == 750 and value("false") == 500 and value("1") == 750
    assert value("'1'") == 0 and value("1.5D") == 0 and value("-1") == 0 and value("cast(null as int)") == 0


def test_doubles_with_nan_and_infinity(spark):
    df = spark.sql("select * from values ('n', double('NaN'), 0.5D, 0), ('i', double('inf'), 0.5D, 0) "
                   "t(payment_id, payment_amount, recovery_probability, is_subscription)")
    rows = {r.payment_id: r for r in P.with_priority(df).collect()}
    assert rows["n"].payment_amount == 0 and rows["i"].payment_amount == float("inf")
    assert rows["n"].priority_tier == rows["i"].priority_tier == "LOW"


def test_ranking_breaks_ties_by_id(spark):
    df = frame(spark, ("B", 1000, 0.5, 0, 0), ("C", 2000, 0.5, 0, 0), ("A", 1000, 0.5, 0, 0))
    ranked = P.rank_queue(df).orderBy("priority_rank").collect()
    assert [(r.payment_id, r.priority_rank) for r in ranked] == [("C", 1), ("A", 2), ("B", 3)]


def test_example_events(spark):
    examples = {
        "A": dict(payment_amount=5000, failure_reason="technical_error", payment_method="upi",
                  is_subscription=0, customer_tenure_months=24, past_successful_payments=10,
                  past_failed_payments=0, historical_success_rate=1.0, time_since_last_success_days=5,
                  days_overdue=1, recovery_attempts_so_far=0),
        "C": dict(payment_amount=8000, failure_reason="invalid_card", payment_method="credit_card",
                  is_subscription=0, customer_tenure_months=2, past_successful_payments=0,
                  past_failed_payments=4, historical_success_rate=0.0, time_since_last_success_days=999,
                  days_overdue=15, recovery_attempts_so_far=3),
        "bad": {**VALID, "payment_amount": -1}}
    rows = [(json.dumps({**e, "payment_id": k, "idempotency_key": f"k-{k}"}),) for k, e in examples.items()]
    parsed = decide.parse_events(spark.createDataFrame(rows, "value string"))
    got = {r.event_identity.payment_id: r for r in decide.respond(parsed).collect()}
    assert got["A"].prediction.recovery_probability > 0.65
    assert got["A"].decision.recommended_action == "Retry Payment"
    assert got["A"].processing_metadata.status == "success"
    assert got["A"].event_identity.idempotency_key_source == "caller_supplied"
    assert got["A"].explanation.key_input_factors[0] == "Payment amount: ₹5,000.00"
    assert got["C"].decision.recommended_action == "Manual Review / Stop Automatic Retry"
    assert got["C"].bounded_recovery.policy_decision == "BLOCKED"
    assert got["bad"].processing_metadata.error_type == "validation_error"
    assert got["bad"].prediction is None and got["bad"].validation.errors == [
        "payment_amount must be greater than 0"]


def test_duplicates_answer_with_the_stored_decision(spark):
    event = {**VALID, "idempotency_key": "k"}
    parsed = decide.parse_events(spark.createDataFrame([(json.dumps(event),)], "value string"))
    known = spark.sql("select 'k' idempotency_key, 'Retry Payment' recommended_action, "
                      "'HIGH' recovery_priority, 0.9 model_probability, 4500.0 expected_recovery")
    row = decide.respond(parsed, known).collect()[0]
    assert row.processing_metadata.status == "duplicate" and row.persistence.is_duplicate
    assert row.prediction.recovery_probability == 0.9 and row.bounded_recovery is None


def test_key_resolution(spark):
    df = spark.sql("select * from values ('k', 'e'), ('', 'e'), (null, null) t(idempotency_key, event_id)")
    rows = decide.resolve_idempotency(df).collect()
    assert [r.idempotency_key_source for r in rows] == [
        "caller_supplied", "event_id_fallback", "request_scoped_fallback"]
    assert rows[0].idempotency_key == "k" and rows[1].idempotency_key == "e"
    assert len(rows[2].idempotency_key) >= 32
