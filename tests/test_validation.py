"""Validation messages, over typed rows and over JSON text."""

import json

import pytest

from dunwright.functions.validation import probability_error
from dunwright.operators.decide import parse_events, validate

VALID = {
    "payment_id": "pay_1", "payment_amount": 5000.0, "failure_reason": "technical_error",
    "payment_method": "upi", "is_subscription": 0, "customer_tenure_months": 12,
    "past_successful_payments": 5, "past_failed_payments": 1, "historical_success_rate": 0.8,
    "time_since_last_success_days": 15, "days_overdue": 2, "recovery_attempts_so_far": 0,
}
MISSING = object()

CASES = [
    ({}, []),
    ({"payment_amount": MISSING}, ["Missing required feature: payment_amount"]),
    ({"payment_amount": None}, ["payment_amount cannot be null"]),
    ({"payment_amount": None, "days_overdue": -1}, ["payment_amount cannot be null"]),
    ({"payment_amount": 0}, ["payment_amount must be greater than 0"]),
    ({"payment_amount": -100}, ["payment_amount must be greater than 0"]),
    ({"payment_amount": float("nan")}, ["payment_amount must be finite"]),
    ({"payment_amount": float("inf")}, ["payment_amount must be finite"]),
    ({"payment_amount": "five_thousand"}, ["payment_amount must be numeric"]),
    ({"payment_amount": "5d"}, ["payment_amount must be numeric"]),
    ({"payment_amount": "1e3"}, []),
    ({"historical_success_rate": 1.5}, ["historical_success_rate must be between 0 and 1"]),
    ({"historical_success_rate": -0.5}, ["historical_success_rate must be between 0 and 1"]),
    ({"failure_reason": "stolen_card"}, ["Unsupported failure_reason: stolen_card"]),
    ({"payment_method": "crypto"}, ["Unsupported payment_method: crypto"]),
    ({"is_subscription": 2}, ["is_subscription must be 0 or 1"]),
    ({"is_subscription": 0.5}, ["is_subscription must be an integer"]),
    ({"is_subscription": "yes"}, ["is_subscription must be numeric"]),
    ({"is_subscription": True}, []),
    ({"is_subscription": "true"}, ["is_subscription must be numeric"]),
    ({"past_successful_payments": 1.5}, ["past_successful_payments must be an integer"]),
    ({"past_failed_payments": -1}, ["past_failed_payments must be >= 0"]),
    ({"recovery_attempts_so_far": 0.5}, ["recovery_attempts_so_far must be an integer"]),
    ({"customer_tenure_months": -1}, ["customer_tenure_months must be >= 0"]),
    ({"time_since_last_success_days": -1}, ["time_since_last_success_days must be >= 0"]),
    ({"days_overdue": -1}, ["days_overdue must be >= 0"]),
    ({"payment_amount": -100, "historical_success_rate": 1.5, "is_subscription": 2},
     ["payment_amount must be greater than 0", "historical_success_rate must be between 0 and 1",
      "is_subscription must be 0 or 1"]),
]


def test_json_messages(spark):
    rows = []
    for i, (change, _) in enumerate(CASES):
        event = {**VALID, **change, "payment_id": str(i)}
        rows.append((json.dumps({k: v for k, v in event.items() if v is not MISSING}),))
    got = {int(r.payment_id): list(r.errors) for r in parse_events(
        spark.createDataFrame(rows, "value string")).select("payment_id", "errors").collect()}
    assert got == {i: errors for i, (_, errors) in enumerate(CASES)}


def test_unreadable_json_is_missing_everything(spark):
    row = parse_events(spark.createDataFrame([("not json",)], "value string")).collect()[0]
    assert not row.is_valid and len(row.errors) == 11


@pytest.mark.parametrize("change, errors", [
    ({"payment_amount": float("nan")}, ["payment_amount must be finite"]),
    ({"payment_amount": float("-inf")}, ["payment_amount must be finite"]),
    ({"payment_amount": None}, ["payment_amount cannot be null"]),
    ({"historical_success_rate": 1.5}, ["historical_success_rate must be between 0 and 1"]),
])
def test_typed_messages(spark, change, errors):
    event = {**VALID, **change}
    schema = ", ".join(f"{k} {'string' if isinstance(VALID[k], str) else 'double' if isinstance(VALID[k], float) else 'int'}"
                       for k in event)
    row = validate(spark.createDataFrame([tuple(event.values())], schema)).collect()[0]
    assert list(row.errors) == errors and row.is_valid is False


def test_missing_column_makes_every_row_invalid(spark):
    df = spark.createDataFrame([(1.0,)], "payment_amount double")
    row = validate(df).collect()[0]
    assert row.errors[0] == "Missing required feature: failure_reason" and len(row.errors) == 10


def test_probability_messages(spark):
    df = spark.sql("select * from values ('0.5'), ('1.5'), ('NaN'), ('abc') t(p)")
    got = {r.p: r.e for r in df.selectExpr("p", f"{probability_error('p')} e").collect()}
    assert got == {
        "0.5": None, "1.5": "prediction probability must be between 0 and 1",
        "NaN": "prediction probability must be finite", "abc": "prediction probability must be numeric"}
