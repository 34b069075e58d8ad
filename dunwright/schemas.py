"""Declared schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DecimalType, DoubleType, IntegerType, ShortType,
    StringType, StructField, StructType, TimestampType,
)

AMOUNT = DecimalType(14, 2)
PROBABILITY = DecimalType(7, 6)
VALUE = DecimalType(20, 8)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


FAILED_PAYMENTS = _struct(
    ("payment_id", StringType()),
    ("customer_id", StringType()),
    ("payment_amount", AMOUNT),
    ("failure_reason", StringType()),
    ("payment_method", StringType()),
    ("customer_tenure_months", IntegerType()),
    ("past_successful_payments", IntegerType()),
    ("past_failed_payments", IntegerType()),
    ("historical_success_rate", DoubleType()),
    ("time_since_last_success_days", IntegerType()),
    ("is_subscription", IntegerType()),
    ("days_overdue", IntegerType()),
    ("recovery_attempts_so_far", IntegerType()),
    ("recovered", IntegerType()),
)

SCORED_PAYMENTS = StructType(FAILED_PAYMENTS.fields + _struct(
    ("recovery_probability", PROBABILITY),
    ("expected_recovery", VALUE),
    ("priority", StringType()),
    ("recommended_action", StringType()),
).fields)

MODEL_VERSIONS = _struct(
    ("model_version_id", StringType(), False),
    ("model_name", StringType(), False),
    ("model_version", StringType(), False),
    ("calibration_version", StringType()),
    ("description", StringType()),
    ("registered_at", TimestampType(), False),
)

PAYMENT_EVENTS = _struct(
    ("event_id", StringType(), False),
    ("payment_id", StringType(), False),
    ("idempotency_key", StringType(), False),
    ("customer_id", StringType()),
    ("event_received_at", TimestampType(), False),
    ("processing_status", StringType(), False),
    ("payment_amount", AMOUNT, False),
    ("failure_reason", StringType(), False),
    ("payment_method", StringType(), False),
    ("is_subscription", ShortType(), False),
    ("customer_tenure_months", DecimalType(8, 2), False),
    ("past_successful_payments", IntegerType(), False),
    ("past_failed_payments", IntegerType(), False),
    ("historical_success_rate", DecimalType(5, 4), False),
    ("time_since_last_success_days", DecimalType(8, 2), False),
    ("days_overdue", DecimalType(8, 2), False),
    ("recovery_attempts_so_far", IntegerType(), False),
    ("raw_event_payload", StringType()),
)

_DECISION_FIELDS = (
    ("model_probability", DecimalType(6, 5), False),
    ("recovery_priority", StringType(), False),
    ("recommended_action", StringType(), False),
    ("expected_recovery", AMOUNT, False),
    ("decision_threshold", DecimalType(5, 4), False),
    ("effective_retry_cost", DecimalType(10, 2), False),
    ("expected_retry_net_value", AMOUNT, False),
    ("strategy_name", StringType(), False),
    ("decision_reason", StringType(), False),
    ("key_input_factors", ArrayType(StringType())),
)

RECOVERY_DECISIONS = _struct(
    ("decision_id", StringType(), False),
    ("event_id", StringType(), False),
    ("model_version_id", StringType()),
    ("decided_at", TimestampType(), False),
    ("processing_time_ms", DecimalType(10, 3)),
    *_DECISION_FIELDS,
)

AUDIT_RECORDS = _struct(
    ("audit_record_id", StringType(), False),
    ("audit_id", StringType(), False),
    ("decision_id", StringType(), False),
    ("payment_id", StringType(), False),
    ("audit_generated_at", TimestampType(), False),
    *_DECISION_FIELDS,
)

RECOVERY_OUTCOMES = _struct(
    ("outcome_id", StringType(), False),
    ("decision_id", StringType(), False),
    ("outcome_recorded_at", TimestampType(), False),
    ("outcome_source", StringType(), False),
    ("action_executed", StringType()),
    ("selected_action", StringType()),
    ("recovery_occurred", BooleanType()),
    ("recovered_amount", AMOUNT),
    ("action_cost", DecimalType(10, 2)),
    ("net_recovered_revenue", AMOUNT),
    ("outcome_notes", StringType()),
)

EVENT_STATUS_LOG = _struct(
    ("event_id", StringType(), False),
    ("processing_status", StringType(), False),
    ("step", IntegerType(), False),
    ("changed_at", TimestampType(), False),
)

STORE_TABLES = {
    "model_versions": MODEL_VERSIONS,
    "payment_events": PAYMENT_EVENTS,
    "recovery_decisions": RECOVERY_DECISIONS,
    "audit_records": AUDIT_RECORDS,
    "recovery_outcomes": RECOVERY_OUTCOMES,
}
