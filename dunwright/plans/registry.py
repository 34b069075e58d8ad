"""The query registry and the SQL the oracles share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.decide import score_payments
from ..operators.ordering import materialize
from ..sources.readers import payments_from_event_table

_QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """What a query can read: the data folder, seen as failed payments."""

    spark: SparkSession
    folder: str

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events.parquet")

    @cached_property
    def payments(self) -> DataFrame:
        return payments_from_event_table(self.spark, self.folder)

    @cached_property
    def scored(self) -> DataFrame:
        return score_payments(self.payments)

    @cached_property
    def scored_table(self) -> DataFrame:
        """Scored payments written once, for queries that pass over them several times."""
        return materialize(self.scored)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is appended to the shared WITH clause of the oracle."""
    def register(run: Callable[[Tables], DataFrame]):
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = BASE_SQL + sql
        return run
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run):
        return lambda spark, folder: run(Tables(spark, folder))
    return {name: bind(run) for name, run in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def money(value: str, name: str | None = None) -> str:
    """Exact decimals shown as doubles with four digits (same text in both engines)."""
    shown = f"cast(cast(round({value}, 4) as decimal(18,4)) as double)"
    return f"{shown} as {name or value}"


def digits(value: str, name: str | None = None, n: int = 6) -> str:
    return f"round({value}, {n}) as {name or value}"


def whole(value: str, name: str | None = None) -> str:
    return f"cast({value} as bigint) as {name or value}"


# Failed payments and their scores, derived from the events view by plain window functions.
BASE_SQL = """
WITH log AS (
  SELECT *,
    coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER before, 0) AS s,
    coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER before, 0) AS f,
    max(CASE WHEN event_type = 'purchase' THEN ts END) OVER before AS last_ok,
    min(ts) OVER (PARTITION BY user_id) AS first_ts,
    min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id
      ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ok,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k
  FROM events
  WINDOW before AS (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), failures AS (
  SELECT *,
    row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) - 1 AS run_fails,
    min(ts) OVER (PARTITION BY user_id, s) AS run_first
  FROM log WHERE event_type = 'error'
), payments AS (
  SELECT 'pay_' || lpad(event_id::VARCHAR, 10, '0') AS payment_id,
    'cust_' || user_id AS customer_id,
    CAST(round(greatest(10.0, least(50000.0, value * 100)), 2) AS DECIMAL(14,2)) AS payment_amount,
    CASE WHEN k <= 4 THEN 'insufficient_funds' WHEN k <= 6 THEN 'invalid_card'
      WHEN k <= 8 THEN 'technical_error' ELSE 'limit_exceeded' END AS failure_reason,
    CASE WHEN event_id % 10 <= 3 THEN 'credit_card' WHEN event_id % 10 <= 6 THEN 'debit_card'
      WHEN event_id % 10 <= 8 THEN 'upi' ELSE 'bank_transfer' END AS payment_method,
    1 + 2 * ((epoch_us(ts) - epoch_us(first_ts)) // 86400000000) AS customer_tenure_months,
    s::BIGINT AS past_successful_payments, f::BIGINT AS past_failed_payments,
    CASE WHEN s + f > 0 THEN ((200 * s + s + f)::BIGINT // (2 * (s + f))::BIGINT) / 100.0::DOUBLE
      ELSE 0.5::DOUBLE END AS historical_success_rate,
    CASE WHEN last_ok IS NULL THEN 365
      ELSE greatest(1, (epoch_us(ts) - epoch_us(last_ok)) // 86400000000) END
      AS time_since_last_success_days,
    CASE WHEN user_id % 10 >= 3 THEN 1 ELSE 0 END AS is_subscription,
    least(29, 1 + (epoch_us(ts) - epoch_us(run_first)) // 86400000000) AS days_overdue,
    least(3, run_fails) AS recovery_attempts_so_far,
    CASE WHEN epoch_us(next_ok) - epoch_us(ts) <= 259200000000 THEN 1 ELSE 0 END AS recovered,
    ts AS failed_at, next_ok AS next_ok_ts, event_id
  FROM failures
), weighed AS (
  SELECT *, CAST(round(1.0 / (1.0 + exp(-(
      -0.5::DOUBLE + 3.0::DOUBLE * (historical_success_rate - 0.5::DOUBLE)
      + 1.5::DOUBLE * (customer_tenure_months / 60.0::DOUBLE)
      - time_since_last_success_days / 365.0::DOUBLE
      - 0.3::DOUBLE * past_failed_payments - 2.0::DOUBLE * (days_overdue / 30.0::DOUBLE)
      - 0.5::DOUBLE * recovery_attempts_so_far + 0.8::DOUBLE * is_subscription
      + CASE failure_reason WHEN 'technical_error' THEN 2.0::DOUBLE
          WHEN 'limit_exceeded' THEN -0.5::DOUBLE WHEN 'invalid_card' THEN -2.0::DOUBLE
          ELSE 0.0::DOUBLE END))), 6) AS DECIMAL(7,6)) AS recovery_probability
  FROM payments
), scored AS (
  SELECT *, CAST(payment_amount * recovery_probability AS DECIMAL(20,8)) AS expected_recovery,
    recovery_probability::DOUBLE AS p,
    CASE WHEN recovery_probability::DOUBLE >= 0.65::DOUBLE THEN 'HIGH'
      WHEN recovery_probability::DOUBLE >= 0.35::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    CASE WHEN recovery_probability::DOUBLE >= 0.65::DOUBLE THEN 'Retry Payment'
      WHEN recovery_probability::DOUBLE >= 0.35::DOUBLE THEN 'Payment Method Reminder'
      ELSE 'Manual Review / Stop Automatic Retry' END AS recommended_action,
    ('0x' || substr(sha256('pay_' || lpad(event_id::VARCHAR, 10, '0')), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS draw
  FROM weighed
), judged AS (
  SELECT *,
    CASE WHEN recovery_attempts_so_far >= 2 THEN 'MAX_ATTEMPTS'
      WHEN payment_amount > 25000 THEN 'HIGH_VALUE'
      WHEN p < 0.05::DOUBLE THEN 'LOW_PROBABILITY'
      WHEN expected_recovery <= 50 THEN 'LOW_VALUE' ELSE 'ALLOWED' END AS reason_code
  FROM scored
), policed AS (
  SELECT *,
    CASE reason_code WHEN 'ALLOWED' THEN 'ALLOWED' WHEN 'HIGH_VALUE' THEN 'MANUAL_REVIEW'
      ELSE 'BLOCKED' END AS policy_decision,
    CASE reason_code WHEN 'ALLOWED' THEN recommended_action WHEN 'HIGH_VALUE' THEN 'Manual Review'
      ELSE 'Stop Automatic Recovery' END AS selected_action,
    CASE reason_code
      WHEN 'MAX_ATTEMPTS' THEN 'Maximum automatic recovery attempts reached (2).'
      WHEN 'HIGH_VALUE' THEN 'Payment amount (₹' || payment_amount::VARCHAR
        || ') exceeds high-value threshold (₹25000.00).'
      WHEN 'LOW_PROBABILITY' THEN 'Recovery probability ('
        || CAST(round(recovery_probability, 3) AS DECIMAL(7,3))::VARCHAR
        || ') is below minimum threshold (0.05).'
      WHEN 'LOW_VALUE' THEN 'Expected recovery (₹'
        || CAST(round(expected_recovery, 2) AS DECIMAL(18,2))::VARCHAR
        || ') does not exceed effective retry cost (₹50.00).'
      ELSE 'Policy checks passed. Automatic recovery allowed.' END AS policy_reason
  FROM judged
), traced AS (
  SELECT *, expected_recovery - 50 AS net_value,
    'The model estimates the probability of recovery based on payment characteristics. '
    || CASE recommended_action
      WHEN 'Retry Payment' THEN 'Under the simulation assumptions, the expected recovery (₹'
        || format('{:,.2f}', round(expected_recovery, 2)::DOUBLE)
        || CASE WHEN expected_recovery > 50
          THEN ') exceeds the effective retry cost (₹50.00), so an automated retry is economically justified.'
          ELSE ') is lower than the effective retry cost (₹50.00), meaning an automated retry is not mathematically optimal despite the priority band.' END
      WHEN 'Payment Method Reminder' THEN 'The Stage 5 rule-based engine places this payment in the reminder band. The simulator threshold is a separate strategy-analysis control. (Hypothetically, an automated direct retry would yield a net expected value of ₹'
        || format('{:,.2f}', round(expected_recovery - 50, 2)::DOUBLE)
        || ' under simulation assumptions).'
      ELSE 'The Stage 5 rule-based engine places this payment below the automatic-retry band, so automatic retry is stopped. The model estimates very low recovery probability.' END
    AS explanation,
    'Payment amount: ₹' || format('{:,.2f}', payment_amount::DOUBLE)
    || ' | Historical success rate: ' || round_even(historical_success_rate * 100, 0)::BIGINT || '%'
    || ' | Past successful payments: ' || past_successful_payments
    || ' | Past failed payments: ' || past_failed_payments
    || ' | Failure reason: ' || failure_reason
    || ' | Recovery attempts so far: ' || recovery_attempts_so_far
    || ' | Days overdue: ' || days_overdue AS factors
  FROM policed
), valued AS (
  SELECT *, expected_recovery * (CASE WHEN is_subscription = 1 THEN 1.5 ELSE 1.0 END) AS adjusted
  FROM scored
), tiered AS (
  SELECT *, CASE WHEN adjusted >= 10000 THEN 'CRITICAL' WHEN adjusted >= 2500 THEN 'HIGH'
      WHEN adjusted >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
    row_number() OVER (ORDER BY adjusted DESC, payment_id) AS queue_rank
  FROM valued
), steps AS (
  SELECT i, i * 0.05::DOUBLE AS t FROM range(20) r(i)
), sweep AS (
  SELECT c.cost, t.t AS threshold, count(*) AS total_payments,
    count(*) FILTER (WHERE p >= t.t) AS retry_count,
    coalesce(sum(expected_recovery) FILTER (WHERE p >= t.t), 0) AS gross,
    coalesce(sum(expected_recovery) FILTER (WHERE p >= t.t), 0)
      - count(*) FILTER (WHERE p >= t.t) * c.cost AS net
  FROM scored, steps t, (VALUES (10), (50), (250)) c(cost) GROUP BY c.cost, t.t
), best AS (
  SELECT * FROM sweep QUALIFY row_number() OVER (PARTITION BY cost ORDER BY net DESC, threshold) = 1
)
"""
