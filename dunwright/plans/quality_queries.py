"""Validation, data quality, monitoring and descriptive profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import NUMERIC_FEATURES
from ..operators import decide as D, monitoring as M, quality as Q
from ..operators.ordering import materialize
from .registry import Tables, digits, money, query, whole

# Rows of the payments with one field broken per residue of the event number.
_NUMBER = "cast(substring(payment_id, 5) as bigint)"
_BREAKS = {
    "payment_amount": "case {n} % 16 when 1 then cast(0 as double) when 2 then cast(-100 as double)"
                      " when 3 then cast('NaN' as double) when 4 then cast('Infinity' as double)"
                      " else cast(payment_amount as double) end",
    "historical_success_rate": "case when {n} % 16 in (2, 5) then cast(1.5 as double) when {n} % 16 = 6"
                               " then cast(-0.5 as double) else historical_success_rate end",
    "is_subscription": "case when {n} % 16 in (2, 7) then cast(2 as double) when {n} % 16 = 8"
                       " then cast(0.5 as double) else cast(is_subscription as double) end",
    "failure_reason": "case when {n} % 16 = 9 then 'stolen_card' when {n} % 16 = 10 then null"
                      " else failure_reason end",
    "payment_method": "case when {n} % 16 = 11 then 'crypto' else payment_method end",
    "past_successful_payments": "case when {n} % 16 = 12 then cast(1.5 as double)"
                                " else cast(past_successful_payments as double) end",
    "past_failed_payments": "case when {n} % 16 = 13 then cast(-1 as double)"
                            " else cast(past_failed_payments as double) end",
    "days_overdue": "case when {n} % 16 = 14 then cast(-1 as double)"
                    " else cast(days_overdue as double) end",
    "recovery_attempts_so_far": "case when {n} % 16 = 15 then null"
                                " else cast(recovery_attempts_so_far as double) end",
    "customer_tenure_months": "cast(customer_tenure_months as double)",
    "time_since_last_success_days": "case when {n} % 16 = 14 then cast(-2 as double)"
                                    " else cast(time_since_last_success_days as double) end",
}
_BROKEN = [f"{sql.format(n=_NUMBER)} as {name}" for name, sql in _BREAKS.items()]
_BROKEN_SQL = f", broken AS (SELECT payment_id, {', '.join(_BROKEN)} FROM payments)"


def _number_sql(name: str, rule: str, message: str, integral: bool = False) -> str:
    whole_check = f"WHEN {name} <> floor({name}) THEN '{name} must be an integer' " if integral else ""
    return (f"CASE WHEN isnan({name}) OR isinf({name}) THEN '{name} must be finite' {whole_check}"
            f"WHEN NOT ({name} {rule}) THEN '{name} {message}' END")


_ORDER = ["payment_amount", "failure_reason", "payment_method", "is_subscription",
          "customer_tenure_months", "past_successful_payments", "past_failed_payments",
          "historical_success_rate", "time_since_last_success_days", "days_overdue",
          "recovery_attempts_so_far"]
_VALIDATED_SQL = _BROKEN_SQL + f""", checked AS (
  SELECT *, concat_ws('; ', {', '.join(
      f"CASE WHEN {n} IS NULL THEN '{n} cannot be null' END" for n in _ORDER)}) AS missing,
    concat_ws('; ', {', '.join([
        _number_sql("payment_amount", "> 0", "must be greater than 0"),
        _number_sql("customer_tenure_months", ">= 0", "must be >= 0"),
        _number_sql("past_successful_payments", ">= 0", "must be >= 0", True),
        _number_sql("past_failed_payments", ">= 0", "must be >= 0", True),
        _number_sql("historical_success_rate", "BETWEEN 0 AND 1", "must be between 0 and 1"),
        _number_sql("time_since_last_success_days", ">= 0", "must be >= 0"),
        _number_sql("days_overdue", ">= 0", "must be >= 0"),
        _number_sql("recovery_attempts_so_far", ">= 0", "must be >= 0", True),
        _number_sql("is_subscription", "IN (0, 1)", "must be 0 or 1", True),
        "CASE WHEN failure_reason NOT IN ('insufficient_funds', 'invalid_card', 'technical_error',"
        " 'limit_exceeded') THEN 'Unsupported failure_reason: ' || failure_reason END",
        "CASE WHEN payment_method NOT IN ('credit_card', 'debit_card', 'upi', 'bank_transfer')"
        " THEN 'Unsupported payment_method: ' || payment_method END"])}) AS found
  FROM broken
), validated AS (
  SELECT *, CASE WHEN missing <> '' THEN missing ELSE found END AS errors FROM checked)"""


def _broken(t: Tables) -> DataFrame:
    return t.payments.selectExpr("payment_id", *_BROKEN)


@query("validate_records", _VALIDATED_SQL + """
SELECT payment_id, errors, errors = '' AS is_valid FROM validated""")
def validate_records(t: Tables) -> DataFrame:
    return D.validate(_broken(t)).selectExpr(
        "payment_id", "concat_ws('; ', errors) errors", "is_valid")


@query("validate_json_events", _VALIDATED_SQL + """
SELECT payment_id, errors FROM validated""")
def validate_json_events(t: Tables) -> DataFrame:
    """The same checks over JSON text (NULLs written as JSON nulls)."""
    as_json = _broken(t).selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) value")
    return D.parse_events(as_json).selectExpr(
        "payment_id", "concat_ws('; ', errors) errors")


# Every row, and those with an odd number a second time.
_COPIED_SQL = _VALIDATED_SQL + f""", copied AS (
  SELECT * FROM validated
  UNION ALL SELECT * FROM validated WHERE {_NUMBER} % 2 = 1)"""


def _copied(t: Tables) -> DataFrame:
    return _broken(t).withColumn("_copies", F.expr(
        f"explode(sequence(0, cast({_NUMBER} % 2 as int)))")).drop("_copies")


@query("data_quality", _COPIED_SQL + f""", distinct_rows AS (SELECT DISTINCT * FROM copied)
SELECT count(*) AS total_records, count(*) - (SELECT count(*) FROM distinct_rows) AS duplicate_count,
  count(*) FILTER (WHERE errors <> '') AS validation_failure_count,
  round(count(*) FILTER (WHERE errors <> '')::DOUBLE / count(*), 4) AS validation_failure_rate,
  {', '.join(f"count(*) FILTER (WHERE {n} IS NULL" + (f" OR isnan({n})" if n not in (
      "failure_reason", "payment_method") else "") + f") AS missing_{n}" for n in _ORDER)},
  {' + '.join(f"count(*) FILTER (WHERE {n} IS NULL" + (f" OR isnan({n})" if n not in (
      "failure_reason", "payment_method") else "") + ")" for n in _ORDER)} AS missing_value_count
FROM copied""")
def data_quality(t: Tables) -> DataFrame:
    return Q.data_quality(materialize(_copied(t))).drop("missing_payment_id")


@query("null_duplicate_totals", _COPIED_SQL + """
SELECT count(*) - count(failure_reason) + count(*) - count(recovery_attempts_so_far)
    + count(*) FILTER (WHERE isnan(payment_amount)) AS missing_values,
  count(*) - count(DISTINCT payment_id) AS duplicate_rows FROM copied""")
def null_duplicate_totals(t: Tables) -> DataFrame:
    return Q.data_quality(materialize(_copied(t))).selectExpr(
        "missing_value_count missing_values", "duplicate_count duplicate_rows")


@query("dataset_checks", _BROKEN_SQL + """, joined AS (
  SELECT b.*, p.recovered FROM broken b JOIN payments p USING (payment_id))
SELECT 'negative_payment_amount' AS "check", count(*) FILTER (WHERE payment_amount < 0) AS violations FROM joined
UNION ALL SELECT 'success_rate_out_of_bounds', count(*) FILTER (WHERE historical_success_rate NOT BETWEEN 0 AND 1) FROM joined
UNION ALL SELECT 'invalid_subscription_flag', count(*) FILTER (WHERE is_subscription NOT IN (0, 1)) FROM joined
UNION ALL SELECT 'invalid_target', count(*) FILTER (WHERE recovered NOT IN (0, 1)) FROM joined""")
def dataset_checks(t: Tables) -> DataFrame:
    return Q.dataset_checks(t.payments.selectExpr("payment_id", *_BROKEN, "recovered"))


_NUMERIC = ["payment_amount", "customer_tenure_months", "past_successful_payments",
            "past_failed_payments", "historical_success_rate", "time_since_last_success_days",
            "is_subscription", "days_overdue", "recovery_attempts_so_far"]


@query("leakage_check", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}::DOUBLE, recovered::DOUBLE), 6) AS correlation, "
    f"coalesce(abs(corr({c}::DOUBLE, recovered::DOUBLE)) > 0.8, false) AS suspicious FROM payments"
    for c in _NUMERIC))
def leakage_check(t: Tables) -> DataFrame:
    return Q.leakage_check(t.payments.select(*_NUMERIC, "recovered")).selectExpr(
        "feature", digits("correlation"), "suspicious")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
    f"round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS correlation FROM payments"
    for i, a in enumerate([*_NUMERIC, "recovered"]) for b in [*_NUMERIC, "recovered"][i + 1:]))
def correlation_matrix(t: Tables) -> DataFrame:
    return Q.correlation_matrix(t.payments, [*_NUMERIC, "recovered"]).selectExpr(
        "feature_a", "feature_b", digits("correlation"))


@query("prediction_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(sum({c})::DOUBLE / count(*), 6) AS mean, "
    f"round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, {digits(f'min({c})::DOUBLE', 'min')}, "
    f"{digits(f'max({c})::DOUBLE', 'max')}, round(stddev_samp({c}::DOUBLE), 6) AS std FROM scored"
    for c in ("recovery_probability", "expected_recovery")))
def prediction_summary(t: Tables) -> DataFrame:
    return M.prediction_summary(t.scored_table).selectExpr(
        "feature", *[digits(c) for c in ("mean", "median", "min", "max", "std")])


# Drift: the first half of the month is the reference, the second half the current data.
SPLIT = "failed_at < timestamp '2024-01-16 00:00:00'"
_SIDES_SQL = f", sides AS (SELECT *, {SPLIT} AS is_reference FROM payments)"


def _numeric_psi_sql(feature: str) -> str:
    quantiles = ", ".join(str(i / 10) for i in range(11))
    v = f"{feature}::DOUBLE"
    return f"""
  SELECT '{feature}' AS feature, 'numeric' AS type,
    coalesce((SELECT sum((a - e) * ln(a / e)) FROM (
      SELECT CASE WHEN ref = 0 THEN 0.0001 ELSE ref / sum(ref) OVER () END AS e,
        CASE WHEN cur = 0 THEN 0.0001 ELSE cur / sum(cur) OVER () END AS a
      FROM (SELECT (SELECT count(*) FROM edges_{feature} WHERE inner_edge AND {v} >= edge) AS bin,
          count(*) FILTER (WHERE is_reference)::DOUBLE AS ref,
          count(*) FILTER (WHERE NOT is_reference)::DOUBLE AS cur FROM sides GROUP BY bin))), 0) AS psi
""", f""", edges_{feature} AS (
  SELECT edge, edge > min(edge) OVER () AND edge < max(edge) OVER () AS inner_edge FROM (
    SELECT DISTINCT round(unnest(quantile_cont({v}, [{quantiles}])), 6) AS edge
    FROM sides WHERE is_reference))"""


def _categorical_psi_sql(feature: str) -> str:
    return f"""
  SELECT '{feature}' AS feature, 'categorical' AS type, (SELECT sum((a - e) * ln(a / e)) FROM (
      SELECT CASE WHEN ref = 0 THEN 0.0001 ELSE ref / sum(ref) OVER () END AS e,
        CASE WHEN cur = 0 THEN 0.0001 ELSE cur / sum(cur) OVER () END AS a
      FROM (SELECT {feature}, count(*) FILTER (WHERE is_reference)::DOUBLE AS ref,
          count(*) FILTER (WHERE NOT is_reference)::DOUBLE AS cur FROM sides GROUP BY {feature}))) AS psi
"""


_NUMERIC_PARTS = [_numeric_psi_sql(f) for f in M.NUMERIC_DRIFT]
_NUMERIC_PSI = (_SIDES_SQL + "".join(ctes for _, ctes in _NUMERIC_PARTS),
                " UNION ALL ".join(body for body, _ in _NUMERIC_PARTS))
_CATEGORICAL_PSI = " UNION ALL ".join(map(_categorical_psi_sql, M.CATEGORICAL_DRIFT))
_REPORT_SQL = """SELECT feature, type, round(psi, 4) AS drift_metric_psi,
  CASE WHEN psi < 0.1 THEN 'NORMAL' WHEN psi < 0.2 THEN 'WARNING' ELSE 'DRIFT' END AS status"""


def _sides(t: Tables) -> DataFrame:
    # three uses (percentiles, numeric bins, categories), so the narrow table is written once
    return materialize(t.payments.selectExpr(
        *M.NUMERIC_DRIFT, *M.CATEGORICAL_DRIFT, f"{SPLIT} is_reference"))


@query("psi_numeric", _NUMERIC_PSI[0] + f" SELECT feature, round(psi, 4) AS psi FROM ({_NUMERIC_PSI[1]})")
def psi_numeric(t: Tables) -> DataFrame:
    return M.numeric_psi(_sides(t), list(M.NUMERIC_DRIFT), edge_digits=6).selectExpr("feature", "round(psi, 4) psi")


@query("psi_categorical", _SIDES_SQL + f" SELECT feature, round(psi, 4) AS psi FROM ({_CATEGORICAL_PSI})")
def psi_categorical(t: Tables) -> DataFrame:
    return M.categorical_psi(t.payments.selectExpr("*", f"{SPLIT} is_reference"), list(
        M.CATEGORICAL_DRIFT)).selectExpr("feature", "round(psi, 4) psi")


DRIFT_REPORT_SQL = _NUMERIC_PSI[0] + f" {_REPORT_SQL} FROM ({_NUMERIC_PSI[1]} UNION ALL {_CATEGORICAL_PSI})"


@query("drift_report", DRIFT_REPORT_SQL)
def drift_report(t: Tables) -> DataFrame:
    return M.drift_report(_sides(t), edge_digits=6)


@query("recovery_rates", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value, count(*) AS payments, "
    f"round(avg(recovered), 6) AS recovery_rate FROM payments GROUP BY {d}"
    for d in M.CATEGORICAL_DRIFT))
def recovery_rates(t: Tables) -> DataFrame:
    return M.recovery_rates(t.payments).selectExpr(
        "dimension", "value", "payments", digits("recovery_rate"))


@query("recovery_by_rate_bin", """, span AS (
  SELECT min(historical_success_rate) AS lo, max(historical_success_rate) AS hi FROM payments
), edges AS (
  SELECT lo + (hi - lo) / 10.0::DOUBLE * i AS edge FROM span, range(1, 10) r(i)
), binned AS (
  SELECT recovered, (SELECT count(*) FROM edges WHERE historical_success_rate > edge) AS bin FROM payments)
SELECT bin, round(CASE WHEN bin = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + (hi - lo) / 10 * bin END, 6) AS lower,
  round(lo + (hi - lo) / 10 * (bin + 1), 6) AS upper, count(*) AS payments,
  round(avg(recovered), 6) AS recovery_rate FROM binned, span GROUP BY bin, lo, hi""")
def recovery_by_rate_bin(t: Tables) -> DataFrame:
    return M.recovery_by_bin(t.payments).selectExpr(
        whole("bin"), digits("lower"), digits("upper"), "payments", digits("recovery_rate"))


@query("class_balance", """
SELECT recovered::BIGINT AS recovered, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
FROM payments GROUP BY recovered""")
def class_balance(t: Tables) -> DataFrame:
    return M.value_counts(t.payments, "recovered").selectExpr(whole("recovered"), "n", digits("share"))


@query("action_distribution", """
SELECT recommended_action, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
FROM scored GROUP BY recommended_action""")
def action_distribution(t: Tables) -> DataFrame:
    return M.value_counts(t.scored, "recommended_action").selectExpr(
        "recommended_action", "n", digits("share"))


@query("distinct_reasons", "SELECT DISTINCT failure_reason FROM payments")
def distinct_reasons(t: Tables) -> DataFrame:
    return M.distinct_values(t.payments, "failure_reason")


@query("probability_histogram", """
SELECT least(floor(p / 0.1::DOUBLE), 9)::BIGINT AS bin, count(*) AS n FROM scored GROUP BY bin""")
def probability_histogram(t: Tables) -> DataFrame:
    return M.histogram(t.scored, "recovery_probability", 0.0, 1.0, 10).selectExpr(whole("bin"), "n")


@query("amount_histogram", """, x AS (SELECT log10(payment_amount::DOUBLE) AS x FROM payments),
  span AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
SELECT least(floor((x - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, count(*) AS n FROM x, span GROUP BY bin""")
def amount_histogram(t: Tables) -> DataFrame:
    return M.log_histogram(t.payments, "payment_amount").selectExpr(whole("bin"), "n")


@query("scoring_inputs", f"""
SELECT count(*) AS n, {', '.join(f"{digits(f'avg({c}::DOUBLE)', f'avg_{c}')}" for c in NUMERIC_FEATURES)}
FROM payments""")
def scoring_inputs(t: Tables) -> DataFrame:
    """Model inputs after identifiers and target are dropped."""
    inputs = D.drop_identifiers(t.payments)
    return inputs.agg(F.expr("count(1) n"), *[
        F.expr(digits(f"avg(cast({c} as double))", f"avg_{c}")) for c in NUMERIC_FEATURES
        if c in inputs.columns])


@query("monitoring_overview", f"""
SELECT count(*) AS total_records, 0::BIGINT AS missing_values, 0::BIGINT AS validation_failures,
  {digits('sum(recovery_probability)::DOUBLE / count(*)', 'mean_probability')},
  {money('sum(expected_recovery)', 'expected_recovery')} FROM scored""")
def monitoring_overview(t: Tables) -> DataFrame:
    quality = Q.data_quality(t.scored_table.drop("failed_at", "next_ok_ts"))
    means = t.scored_table.agg(F.expr("cast(sum(recovery_probability) as double) / count(1) m"),
                         F.expr("sum(expected_recovery) e"))
    return quality.withColumns({
        "m": means.select("m").scalar(), "e": means.select("e").scalar()}).selectExpr(
        "total_records", "missing_value_count missing_values",
        "validation_failure_count validation_failures", digits("m", "mean_probability"),
        money("e", "expected_recovery"))
