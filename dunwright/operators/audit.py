"""Audit records, their summary and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DO_NOTHING, MANUAL_OR_STOP, REMINDER, RETRY, TraceConfig
from ..functions import decisions as D
from ..functions.scalars import audit_id, dec, join_factors, ratio, text, utc_text
from .lookup import keep_matching

OUTCOMES = (
    ("simulated_recovered", "int"), ("simulated_recovered_revenue", "decimal(14,2)"),
    ("action_cost", "decimal(10,2)"), ("net_recovered_revenue", "decimal(14,2)"))


def audit_records(df: DataFrame, strategy: str, timestamp: str | None = None,
                  trace: TraceConfig = TraceConfig()) -> DataFrame:
    """17-column audit rows of scored or simulated payments.

    Absent columns take their defaults, a supplied expected value stays as it is; a
    caller-supplied timestamp makes the audit ids repeatable.
    """
    have = set(df.columns)
    or_else = lambda name, default: (
        f"coalesce({name}, {default})" if name in have else default)
    action = next((c for c in ("simulated_action", "recommended_action") if c in have), "'Unknown'")
    moment = text(timestamp) if timestamp else utc_text()
    stated = or_else("priority", "'UNKNOWN'")
    base = df.withColumns({
        "_id": F.expr(f"cast({or_else('payment_id', text('UNKNOWN'))} as string)"),
        "_p": F.expr(or_else("recovery_probability", dec(0, 7, 6))),
        "_moment": F.expr(moment),
        "_action": F.expr(action),
    }).withColumn("_value", F.expr(
        f"cast({or_else('expected_recovery', or_else('payment_amount', dec(0)) + ' * _p')} as decimal(20,8))"))
    return base.selectExpr(
        f"{audit_id('_id', text(strategy), '_moment')} audit_id",
        "_id payment_id", "_moment timestamp", "_p model_probability",
        f"case when {stated} = 'UNKNOWN' then {D.priority_band('_p')} else {stated} end "
        "recovery_priority",
        "_action recommended_action",
        f"{dec(trace.decision_threshold, 5, 4)} decision_threshold",
        f"{dec(trace.effective_retry_cost, 10, 2)} effective_retry_cost",
        "_value expected_recovery",
        f"{D.retry_net_value('_value', trace)} expected_retry_net_value",
        f"{D.decision_reason('_action', '_value', trace)} decision_reason",
        f"{join_factors(D.key_input_factors(df.columns))} key_input_factors",
        f"{text(strategy)} strategy_name",
        *[name if name in have else f"cast(null as {kind}) {name}" for name, kind in OUTCOMES])


def audit_summary(audit: DataFrame) -> DataFrame:
    """Totals of an audit history; outcome totals only where any outcome is known."""
    have = "simulated_recovered" in audit.columns
    counted = lambda action, name: f"count_if(recommended_action = {text(action)}) {name}"
    outcome = lambda total, kind, name: (
        f"case when count(simulated_recovered) > 0 then {total} end {name}" if have
        else f"cast(null as {kind}) {name}")
    return audit.agg(*[F.expr(e) for e in (
        "count(1) total_audit_records",
        counted(RETRY, "retry_decisions"), counted(REMINDER, "reminder_decisions"),
        counted(MANUAL_OR_STOP, "manual_review_decisions"),
        counted(DO_NOTHING, "do_nothing_decisions"),
        f"{ratio('sum(model_probability)', 'count(model_probability)')} average_model_probability",
        f"coalesce(sum(expected_recovery), {dec(0)}) total_expected_recovery",
        f"coalesce(sum(expected_retry_net_value), {dec(0)}) total_expected_retry_net_value",
        outcome("sum(cast(simulated_recovered as bigint))", "bigint", "simulated_recovery_count"),
        outcome("sum(simulated_recovered_revenue)", "decimal(24,2)", "simulated_recovered_revenue"),
        outcome("sum(net_recovered_revenue)", "decimal(24,2)", "simulated_net_recovered_revenue"))])


def filter_audit(audit: DataFrame, action: str | None = None, priority: str | None = None,
                 strategy: str | None = None) -> DataFrame:
    """Optional equality filters; None keeps everything."""
    return keep_matching(audit, recommended_action=action, recovery_priority=priority,
                         strategy_name=strategy)
