"""Customer history at failure time and the observed-recovery label.

Both look along one customer's events in time order.  A customer can own a third of all rows, and all of them
may fall on one instant, so the events are cut into even ranges of (customer, time, event id).  The history is
scanned inside every range; the last row of a customer that goes on in another range sums the range up; these
few summaries (at most two a range, and one for each range that a customer fills) are composed in order, and
what a range inherits is joined back to its failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import padded_id
from .ordering import even_ranges, materialize

RANGES_A_TASK = 4       # ranges for every shuffle partition
_DAY = 86_400_000_000   # microseconds


def customer_timeline(events: DataFrame, fail: str = "error", ok: str = "purchase",
                      ranges: int | None = None) -> DataFrame:
    """History columns for every failure of an event log.

    ``events(customer, ts, event_id, kind, …)``; kinds other than ``fail`` and ``ok`` only count for
    the first-seen time.  Returns the failures with ``first_ts, succ_before, fail_before, last_ok_ts,
    run_first_ts, run_fails, next_ok_ts`` added.

    The log is read and shuffled once; the local history is written, and its summaries are a filter on it.
    """
    spark = events.sparkSession
    wanted = ranges or RANGES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ("customer", "unix_micros(ts)", "event_id")
    cuts = even_ranges(events.selectExpr("customer", "unix_micros(ts) at", "event_id"), wanted)
    rows = events.selectExpr(
        "* except (kind)", f"coalesce(kind = '{fail}', false) failed", f"coalesce(kind = '{ok}', false) paid",
        f"{cuts.number(*keys)} part")
    local = materialize(
        _local_history(rows, "part, customer").withColumn(
            "sums_up", F.expr(f"is_last and {cuts.splits('customer')}"))
        .filter("failed or sums_up"))
    carried = F.broadcast(_inherited(local.filter("sums_up")))  # bounded by the number of ranges
    return _combined(local.filter("failed"), carried)


def _local_history(rows: DataFrame, group: str) -> DataFrame:
    """History inside one group; one shuffle, one sort per direction."""
    forward = f"partition by {group} order by ts, event_id"
    before = f"{forward} rows between unbounded preceding and 1 preceding"
    upto = f"{forward} rows between unbounded preceding and current row"
    # Running forwards over descending order avoids the quadratic "following" frame.
    after = (f"partition by {group} order by ts desc, event_id desc "
             "rows between unbounded preceding and 1 preceding")
    first_pass = rows.selectExpr(
        "*",
        f"coalesce(sum(cast(paid as bigint)) over ({before}), 0) succ_before",
        f"coalesce(sum(cast(failed as bigint)) over ({before}), 0) fail_before",
        f"min(ts) over ({upto}) first_ts",
        f"min(case when paid then ts end) over ({upto}) first_ok_ts",
        f"max(case when paid then ts end) over ({before}) last_ok_ts")
    second_pass = first_pass.selectExpr(
        "*",
        # failures up to the latest success; grows along the order, so max() is the latest
        f"max(case when paid then fail_before end) over ({upto}) fail_at_ok")
    third_pass = second_pass.selectExpr(
        "*",
        # a run starts with the first failure after the latest success
        f"max(case when failed and fail_before = coalesce(fail_at_ok, 0) then ts end) over ({upto})"
        " run_first_ts")
    return third_pass.selectExpr(
        "*", f"min(case when paid then ts end) over ({after}) next_ok_ts",
        f"count(1) over ({after}) = 0 is_last")


def _inherited(last_rows: DataFrame) -> DataFrame:
    """What each range of a customer inherits from those around it, from the last row of each."""
    sums = last_rows.selectExpr(
        "customer", "part", "succ_before + cast(paid as int) oks", "fail_before + cast(failed as int) fails",
        "first_ts", "first_ok_ts first_ok", "case when paid then ts else last_ok_ts end last_ok",
        "fail_at_ok", "run_first_ts last_run")
    by_part = "partition by customer order by part"
    before = f"{by_part} rows between unbounded preceding and 1 preceding"
    upto = "rows between unbounded preceding and current row"
    # Failures still open at the end of a range started in it (after its last success),
    # or earlier when the range has no success; an epoch is a stretch without success.
    return (
        sums
        .selectExpr(
            "*",
            f"coalesce(sum(oks) over ({before}), 0) c_oks",
            f"coalesce(sum(fails) over ({before}), 0) c_fails",
            f"min(first_ts) over ({before}) c_first",
            f"max(last_ok) over ({before}) c_last_ok",
            "min(first_ok) over (partition by customer order by part desc "
            "rows between unbounded preceding and 1 preceding) c_next_ok",
            f"sum(cast(oks > 0 as int)) over ({by_part} {upto}) epoch",
            "case when oks = 0 or fails > fail_at_ok then last_run end own_open")
        .selectExpr(
            "*",
            f"max(case when oks > 0 then c_fails + fail_at_ok end) over ({before}) c_fail_at_ok",
            f"min(own_open) over (partition by customer, epoch order by part {upto}) open_after")
        .selectExpr(
            "customer c_customer", "part c_part", "c_oks", "c_fails", "c_first", "c_last_ok", "c_fail_at_ok",
            "c_next_ok", f"lag(open_after) over ({by_part}) c_open"))


def _combined(fails: DataFrame, carried: DataFrame) -> DataFrame:
    """Local history plus the inherited part (absent for customers inside one range)."""
    helpers = ("part", "failed", "paid", "is_last", "sums_up", "first_ok_ts", "fail_at_ok")
    replaced = ("fail_before", "succ_before", "first_ts", "last_ok_ts", "run_first_ts", "next_ok_ts")
    return fails.join(carried, F.expr("part = c_part and customer <=> c_customer"), "left").selectExpr(
        f"* except ({', '.join([*helpers, *replaced, *[c for c in carried.columns]])})",
        "coalesce(c_fails, 0) + fail_before fail_before",
        "coalesce(c_oks, 0) + succ_before succ_before",
        "coalesce(c_first, first_ts) first_ts",
        "coalesce(last_ok_ts, c_last_ok) last_ok_ts",
        "coalesce(c_fails, 0) + fail_before"
        " - coalesce(coalesce(c_fails, 0) + fail_at_ok, c_fail_at_ok, 0) run_fails",
        "case when fail_at_ok is null and c_open is not null then c_open else run_first_ts end "
        "run_first_ts",
        "coalesce(next_ok_ts, c_next_ok) next_ok_ts")


def history_features(timeline: DataFrame, label_days: int = 3) -> DataFrame:
    """Feature columns and label from :func:`customer_timeline`."""
    days = lambda start: (
        f"cast((unix_micros(ts) - unix_micros({start})) div {_DAY} as int)")
    return timeline.selectExpr(
        "*",
        f"1 + 2 * {days('first_ts')} customer_tenure_months",
        "cast(succ_before as int) past_successful_payments",
        "cast(fail_before as int) past_failed_payments",
        # half-up to two digits in whole numbers: floor(100·s/n + 1/2) / 100
        "case when succ_before + fail_before > 0 then"
        " ((201 * succ_before + fail_before) div (2 * (succ_before + fail_before))) / 100.0D"
        " else 0.5D end historical_success_rate",
        f"case when last_ok_ts is null then 365 else greatest(1, {days('last_ok_ts')}) end "
        "time_since_last_success_days",
        f"least(29, 1 + {days('run_first_ts')}) days_overdue",
        "cast(least(3, run_fails) as int) recovery_attempts_so_far",
        f"cast(coalesce(unix_micros(next_ok_ts) - unix_micros(ts) <= {label_days * _DAY}, false)"
        " as int) recovered")


def payments_from_events(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Failed payments out of the driver's event log (one row per 'error' event)."""
    # Only compact payload, and only of failures, goes through the shuffle.
    log = events.selectExpr(
        "user_id customer", "cast(ts as timestamp) ts", "event_id", "event_type kind",
        "case when event_type = 'error' then"
        " cast(round(greatest(10.0D, least(50000.0D, value * 100)), 2) as decimal(14,2)) end"
        " payment_amount",
        "case when event_type = 'error' then cast(get_json_object(props, '$.k') as int) % 10 end k")
    return history_features(customer_timeline(log, ranges=ranges)).selectExpr(
        f"{padded_id('pay_', 'event_id', 10)} payment_id",
        "concat('cust_', customer) customer_id",
        "payment_amount",
        "case when k <= 4 then 'insufficient_funds' when k <= 6 then 'invalid_card'"
        " when k <= 8 then 'technical_error' else 'limit_exceeded' end failure_reason",
        "case when event_id % 10 <= 3 then 'credit_card' when event_id % 10 <= 6 then 'debit_card'"
        " when event_id % 10 <= 8 then 'upi' else 'bank_transfer' end payment_method",
        "customer_tenure_months", "past_successful_payments", "past_failed_payments",
        "historical_success_rate", "time_since_last_success_days",
        "case when customer % 10 >= 3 then 1 else 0 end is_subscription",
        "days_overdue", "recovery_attempts_so_far", "recovered", "ts failed_at", "next_ok_ts")
