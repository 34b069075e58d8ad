"""Business-value queue: validity, value, tier, rank and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DecimalType, IntegralType

from ..config import TIERS, PriorityConfig
from ..functions.scalars import dec, double, is_finite, rupees, text
from ..functions.validation import number_of_text
from .lookup import densify
from .ordering import with_global_rank


def with_priority(df: DataFrame, config: PriorityConfig = PriorityConfig()) -> DataFrame:
    """Priority columns of every row, keyed by ``payment_id``.

    Invalid rows get value 0 and tier LOW; their numbers are echoed where they are
    numbers.  Decimal inputs stay exact, doubles stay doubles.
    """
    return _valued(df, config).selectExpr(
        "* except (_valid)", f"{_explanation(config)} priority_explanation")


def _valued(df: DataFrame, config: PriorityConfig) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    is_text = {n: types[n].typeName() == "string" for n in ("payment_amount", "recovery_probability")}
    amount, p = (f"({number_of_text(n)})" if is_text[n] else n
                 for n in ("payment_amount", "recovery_probability"))
    exact = all(isinstance(types[n], DecimalType) for n in ("payment_amount", "recovery_probability"))
    number = (lambda v: dec(v, 14, 1)) if exact else double
    limit = dec if exact else double

    flag_type = types["is_subscription"]
    if isinstance(flag_type, (BooleanType, IntegralType)):
        flag = "cast(is_subscription as int)"
        flag_ok = f"coalesce({flag} in (0, 1), false)"
    else:
        flag, flag_ok = "0", "false"
    valid = (f"coalesce({is_finite(p)} and {is_finite(amount)} and {p} between 0 and 1 "
             f"and {amount} > 0 and {flag_ok}, false)")

    def echoed(name: str, value: str) -> str:
        if is_text[name]:
            return f"case when _valid then {value} else 0.0D end {name}"
        zero = f"cast(0 as {types[name].simpleString()})"
        return (f"case when {name} is null or isnan(cast({name} as double)) then {zero} "
                f"else {name} end {name}")

    fields = ("payment_id", "payment_amount", "recovery_probability", "is_subscription")
    keep = [c for c in df.columns if c not in fields]
    tier = (f"case when priority_value >= {limit(config.critical)} then 'CRITICAL' "
            f"when priority_value >= {limit(config.high)} then 'HIGH' "
            f"when priority_value >= {limit(config.medium)} then 'MEDIUM' else 'LOW' end")
    return (
        df.selectExpr("*", f"{valid} _valid")
        .selectExpr(
            "coalesce(cast(payment_id as string), 'unknown') payment_id",
            echoed("payment_amount", amount), echoed("recovery_probability", p),
            f"case when _valid then {flag} else 0 end is_subscription",
            f"case when _valid then {amount} * {p} else 0 end base_expected_recovery",
            f"cast(case when _valid and {flag} = 1 then {number(config.subscription_multiplier)} "
            f"else {number(1.0)} end as {'decimal(3,1)' if exact else 'double'}) "
            "subscription_multiplier",
            "_valid", *keep)
        .selectExpr("*", "base_expected_recovery * subscription_multiplier "
                         "business_adjusted_expected_recovery")
        .selectExpr("*", "business_adjusted_expected_recovery priority_value")
        .selectExpr("*", f"{tier} priority_tier"))


def _explanation(config: PriorityConfig) -> str:
    subscribed = (" priority. Subscription recovery receives the configured synthetic "
                  f"business-value multiplier ({config.subscription_multiplier}x). "
                  "Business-adjusted recovery value is ")
    plain = " priority based on base expected recovery. Business-adjusted recovery value is "
    return (
        "case when not _valid then "
        "'Invalid input parameters; defaulting to safe LOW priority.' "
        f"else concat(priority_tier, case when is_subscription = 1 then {text(subscribed)} "
        f"else {text(plain)} end, {rupees('priority_value')}, '.') end")


def rank_queue(scored: DataFrame, config: PriorityConfig = PriorityConfig()) -> DataFrame:
    """The whole queue with ``priority_rank``: value descending, payment_id ascending.

    Rows are valued and ranked without their explanation text; it is a pure function
    of the ranked columns and is added afterwards, so it is never shuffled.
    """
    lean = _valued(
        scored.select("payment_id", "payment_amount", "recovery_probability", "is_subscription"),
        config)
    ranked = with_global_rank(
        lean, [F.desc("priority_value"), F.asc("payment_id")], "priority_rank")
    return ranked.selectExpr("* except (_valid)", f"{_explanation(config)} priority_explanation")


def top_of_queue(scored: DataFrame, n: int = 100,
                 config: PriorityConfig = PriorityConfig()) -> DataFrame:
    """The first ``n`` rows of the queue; each task keeps only its own best ``n``."""
    best = with_priority(scored, config).orderBy(F.desc("priority_value"), "payment_id").limit(n)
    return best.select("priority_tier", "payment_id", "priority_value", "payment_amount",
                       "recovery_probability", "is_subscription", "priority_explanation")


def tier_distribution(prioritized: DataFrame) -> DataFrame:
    counts = prioritized.groupBy("priority_tier").agg(F.expr("count(1) payments"))
    return densify(counts, "priority_tier", TIERS, ["payments"])


def tier_by_subscription(prioritized: DataFrame) -> DataFrame:
    """Crosstab of tier and subscription flag."""
    return (prioritized.groupBy("priority_tier").pivot("is_subscription", [0, 1])
            .agg(F.expr("count(1)")).na.fill(0)
            .withColumnsRenamed({"0": "one_off", "1": "subscription"}))


def portfolio_totals(prioritized: DataFrame) -> DataFrame:
    """Totals per tier and for the whole portfolio (tier NULL)."""
    return prioritized.rollup("priority_tier").agg(*[F.expr(e) for e in (
        "count(1) payments", "sum(payment_amount) revenue_at_risk",
        "sum(base_expected_recovery) base_expected",
        "sum(business_adjusted_expected_recovery) business_adjusted")])


def value_concentration(queue: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20)
                        ) -> DataFrame:
    """Value held by the top int(n·share) rows of a ranked queue, and its part of the whole."""
    size = queue.agg(F.expr("count(1) n")).scalar()
    rows = queue.selectExpr("priority_rank", "business_adjusted_expected_recovery v").withColumn(
        "n", size)
    tops = [f"sum(case when priority_rank <= floor(n * {double(s)}) then v end) top{i}"
            for i, s in enumerate(shares)]
    sums = rows.agg(*[F.expr(e) for e in ("sum(v) total", "max(n) n", *tops)])
    entries = ", ".join(
        f"named_struct('share', {double(s)}, 'payments', floor(n * {double(s)}), "
        f"'value', coalesce(top{i}, 0))" for i, s in enumerate(shares))
    return sums.selectExpr(f"inline(array({entries}))", "total").selectExpr(
        "*", "case when total > 0 then cast(value as double) / cast(total as double) "
             "else 0.0D end value_share")
