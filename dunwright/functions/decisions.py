"""Scorecard, bands, expected value, policy, state paths and traces."""

from __future__ import annotations

from ..config import (
    MANUAL_OR_STOP, MANUAL_REVIEW, REMINDER, RETRY, STATE_EDGES, STOP,
    Bands, PolicyConfig, TraceConfig,
)
from .scalars import clip, dec, double, fixed, is_finite, rupees, rupees_plain, text, texts

# Published scorecard weights.
SCORE_INTERCEPT = -0.5
REASON_WEIGHTS = {
    "technical_error": 2.0,
    "insufficient_funds": 0.0,
    "limit_exceeded": -0.5,
    "invalid_card": -2.0,
}


def scorecard_logit() -> str:
    """Linear predictor of the published logistic scorecard."""
    reason = " ".join(f"when failure_reason = {text(name)} then {double(weight)}"
                      for name, weight in REASON_WEIGHTS.items())
    return (
        f"({double(SCORE_INTERCEPT)}"
        " + 3.0D * (historical_success_rate - 0.5D)"
        " + 1.5D * (customer_tenure_months / 60.0D)"
        " - time_since_last_success_days / 365.0D"
        " - 0.3D * past_failed_payments"
        " - 2.0D * (days_overdue / 30.0D)"
        " - 0.5D * recovery_attempts_so_far"
        " + 0.8D * is_subscription"
        f" + case {reason} else 0.0D end)")


def scorecard_probability() -> str:
    """Recovery probability rounded to six digits (exact in sums and groupings)."""
    return f"cast(round(1.0D / (1.0D + exp(-{scorecard_logit()})), 6) as decimal(7,6))"


def band(p: str, high: str, medium: str, low: str, bands: Bands = Bands()) -> str:
    """Pick a text by probability band; a non-finite probability gives NULL."""
    return (f"case when not {is_finite(p)} then null "
            f"when {p} >= {double(bands.high)} then {text(high)} "
            f"when {p} >= {double(bands.medium)} then {text(medium)} else {text(low)} end")


def priority_band(p: str, bands: Bands = Bands()) -> str:
    return band(p, "HIGH", "MEDIUM", "LOW", bands)


def recommended_action(p: str, bands: Bands = Bands()) -> str:
    return band(p, RETRY, REMINDER, MANUAL_OR_STOP, bands)


def payment_value(amount: str = "payment_amount", p: str = "recovery_probability") -> str:
    """amount × probability as an exact decimal."""
    return f"cast(cast({amount} as decimal(14,2)) * cast({p} as decimal(7,6)) as decimal(20,8))"


def expected_recovery(amount: str, p: str) -> str:
    """amount × probability with the probability clipped to [0, 1]."""
    return payment_value(amount, f"({clip(p, 0.0, 1.0)})")


def policy(p: str, attempts: str, amount: str, expected: str, action: str,
           config: PolicyConfig = PolicyConfig()) -> str:
    """Bounded policy as a struct; the order of the checks is contractual."""
    def verdict(code: str, decision: str, chosen: str, reason: str) -> str:
        return (f"named_struct('policy_decision', {text(decision)}, 'selected_action', {chosen}, "
                f"'decision_reason', {reason}, 'reason_code', {text(code)})")

    def sentence(before: str, value: str, after: str) -> str:
        return f"concat({text(before)}, {value}, {text(after)})"

    stop = text(STOP)
    limit, cost = config.high_value_threshold, config.effective_retry_cost
    return f"""case
        when {attempts} >= {config.max_recovery_attempts} then {verdict(
            "MAX_ATTEMPTS", "BLOCKED", stop,
            text(f"Maximum automatic recovery attempts reached ({config.max_recovery_attempts})."))}
        when {amount} > {dec(limit)} then {verdict(
            "HIGH_VALUE", "MANUAL_REVIEW", text(MANUAL_REVIEW),
            sentence("Payment amount (", rupees_plain(amount),
                     f") exceeds high-value threshold (₹{limit:.2f})."))}
        when {p} < {double(config.min_retry_probability)} then {verdict(
            "LOW_PROBABILITY", "BLOCKED", stop,
            sentence("Recovery probability (", fixed(p, 3),
                     f") is below minimum threshold ({config.min_retry_probability})."))}
        when {expected} <= {dec(cost)} then {verdict(
            "LOW_VALUE", "BLOCKED", stop,
            sentence("Expected recovery (", rupees_plain(expected),
                     f") does not exceed effective retry cost (₹{cost:.2f})."))}
        else {verdict("ALLOWED", "ALLOWED", action,
                      text("Policy checks passed. Automatic recovery allowed."))}
        end"""


def attempt_number(attempts: str, policy_decision: str) -> str:
    return f"{attempts} + case when {policy_decision} = 'ALLOWED' then 1 else 0 end"


def state_path(policy_decision: str, recovered: str) -> str:
    """States a payment passes through under one bounded decision."""
    path = lambda *names: f"array({texts(names)})"
    return (
        f"case when {policy_decision} = 'BLOCKED' then {path('FAILED', 'ASSESSED', 'STOPPED')} "
        f"when {policy_decision} = 'MANUAL_REVIEW' then "
        f"{path('FAILED', 'ASSESSED', 'MANUAL_REVIEW')} "
        f"when {recovered} then "
        f"{path('FAILED', 'ASSESSED', 'ACTION_SELECTED', 'ACTION_EXECUTED', 'RECOVERED', 'VERIFIED', 'CLOSED')} "
        "else "
        f"{path('FAILED', 'ASSESSED', 'ACTION_SELECTED', 'ACTION_EXECUTED', 'FAILED_RECOVERY', 'VERIFIED', 'STOPPED')} "
        "end")


def invalid_steps(path: str) -> str:
    """Number of state changes of an array path that the transition table does not allow."""
    edges = texts([f"{a} {b}" for a, b in STATE_EDGES])
    last = f"greatest(size({path}) - 1, 0)"
    steps = f"zip_with(slice({path}, 1, {last}), slice({path}, 2, {last}), (a, b) -> concat(a, ' ', b))"
    return f"size(filter({steps}, s -> s not in ({edges})))"


def retry_net_value(expected: str, config: TraceConfig = TraceConfig()) -> str:
    return f"({expected} - {dec(config.effective_retry_cost)})"


def decision_reason(action: str, expected: str, config: TraceConfig = TraceConfig()) -> str:
    """Explanation text of a recommended action."""
    net = retry_net_value(expected, config)
    cost = f"₹{config.effective_retry_cost:,.2f}"
    lead = "The model estimates the probability of recovery based on payment characteristics."
    opening = (f"{lead} Under the simulation assumptions, the expected recovery (")
    worth = (f") exceeds the effective retry cost ({cost}), so an automated retry is economically "
             "justified.")
    not_worth = (f") is lower than the effective retry cost ({cost}), meaning an automated retry is "
                 "not mathematically optimal despite the priority band.")
    remind = (f"{lead} The Stage 5 rule-based engine places this payment in the reminder band. The "
              "simulator threshold is a separate strategy-analysis control. (Hypothetically, an "
              "automated direct retry would yield a net expected value of ")
    stopped = (f"{lead} The Stage 5 rule-based engine places this payment below the automatic-retry "
               "band, so automatic retry is stopped. The model estimates very low recovery "
               "probability.")
    return (
        f"case when {action} = {text(RETRY)} then concat({text(opening)}, {rupees(expected)}, "
        f"case when {net} > 0 then {text(worth)} else {text(not_worth)} end) "
        f"when {action} = {text(REMINDER)} then concat({text(remind)}, {rupees(net)}, "
        f"' under simulation assumptions).') else {text(stopped)} end")


def key_input_factors(columns: list[str]) -> str:
    """Seven formatted inputs; a column the table lacks, or a NULL, takes its default."""
    def value(name: str, default: str) -> str:
        return f"coalesce({name}, {default})" if name in columns else default

    def line(label: str, shown: str) -> str:
        return f"concat({text(label)}, {shown})"

    rate = f"cast({value('historical_success_rate', '0')} as double) * 100"
    overdue = value("days_overdue", "0")  # whole numbers without a fraction, whatever the type
    return ", ".join([
        "array(" + line("Payment amount: ", rupees("payment_amount")),
        line("Historical success rate: ", f"cast(cast(bround({rate}, 0) as bigint) as string), '%'"),
        line("Past successful payments: ", value("past_successful_payments", "0")),
        line("Past failed payments: ", value("past_failed_payments", "0")),
        line("Failure reason: ", value("failure_reason", "'unknown'")),
        line("Recovery attempts so far: ", value("recovery_attempts_so_far", "0")),
        line("Days overdue: ", f"if({overdue} = floor({overdue}), cast(cast({overdue} as bigint) "
                               f"as string), cast({overdue} as string))") + ")",
    ])
