"""Tunable settings of the operators, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

# Actions, priorities, domains and economics the results depend on.
RETRY = "Retry Payment"
REMINDER = "Payment Method Reminder"
MANUAL_OR_STOP = "Manual Review / Stop Automatic Retry"
MANUAL_REVIEW = "Manual Review"
STOP = "Stop Automatic Recovery"
DO_NOTHING = "Do Nothing"
DEFAULT_STRATEGY = "Rule-Based Real-Time Default"

FAILURE_REASONS = ("insufficient_funds", "invalid_card", "technical_error", "limit_exceeded")
PAYMENT_METHODS = ("credit_card", "debit_card", "upi", "bank_transfer")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
OUTCOME_SOURCES = ("SIMULATED", "REAL")
EVENT_STATUSES = (
    "RECEIVED", "VALIDATION_FAILED", "PREDICTED", "DECISIONED", "AUDIT_WRITTEN",
    "ACTION_PENDING", "ACTION_EXECUTED", "RECOVERED", "UNRECOVERED",
)

# Allowed edges of the recovery lifecycle (from state, to state).
STATE_EDGES = (
    ("FAILED", "ASSESSED"),
    ("ASSESSED", "ACTION_SELECTED"),
    ("ASSESSED", "STOPPED"),
    ("ASSESSED", "MANUAL_REVIEW"),
    ("ACTION_SELECTED", "ACTION_EXECUTED"),
    ("ACTION_EXECUTED", "RECOVERED"),
    ("ACTION_EXECUTED", "FAILED_RECOVERY"),
    ("RECOVERED", "VERIFIED"),
    ("FAILED_RECOVERY", "VERIFIED"),
    ("VERIFIED", "CLOSED"),
    ("VERIFIED", "STOPPED"),
)

NUMERIC_FEATURES = (
    "payment_amount", "customer_tenure_months", "past_successful_payments",
    "past_failed_payments", "historical_success_rate", "time_since_last_success_days",
    "days_overdue", "recovery_attempts_so_far",
)
CATEGORICAL_FEATURES = ("failure_reason", "payment_method", "is_subscription")
REQUIRED_FEATURES = (
    "payment_amount", "failure_reason", "payment_method", "is_subscription",
    "customer_tenure_months", "past_successful_payments", "past_failed_payments",
    "historical_success_rate", "time_since_last_success_days", "days_overdue",
    "recovery_attempts_so_far",
)


@dataclass(frozen=True)
class Bands:
    """Probability bands that pick a priority and an action."""

    high: float = 0.65
    medium: float = 0.35


@dataclass(frozen=True)
class PolicyConfig:
    """Limits of the bounded recovery policy."""

    min_retry_probability: float = 0.05
    max_recovery_attempts: int = 2
    high_value_threshold: float = 25000.0
    effective_retry_cost: float = 50.0


@dataclass(frozen=True)
class PriorityConfig:
    """Value tiers of the work queue and the subscription multiplier."""

    critical: float = 10000.0
    high: float = 2500.0
    medium: float = 500.0
    subscription_multiplier: float = 1.5


@dataclass(frozen=True)
class CostModel:
    """Action costs and effectiveness used by the strategy economics."""

    retry_cost: float = 5.0
    friction_cost: float = 45.0
    reminder_cost: float = 1.0
    manual_review_cost: float = 100.0
    retry_multiplier: float = 1.0
    reminder_multiplier: float = 0.5
    manual_review_multiplier: float = 0.75

    @property
    def retry_total(self) -> float:
        return self.retry_cost + self.friction_cost

    def with_retry_cost(self, cost: float) -> "CostModel":
        """The whole effective cost counts as retry cost, friction is zero."""
        return CostModel(
            cost, 0.0, self.reminder_cost, self.manual_review_cost,
            self.retry_multiplier, self.reminder_multiplier, self.manual_review_multiplier,
        )

    def simulator_actions(self) -> dict[str, tuple[float, float]]:
        """Action -> (cost, multiplier) of the strategy simulator."""
        return {
            RETRY: (self.retry_total, self.retry_multiplier),
            REMINDER: (self.reminder_cost, self.reminder_multiplier),
            MANUAL_OR_STOP: (self.manual_review_cost, self.manual_review_multiplier),
            DO_NOTHING: (0.0, 0.0),
        }


# Action -> (cost, multiplier) of the four-strategy benchmark; others cost and recover nothing.
BENCHMARK_ACTIONS = {
    RETRY: (50.0, 1.0),
    REMINDER: (1.0, 0.5),
    MANUAL_REVIEW: (100.0, 0.75),
    STOP: (0.0, 0.0),
}


@dataclass(frozen=True)
class TraceConfig:
    """Economics quoted in decision traces and audit rows."""

    effective_retry_cost: float = 50.0
    decision_threshold: float = 0.05
