"""Decision-store operators: table rows, idempotent inserts, lookups, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT_STRATEGY
from ..functions.scalars import audit_id, stable_id, text, utc_text
from ..schemas import (
    AUDIT_RECORDS, MODEL_VERSIONS, PAYMENT_EVENTS, RECOVERY_DECISIONS, RECOVERY_OUTCOMES,
    STORE_TABLES,
)
from .lookup import rows_of
from .ordering import materialize

OUTCOME_NOTE = "Synthetic simulation assumption, not a real transaction."


def conform(df: DataFrame, schema: StructType, **computed: str) -> DataFrame:
    """A stored table's columns, cast; ``computed`` gives SQL text for some of them."""
    return df.selectExpr(*[
        f"cast({computed.get(f.name, f.name)} as {f.dataType.simpleString()}) {f.name}"
        for f in schema.fields])


def event_rows(events: DataFrame, received_at: str) -> DataFrame:
    """payment_events rows; the id follows from the key, so re-runs write the same row.

    ``received_at`` and the other moments below are SQL text.
    """
    return conform(events, PAYMENT_EVENTS, event_id=stable_id("event", "idempotency_key"),
                   event_received_at=received_at, processing_status="'RECEIVED'")


def with_decision_id(traced: DataFrame, strategy: str = DEFAULT_STRATEGY) -> DataFrame:
    """Attach the id the decision will be stored under."""
    event_id = stable_id("event", "idempotency_key")
    return traced.withColumn("decision_id", F.expr(stable_id("decision", event_id, text(strategy))))


def decision_rows(traced: DataFrame, decided_at: str, model_version_id: str = "null",
                  strategy: str = DEFAULT_STRATEGY) -> DataFrame:
    """recovery_decisions rows of traced payments that carry ``idempotency_key``."""
    event_id = stable_id("event", "idempotency_key")
    return conform(
        traced, RECOVERY_DECISIONS, event_id=event_id,
        decision_id=stable_id("decision", event_id, text(strategy)),
        model_version_id=model_version_id, decided_at=decided_at, processing_time_ms="null",
        model_probability="round(recovery_probability, 5)", recovery_priority="priority",
        expected_recovery="round(expected_recovery, 2)", decision_threshold="selected_threshold",
        expected_retry_net_value="round(expected_retry_net_value, 2)",
        strategy_name=text(strategy))


def audit_rows(decisions: DataFrame) -> DataFrame:
    """audit_records rows of decisions that carry ``payment_id``."""
    aid = audit_id("payment_id", "strategy_name", utc_text("decided_at"))
    return conform(decisions, AUDIT_RECORDS, audit_id=aid, audit_generated_at="decided_at",
                   audit_record_id=stable_id("audit", "decision_id", aid))


def outcome_rows(executed: DataFrame, recorded_at: str, source: str = "SIMULATED") -> DataFrame:
    """recovery_outcomes rows; both the recommended and the policy's action are kept."""
    return conform(
        executed.filter("simulated_recovered is not null"), RECOVERY_OUTCOMES,
        outcome_id=stable_id("outcome", "decision_id", text(source)),
        outcome_recorded_at=recorded_at, outcome_source=text(source),
        action_executed="recommended_action",
        recovery_occurred="cast(simulated_recovered as boolean)",
        outcome_notes=text(OUTCOME_NOTE) if source == "SIMULATED" else "null")


def model_rows(models: DataFrame, registered_at: str) -> DataFrame:
    """model_versions rows of ``(model_name, model_version[, calibration_version, description])``."""
    optional = {c: "null" for c in ("calibration_version", "description") if c not in models.columns}
    return conform(models, MODEL_VERSIONS, registered_at=registered_at,
                   model_version_id=stable_id("model", "model_name", "model_version"), **optional)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows written once with a number of their own, so that exact copies can be told apart."""
    return materialize(rows.withColumn("_row", F.expr("monotonically_increasing_id()")))


def _winners(numbered: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Per key the number of its earliest row (the first copy among equals), as ``_won``.

    Found by a combining aggregate and joined back on the unique number, so copies of one
    key spread over all tasks.
    """
    return numbered.groupBy(*key).agg(F.expr(f"min(struct({', '.join([*order, '_row'])}))._row _won"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key, one of them if it has exact copies."""
    numbered = _numbered(rows)
    return numbered.join(_winners(numbered, key, order).select("_won"), F.expr("_row = _won"),
                         "left_semi").drop("_row")


def insert_if_absent(incoming: DataFrame, existing: DataFrame, key: list[str],
                     order: list[str]) -> DataFrame:
    """Rows to append: first of each key in the batch, whose key is not stored yet."""
    return insert_outcome(incoming, existing, key, order).filter("not is_duplicate").drop("is_duplicate")


def insert_outcome(incoming: DataFrame, existing: DataFrame, key: list[str], order: list[str]
                   ) -> DataFrame:
    """All incoming rows with ``is_duplicate``: copies, later rows of a key and stored keys."""
    numbered = _numbered(incoming)
    new = _winners(numbered, key, order).join(existing.select(*key), key, "left_anti").select("_won")
    return numbered.join(new, F.expr("_row = _won"), "left").selectExpr(
        "* except (_row, _won)", "_won is null is_duplicate")


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The most recent decision of each event (ties by decision id)."""
    return decisions.groupBy("event_id").agg(F.expr(
        f"max_by(struct({', '.join(decisions.columns)}), struct(decided_at, decision_id)) _d")
    ).select("_d.*")


def stored_decisions(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest stored decision by idempotency key, for duplicate answers."""
    return events.select("idempotency_key", "event_id").join(latest_decision(decisions), "event_id")


def current_status(log: DataFrame) -> DataFrame:
    """Latest status per event of an append-only status log (later step wins a tie)."""
    return log.groupBy("event_id").agg(F.expr(
        "max_by(processing_status, struct(changed_at, step)) processing_status"))


def lineage(events: DataFrame, decisions: DataFrame, audits: DataFrame, outcomes: DataFrame,
            models: DataFrame) -> DataFrame:
    """Event → decision → audit → model, with outcomes where there are any.

    Spark broadcasts the model registry while it is small and otherwise splits the
    skewed side of the join at run time; ids of the other joins are unique per row.
    """
    return (
        decisions.select("decision_id", "event_id", "model_version_id", "decided_at",
                         "recommended_action", "recovery_priority", "expected_recovery")
        .join(events.select("event_id", "payment_id", "idempotency_key", "payment_amount"), "event_id")
        .join(audits.select("decision_id", "audit_id"), "decision_id")
        .join(outcomes.select("decision_id", "outcome_source", "selected_action",
                              "recovery_occurred", "recovered_amount", "net_recovered_revenue"),
              "decision_id", "left")
        .join(models.select("model_version_id", "model_name", "model_version"),
              "model_version_id", "left"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of the stored tables; an absent table counts zero."""
    spark = next(iter(tables.values())).sparkSession
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.expr("count(1) row_count")).selectExpr(f"{text(name)} table_name", "row_count")
        for name, df in tables.items()])
    spine = rows_of(spark, "table_name", [(n,) for n in STORE_TABLES])
    return spine.join(counts, "table_name", "left").selectExpr(
        "table_name", "coalesce(row_count, 0) row_count")
