"""Event stream to decisions: parse, validate, quarantine, decide, audit, store.

Exactly-once per idempotency key comes from the store: every micro-batch inserts only keys
that no other committed batch of any stream stored (asked of the store's key index), and a
batch that runs again replaces its own output.  With ``recent`` the stream also keeps the keys
of the running time window as state, so that repeats soon after the first event never reach
the store.  A stream is known by an id
that is kept beside its checkpoint, so a new checkpoint never meets another's batches.
Streams that share a store must not run at the same time: keys are compared with
committed batches only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, TimestampType

from ..config import PolicyConfig, TraceConfig
from ..functions import decisions as D, validation as V
from ..functions.scalars import stable_id, text
from ..operators import decide, store as S
from ..sources.store import ParquetStore

EVENT_TEXT = "value string"
FEED_PLACE = ("file_modification_time", "file_path", "file_block_start")
QUARANTINE = StructType([
    StructField("raw_event_payload", StringType()), StructField("idempotency_key", StringType()),
    StructField("errors", ArrayType(StringType())), StructField("received_at", TimestampType())])


@dataclass(frozen=True)
class DecisionStream:
    """Settings of a decision stream over one store."""

    store: ParquetStore
    model_name: str = "recovery_scorecard"
    model_version: str = "unversioned"
    strategy: str = S.DEFAULT_STRATEGY
    trace: TraceConfig = TraceConfig()
    policy: PolicyConfig = PolicyConfig()
    received_at: str = "current_timestamp()"  # SQL text; a literal makes runs repeatable
    probability: str | None = None  # a fitted model as SQL text (see compiled.model_sql), or the scorecard
    recent: str | None = None  # length of the windows of arrival in which repeats are dropped by state

    def run(self, events: DataFrame, checkpoint: str, available_now: bool = True,
            mode: str = "append") -> StreamingQuery:
        """Start the stream of JSON text rows (column ``value``); ``mode`` fits what was done to it before."""
        stream = stream_id(self.store.spark, checkpoint)
        if self.recent is not None:
            events, mode = first_arrivals(events, self.recent), "update"
        writer = (events.writeStream.outputMode(mode)
                  .foreachBatch(lambda raw, batch_id: self.process_batch(raw, batch_id, stream))
                  .option("checkpointLocation", checkpoint))
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def process_batch(self, raw: DataFrame, batch_id: int, stream: str = "default") -> None:
        """Decide one micro-batch and write it as the stream's batch of every table.

        Rows without any key get a UUID, and times default to now; both are fixed by
        writing the parsed batch before anything else reads it.  Of the events with one key
        the first in the feed wins: by time and name of its file, place in it, and row.
        """
        store = self.store
        place = [*(c for c in FEED_PLACE if c in raw.columns), "monotonically_increasing_id()"]
        placed = raw.selectExpr("value", f"struct({', '.join(place)}) _place")
        parsed = decide.resolve_idempotency(decide.parse_events(placed)).selectExpr(
            "*", f"{self.received_at} _received",
        ).selectExpr("* except (payment_id)", "coalesce(payment_id, uuid()) payment_id")
        incoming = _frozen(parsed, store.batch_path("incoming", stream, batch_id))
        if incoming.isEmpty():  # a batch that only moves the watermark; nothing of it is ever read
            return
        own = (stream, batch_id)
        model = self.probability or D.scorecard_probability()
        checked = incoming.selectExpr("*", f"case when is_valid then {model} end _output").selectExpr(
            "*", f"case when is_valid then {V.probability_error('_output')} end _complaint")
        checked.filter("not is_valid or _complaint is not null").selectExpr(
            "raw_event_payload", "idempotency_key", "if(is_valid, array(_complaint), errors) errors",
            "_received received_at",
        ).write.mode("overwrite").parquet(store.batch_path("quarantine", stream, batch_id))
        valid = checked.filter("is_valid and _complaint is null").drop("_complaint")
        model_key = text(f"model|{self.model_name}|{self.model_version}")
        known = store.known_keys(valid.selectExpr("concat('event|', idempotency_key) key").union(
            store.spark.sql(f"select {model_key} key")), own)
        new = S.insert_if_absent(
            valid, known.filter("key like 'event|%'").selectExpr("substring(key, 7) idempotency_key"),
            ["idempotency_key"], ["_place"])
        scored = decide.run_bounded_recovery(
            decide.score_payments(new) if self.probability is None
            else decide.score_with_probability(new, "_output"), self.policy)
        traced = decide.decision_trace(
            scored.withColumnRenamed("decision_reason", "policy_reason"), self.trace)
        model_id = stable_id("model", text(self.model_name), text(self.model_version))
        decided = _frozen(
            S.with_decision_id(traced, self.strategy),
            store.batch_path("decided", stream, batch_id))

        decisions = S.decision_rows(decided, "_received", model_id, self.strategy)
        store.write_batch("recovery_decisions", decisions, *own)
        store.write_batch("audit_records", S.audit_rows(decisions.join(
            decided.select("decision_id", "payment_id"), "decision_id")), *own)
        store.write_batch("recovery_outcomes", S.outcome_rows(decided, "_received"), *own)
        versions = store.spark.sql(f"select {text(self.model_name)} model_name, "
                                   f"{text(self.model_version)} model_version, {model_key} key")
        new_models = versions.join(known, "key", "left_anti")
        store.write_batch("model_versions", S.model_rows(new_models, self.received_at), *own)
        event_rows = S.event_rows(decided, "_received")
        store.write_batch("event_status_log", event_rows.selectExpr(
            "event_id", "inline(array(struct('RECEIVED' as processing_status, 0 as step),"
            " struct('DECISIONED' as processing_status, 1 as step),"
            " struct('AUDIT_WRITTEN' as processing_status, 2 as step)))",
            "event_received_at changed_at"), *own)
        store.write_batch("payment_events", event_rows, *own)
        store.commit(*own, decided.selectExpr("concat('event|', idempotency_key) key").union(
            new_models.select("key")))


def _frozen(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream with this checkpoint, made and kept beside it on first use."""
    path = f"{checkpoint.rstrip('/')}-stream-id"
    try:
        return spark.read.schema("id string").parquet(path).first().id
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.sql("select replace(uuid(), '-', '') id").write.parquet(path)
    return spark.read.schema("id string").parquet(path).first().id


def quarantined(store: ParquetStore) -> DataFrame:
    """Invalid events of committed batches."""
    return store.read("quarantine", schema=QUARANTINE)


def deduplicate(events: DataFrame, key: str = "idempotency_key", event_time: str = "event_time",
                delay: str = "1 day") -> DataFrame:
    """Streaming dedup with state bounded by a watermark (copies within ``delay``)."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def first_arrivals(events: DataFrame, window: str, order: tuple[str, ...] | None = None) -> DataFrame:
    """Of the valid events with one key in a window of arrival, the first one, in the batch it came in.

    The rows keep ``events``' columns.  Time is the batch's own, so no event is ever late; a
    window's keys leave the state once it is over, and a later repeat goes to the store like a new event.
    Invalid events and events without a key all pass.  Events of one batch are ordered by ``order``
    (by default place in the feed, then text).
    """
    order = order or tuple(c for c in (*FEED_PLACE, "value") if c in events.columns)
    row = f"struct({', '.join(events.columns)}) _row"
    keyed = decide.parse_events(events.selectExpr("value", row, f"struct({', '.join(order)}) _order"))
    keyed = decide.resolve_idempotency(keyed).selectExpr(
        "_row", "_order", "if(is_valid, concat('key|', idempotency_key), uuid()) _key",
        "current_timestamp() _arrived")
    return (keyed.withWatermark("_arrived", "0 seconds")
            .groupBy("_key", F.window("_arrived", window)).agg(
                F.expr("min_by(_row, _order) _row"), F.expr("min(_arrived) first"), F.expr("max(_arrived) last"))
            .filter("first = last").select("_row.*"))  # in update mode, only keys that are new in this batch


def read_event_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON-lines files of a folder as a stream of text rows with their place in the feed."""
    return spark.readStream.schema(EVENT_TEXT).option(
        "maxFilesPerTrigger", files_per_batch).text(folder).selectExpr(
        "value", *[f"_metadata.{c} {c}" for c in FEED_PLACE])


def duplicate_answers(batch: DataFrame, store: ParquetStore) -> DataFrame:
    """Stored decisions for the keys of a batch (what a duplicate gets back)."""
    return S.stored_decisions(
        store.read("payment_events").join(
            batch.select("idempotency_key").distinct(), "idempotency_key", "left_semi"),
        store.read("recovery_decisions"))
