"""Windowed monitoring of a scored stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import validation as V
from ..operators.monitoring import DriftProfile, window_bins, window_drift


def window_metrics(scored: DataFrame, event_time: str = "failed_at", width: str = "1 day",
                   delay: str | None = "1 day") -> DataFrame:
    """Per event-time window: events, invalid rate, mean probability, expected value.

    Works on streams and tables alike; ``delay`` sets the watermark of a stream.
    """
    checked = V.with_errors(scored, V.typed_fields(scored))
    rows = checked.withWatermark(event_time, delay) if delay and scored.isStreaming else checked
    return rows.groupBy(F.window(event_time, width).alias("w")).agg(*[F.expr(e) for e in (
        "count(1) events", "count_if(not is_valid) invalid_events",
        "sum(recovery_probability) _p", "sum(expected_recovery) expected_recovery")]).selectExpr(
        "w.start window_start", "events", "invalid_events",
        "invalid_events / events invalid_rate",
        "cast(_p as double) / events mean_probability", "expected_recovery")


def run_window_monitor(stream: DataFrame, folder: str, checkpoint: str, **window) -> StreamingQuery:
    """Keep the windows' running metrics: every batch appends the windows it changed."""
    def append(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return (window_metrics(stream, **window).writeStream.outputMode("update")
            .foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_windows(log: DataFrame) -> DataFrame:
    """Latest metrics of each window from the appended log."""
    columns = [c for c in log.columns if c != "batch_id"]
    return log.groupBy("window_start").agg(F.expr(
        f"max_by(struct({', '.join(columns)}), batch_id) _w")).select("_w.*")


def run_drift_monitor(stream: DataFrame, profile: DriftProfile, folder: str, checkpoint: str, **window
                      ) -> StreamingQuery:
    """Keep the windows' bin counts against a reference's edges: every batch appends the counts it changed.

    The state holds one number per (window, feature, bin) until the watermark passes the window.
    """
    def append(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return (window_bins(stream, profile, **window).writeStream.outputMode("update")
            .foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def current_drift(log: DataFrame, profile: DriftProfile) -> DataFrame:
    """Drift per window from the latest counts of the appended log."""
    latest = log.groupBy("window_start", "feature", "type", "bin").agg(F.expr("max_by(cur, batch_id) cur"))
    return window_drift(latest, profile)
