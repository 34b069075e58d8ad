"""Time the headline queries once each on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "payments_adapter", "score_payments", "bounded_policy", "decision_trace", "state_paths",
    "prioritized_queue", "queue_top100", "value_concentration", "portfolio_totals",
    "threshold_sweep", "cost_sensitivity", "strategy_comparison", "outcome_metrics",
    "strategy_benchmark", "benchmark_deltas", "validate_records", "data_quality", "drift_report",
    "prediction_summary", "correlation_matrix", "recovery_rates", "audit_records", "audit_summary",
    "idempotent_insert", "latest_decision", "lineage", "transition_conformance", "roc_auc",
    "calibration_curve", "stratified_folds", "linear_attribution", "event_responses",
    "customer_history_features", "stream_decisions", "stream_dedup", "train_lr",
    "event_answers", "isotonic_blocks", "stored_orphans", "stream_drift", "stream_state_dedup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    from dunwright.plans import queries
    from dunwright.session import local_session

    spark = local_session(cores, app="bench")
    registered = queries()
    wanted = sys.argv[1:] or HEADLINES
    registered["score_payments"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in wanted:
        start = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
