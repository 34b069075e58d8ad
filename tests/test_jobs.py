"""Sources, sinks, models, streams and the shape of plans."""

import json

import pytest

from dunwright.operators import audit as A, decide, learning as ML
from dunwright.operators.evaluation import all_metrics
from dunwright.plans import queries
from dunwright.plans.registry import Tables
from dunwright.sources import readers, writers
from dunwright.sources.store import ParquetStore
from dunwright.streaming import decisions
from tests.conftest import SMALL, explain
from tests.test_validation import VALID


def test_csv_round_trip(spark, scored, tmp_path):
    columns = [f.name for f in readers.FAILED_PAYMENTS.fields]
    payments = scored.select(*columns)
    writers.write_csv(payments, str(tmp_path / "csv"))
    back = readers.read_payments_csv(spark, str(tmp_path / "csv"))
    assert back.schema == readers.FAILED_PAYMENTS
    assert back.exceptAll(payments).isEmpty() and payments.exceptAll(back).isEmpty()


def test_audit_is_partitioned_by_strategy(spark, scored, tmp_path):
    path = str(tmp_path / "audit")
    writers.write_audit(A.audit_records(scored, "s1", "t").unionByName(
        A.audit_records(scored, "s2", "t")), path)
    read = A.filter_audit(spark.read.parquet(path), strategy="s1")
    assert read.count() == scored.count()
    assert "PartitionFilters: [isnotnull(strategy_name" in explain(read)


def test_empty_store_counts_zero(spark, tmp_path):
    counts = ParquetStore(spark, str(tmp_path / "nothing")).counts().collect()
    assert len(counts) == 5 and all(r.row_count == 0 for r in counts)


def test_stream_is_idempotent(spark, tmp_path):
    """Same key twice in a file, again in a later file, and the last batch run once more."""
    feed = tmp_path / "feed"
    feed.mkdir()
    event = lambda key, pid: json.dumps({**VALID, "payment_id": pid, "idempotency_key": key})
    (feed / "1.json").write_text("\n".join([event("k1", "p1"), event("k1", "p9"), event("k1", "p1"), event("k2", "p2")]))
    store = ParquetStore(spark, str(tmp_path / "store"))
    jobs = decisions.DecisionStream(store, received_at="timestamp '2024-02-01 00:00:00'")

    def run():
        jobs.run(decisions.read_event_stream(spark, str(feed)), str(tmp_path / "ckpt")).awaitTermination()

    run()
    (feed / "2.json").write_text("\n".join([event("k2", "p2"), event("k3", "p1"), '{"payment_id": "bad"}']))
    run()
    counts = lambda: {r.table_name: r.row_count for r in store.counts().collect()}
    want = {"payment_events": 3, "recovery_decisions": 3, "audit_records": 3,
            "recovery_outcomes": 3, "model_versions": 1}
    assert counts() == want
    jobs.process_batch(spark.read.text(str(feed / "2.json")), 1, decisions.stream_id(spark, str(tmp_path / "ckpt")))
    assert counts() == want
    # a new checkpoint starts again at batch 0 and meets what is stored
    (feed / "3.json").write_text(event("k4", "p4"))
    jobs.run(decisions.read_event_stream(spark, str(feed)), str(tmp_path / "other")).awaitTermination()
    want = {t: n if t == "model_versions" else 4 for t, n in want.items()}
    assert counts() == want
    # a batch that failed before its commit is not read, and is replaced by its next run
    store.write_batch("payment_events", store.read("payment_events").limit(2), "broken", 7)
    assert counts() == want
    keys = {r.idempotency_key for r in store.read("payment_events").collect()}
    assert keys == {"k1", "k2", "k3", "k4"}
    assert {r.payment_id for r in store.read("payment_events").filter("idempotency_key = 'k1'").collect()} == {"p1"}
    again = spark.sql("select 'k2' idempotency_key")
    assert decisions.duplicate_answers(again, store).count() == 1
    assert decisions.quarantined(store).select("raw_event_payload").distinct().count() == 1


def labelled(scored):
    """A label the features explain, so that a fitted model has something to find."""
    return scored.selectExpr(
        "* except (recovered)",
        "cast(conv(substring(sha2(payment_id, 256), 1, 6), 16, 10) / 16777216.0D"
        " < recovery_probability as int) recovered")


def test_logistic_model_learns_saves_and_scores(spark, tmp_path):
    data = labelled(Tables(spark, "/root/testdata/sf0.01").scored_table)
    model = ML.train_logistic(data)
    metrics = all_metrics(ML.predict(model, data), score="model_score").collect()[0]
    assert metrics.roc_auc > 0.75
    path = str(tmp_path / "model")
    ML.save_model(model, path)
    scored = ML.batch_score(path, data.drop("recovery_probability", "expected_recovery", "priority",
                                            "recommended_action"))
    assert scored.filter("recovery_probability not between 0 and 1").isEmpty()
    assert scored.count() == data.count()


def test_unseen_categories_score(spark, scored):
    model = ML.train_logistic(scored.filter("failure_reason <> 'limit_exceeded'"))
    rows = ML.predict(model, scored.filter("failure_reason = 'limit_exceeded'"))
    assert rows.filter("model_score is null or isnan(model_score)").isEmpty() and rows.count() > 0


def test_isotonic_is_monotone(spark, scored):
    data = labelled(scored).selectExpr("recovered", "cast(recovery_probability as double) model_score")
    fitted = ML.apply_isotonic(ML.fit_isotonic(data), data, "model_score", "calibrated")
    rows = sorted((r.model_score, r.calibrated) for r in fitted.collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(rows, rows[1:]))


def test_columns_reach_the_scan(spark):
    plan = explain(Tables(spark, SMALL).payments.select("payment_id", "customer_id"))
    assert "payment_amount" not in plan and "next_ok_ts" not in plan.split("ReadSchema: ")[1]


@pytest.mark.parametrize("name", [
    "bounded_policy", "prioritized_queue", "threshold_sweep", "strategy_benchmark", "outcome_metrics",
    "drift_report", "roc_auc", "lineage", "validate_json_events", "data_quality"])
def test_no_cross_joins_and_no_python_in_plans(spark, name):
    plan = explain(queries()[name](spark, SMALL))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                 "MapInPandas", "FlatMapGroups"):
        assert word not in plan


def test_responses_keep_the_raw_payload(spark):
    text = json.dumps(VALID)
    row = decide.parse_events(spark.createDataFrame([(text,)], "value string")).collect()[0]
    assert row.raw_event_payload == text and row.is_valid
