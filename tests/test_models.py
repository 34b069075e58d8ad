"""Fitted models as SQL text, saved and loaded models, and streams and responses that decide by a model."""

import json

import pytest

from dunwright.operators import compiled, decide, evaluation as E, learning as ML
from dunwright.operators.ordering import materialize
from dunwright.sources.store import ParquetStore
from dunwright.streaming import decisions
from tests.conftest import explain
from tests.test_jobs import labelled
from tests.test_validation import VALID


@pytest.fixture(scope="module")
def fitted(spark, scored):
    data = materialize(labelled(scored))
    return data, {"lr": ML.train_logistic(data), "gbt": ML.train_boosted(data, trees=8),
                  "cal": ML.train_calibrated(data)}


def differences(model, rows):
    sql = compiled.model_sql(model)
    scored = model.transform(rows, "_m") if isinstance(model, ML.CalibratedModel) else ML.predict(model, rows, "_m")
    return [abs(r.d) for r in scored.selectExpr(f"{sql} - _m d").collect()]


@pytest.mark.parametrize("name", ["lr", "gbt", "cal"])
def test_text_equals_the_pipeline(fitted, name):
    data, models = fitted
    assert max(differences(models[name], data)) < 1e-12
    # categories the fit never saw, and rows with odd numbers
    odd = data.limit(50).selectExpr("* except (failure_reason, days_overdue)", "'unheard_of' failure_reason",
                                    "days_overdue * 100 days_overdue")
    assert max(differences(models[name], odd)) < 1e-12
    plan = explain(decide.score_with_probability(data, compiled.model_sql(models[name])))
    assert "Python" not in plan and "UDF" not in plan


def test_trees_learn_and_split_on_categories(fitted):
    data, models = fitted
    metrics = E.all_metrics(ML.predict(models["gbt"], data), score="model_score").first()
    assert metrics.roc_auc > 0.75
    shown = ("DecisionTreeRegressionModel: depth=2\n  If (feature 0 in {1.0})\n   Predict: 1.5\n  Else (feature 0 not in {1.0})\n"
             "   If (feature 2 <= -3.25)\n    Predict: -1.0E-4\n   Else (feature 2 > -3.25)\n    Predict: 7.0\n")
    table = compiled._tree_table(shown)

    def walk(x):
        n = 0
        while table["f"][n] >= 0:
            n = table["l"][n] if x[table["f"][n]] <= table["t"][n] else table["r"][n]
        return table["v"][n]

    assert [walk(x) for x in ([1, 0, 9], [0, 0, -4], [0, 0, 0])] == [1.5, -1e-4, 7.0]
    with pytest.raises(ValueError):
        compiled._tree_table("t\n If (feature 0 in {2.0})\n  Predict: 1\n Else (feature 0 not in {2.0})\n  Predict: 2")


def test_calibrated_model_saves_and_loads(fitted, tmp_path):
    data, models = fitted
    models["cal"].save(str(tmp_path / "m"))
    again = ML.CalibratedModel.load(str(tmp_path / "m"))
    assert max(differences(again, data)) < 1e-12
    assert compiled.model_sql(again) == compiled.model_sql(models["cal"])


def test_coefficients_undo_the_scaling(fitted):
    data, models = fitted
    coefficients = compiled.linear_coefficients(models["lr"])
    own = ML.predict(models["lr"], data, "_m").selectExpr("*", "ln(_m / (1 - _m)) z")
    terms = " + ".join(
        f"{c!r}D * " + (f"double({n.split('=')[0]} = '{n.split('=')[1]}')" if "=" in n else f"double({n})")
        for n, c in coefficients.items())
    spread = [r.d for r in own.selectExpr(f"z - ({terms}) d").collect()]
    assert max(spread) - min(spread) < 1e-8  # the rest is one constant
    assert compiled.linear_coefficients(models["lr"]).keys() == {
        r.feature for r in E.linear_attribution(data, coefficients).collect()}


def test_responses_and_streams_decide_by_a_model(spark, fitted, tmp_path):
    _, models = fitted
    text = compiled.model_sql(models["lr"])
    # the model fails on one event: its key stays free for the next one
    text = f"case when payment_id = 'p1' then double('NaN') when payment_id = 'p6' then 2D else {text} end"
    rows = [json.dumps({**VALID, "payment_id": p, "idempotency_key": k}) for p, k in (
        ("p1", "k"), ("p2", "k"), ("p3", "k"), ("p4", "other"), ("p6", "six"))]
    parsed = decide.parse_events(spark.createDataFrame([(r,) for r in rows], "value string"))
    got = {r.event_identity.payment_id: r for r in decide.respond(
        parsed, probability=text, order=("payment_id",)).collect()}
    assert {p: r.processing_metadata.status for p, r in got.items()} == {
        "p1": "error", "p2": "success", "p3": "duplicate", "p4": "success", "p6": "error"}
    assert got["p1"].validation.errors == ["prediction probability must be finite"]
    assert got["p6"].validation.errors == ["prediction probability must be between 0 and 1"]
    assert got["p3"].prediction == got["p2"].prediction and got["p3"].decision == got["p2"].decision
    assert got["p3"].persistence.event_id == got["p2"].persistence.event_id
    assert got["p3"].audit_record is None and got["p2"].audit_record.payment_id == "p2"
    assert got["p2"].audit_record.audit_id and got["p2"].business_priority.priority_tier
    assert got["p1"].persistence.event_id is None

    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text("\n".join(rows))
    store = ParquetStore(spark, str(tmp_path / "store"))
    jobs = decisions.DecisionStream(store, received_at="timestamp '2024-02-01 00:00:00'", probability=text)
    jobs.run(decisions.read_event_stream(spark, str(tmp_path / "feed")), str(tmp_path / "c")).awaitTermination()
    events = store.read("payment_events").join(store.read("recovery_decisions"), "event_id").collect()
    assert {(r.payment_id, float(r.model_probability)) for r in events} == {
        (p, round(got[p].prediction.recovery_probability, 5)) for p in ("p2", "p4")}
    assert {tuple(r.errors) for r in decisions.quarantined(store).collect()} == {
        ("prediction probability must be finite",), ("prediction probability must be between 0 and 1",)}


def test_audit_keeps_a_supplied_expected_value(spark):
    from dunwright.operators import audit as A

    row = spark.sql("select cast(5000 as decimal(14,2)) payment_amount, cast(0.8 as decimal(7,6)) recovery_probability,"
                    " cast(12.5 as decimal(20,8)) expected_recovery")
    assert A.audit_records(row, "s", "t").first().expected_recovery == 12.5


def test_cross_validation_sorts_once_and_scores_as_fits_on_their_own(spark, scored, monkeypatch):
    data = materialize(labelled(scored))
    split = materialize(E.stratified_folds(data, folds=2))
    want = {}
    for k in range(2):
        train, test = split.filter(f"fold <> {k}").drop("fold"), split.filter(f"fold = {k}")
        for name, rows in ((ML.PLAIN, ML.predict(ML.train_logistic(train, True), test)),
                           (ML.CALIBRATED, ML.train_calibrated(train).transform(test))):
            want |= {(r.payment_id, name): (r.recovered, k, r.model_score) for r in rows.collect()}
    sorts = []
    ranked = E.with_global_rank
    monkeypatch.setattr(E, "with_global_rank", lambda *a, **kw: sorts.append(1) or ranked(*a, **kw))
    got = {(r.payment_id, r.model): (r.recovered, r.fold, r.model_score)
           for r in ML.cross_validated_scores(data, folds=2).collect()}
    assert len(sorts) == 1  # of the folds; training sets are not ordered again
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert max(abs(got[k][2] - want[k][2]) for k in want) < 1e-6


def test_nested_folds_equal_folds_of_each_training_set(spark, scored):
    split = materialize(E.stratified_folds(scored.select("payment_id", "recovered"), folds=3))
    nested = materialize(E.nested_folds(split, 3, 4))
    assert nested.count() == split.count() > 0
    for k in range(3):
        want = E.stratified_folds(split.filter(f"fold <> {k}").drop("fold"), folds=4, seed=7)
        got = nested.filter(f"inner_{k} is not null")
        assert nested.filter(f"fold = {k} and inner_{k} is not null").isEmpty()
        assert {(r.payment_id, r.fold) for r in want.collect()} == {
            (r.payment_id, r[f"inner_{k}"]) for r in got.collect()}
