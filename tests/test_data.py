"""History, ordering, monitoring, store, audit and evaluation on small data with known answers."""

import bisect
import math
import statistics
from collections import Counter
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from dunwright.config import STATE_EDGES
from dunwright.operators import (
    audit as A, evaluation as E, history as H, monitoring as M, ordering as O, quality as Q, store as S,
)
from dunwright.operators.lookup import keep_matching
from tests.conftest import SMALL, explain


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_history_over_ranges_equals_whole(spark, ranges):
    """Bursts, equal times and one customer with most of the rows."""
    r = random.Random(ranges)
    rows = []
    for i in range(1200):
        user = 0 if r.random() < 0.5 else r.choice([None, *range(1, 9)])
        us = r.choice([5, 5, r.randint(0, 40)]) if user == 0 and r.random() < 0.6 else r.randint(0, 10 ** 9)
        rows.append((user, us, i, r.choice(["error", "purchase", "view"])))
    events = O.materialize(spark.createDataFrame(
        rows, "customer long, us long, event_id long, kind string").selectExpr(
        "customer", "timestamp_micros(us) ts", "event_id", "kind"))

    expected = {}
    for user in {x[0] for x in rows}:
        seen = sorted((us, i, kind) for u, us, i, kind in rows if u == user)
        ok, fail, run, run_first, last_ok = 0, 0, 0, None, None
        for k, (us, i, kind) in enumerate(seen):
            if kind == "error":
                run_first = us if run == 0 else run_first
                following = [x[0] for x in seen[k + 1:] if x[2] == "purchase"]
                expected[i] = (ok, fail, seen[0][0], last_ok, run_first, run,
                               following[0] if following else None)
                fail, run = fail + 1, run + 1
            elif kind == "purchase":
                ok, run, last_ok = ok + 1, 0, us
    micros = lambda c: F.expr(f"unix_micros({c})")
    got = {r[0]: tuple(r)[1:] for r in H.customer_timeline(events, ranges=ranges).select(
        "event_id", "succ_before", "fail_before", micros("first_ts"), micros("last_ok_ts"),
        micros("run_first_ts"), "run_fails", micros("next_ok_ts")).collect()}
    assert got == expected


def test_history_of_one_instant_and_of_nothing(spark):
    """Every event of one customer at one moment is still cut into ranges."""
    burst = spark.range(2000).selectExpr("1L customer", "timestamp_micros(77) ts", "id event_id",
                                         "if(id % 50 = 49, 'purchase', 'error') kind")
    ranges = O.even_ranges(burst.selectExpr("customer", "unix_micros(ts) at", "event_id"), 20)
    sizes = [x["count"] for x in burst.groupBy(F.expr(ranges.number("customer", "unix_micros(ts)", "event_id")))
             .count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 400
    got = {x.event_id: x for x in H.customer_timeline(burst, ranges=20).collect()}
    assert len(got) == 1960
    for i, x in got.items():
        assert (x.succ_before, x.fail_before, x.run_fails) == (i // 50, i - i // 50, i % 50)
        assert (x.last_ok_ts is None) == (i < 50) and x.next_ok_ts is not None
    assert H.customer_timeline(burst.limit(0)).count() == 0


def test_history_reads_the_events_once(spark, monkeypatch):
    """The written table is one scan and one exchange of the log; queries read it and nothing else."""
    plans, write = [], H.materialize
    monkeypatch.setattr(H, "materialize", lambda df: plans.append(explain(df)) or write(df))
    final = explain(contract.queries()["score_payments"](spark, SMALL))
    assert len(plans) == 1 and plans[0].count("events.parquet") == 1
    assert plans[0].count("ENSURE_REQUIREMENTS") == 1 and "REPARTITION" not in plans[0]
    assert "events.parquet" not in final and "CartesianProduct" not in final


def test_ranges_find_places_and_split_values(spark):
    keys = spark.sql("select * from values (null, 1), ('a', 2), ('a', 3), ('b', 4), ('é', 5), ('é', 6) t(k, n)")
    ranges = O.Ranges(['{"k":"a","n":3}', '{"k":"é","n":6}'], f"array<{keys.schema.simpleString()}>")
    got = keys.selectExpr("k", "n", f"{ranges.number('k', 'n')} r", f"{ranges.splits('k')} s").collect()
    assert {(r.n, r.r) for r in got} == {(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)}
    assert {r.k for r in got if r.s} == {"a", "é"}


def test_global_rank(spark):
    values = [random.Random(5).randint(0, 50) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    ranks = {r.id: r.rank for r in O.with_global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    want = sorted(range(2000), key=lambda i: (-values[i], i))
    assert ranks == {i: k + 1 for k, i in enumerate(want)}


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_running_totals_over_ranges(spark, ranges):
    """Groups inside a range, over several, null ones, and one that fills many ranges."""
    r = random.Random(ranges)
    rows = [(r.choice([None, "a", "b", "b", "b", "b", "c"]), i, r.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x int, n int").repartition(5)
    got = O.with_running_totals(df, ["-x"], {"upto": "n"}, {"total": "n"}, ["g"], ranges).collect()
    assert len(got) == 600
    for row in got:
        own = [(x, n) for g, x, n in rows if g == row.g]
        assert row.total == sum(n for _, n in own)
        assert row.upto == sum(n for x, n in own if x >= row.x)
    whole = O.with_running_totals(df, ["x"], {"upto": "n"}, ranges=ranges)
    assert {w.x: w.upto for w in whole.collect()} == {x: sum(n for _, y, n in rows if y <= x) for _, x, _ in rows}


def test_running_totals_shuffle_the_rows_once(spark):
    """One exchange of rows; the other two are of sums per range."""
    df = spark.range(1000).selectExpr("id % 3 g", "id x", "1L n")
    plan = explain(O.with_running_totals(df, ["x"], {"upto": "n"}, {"total": "n"}, ["g"], 8))
    row_exchanges = [line for line in plan.split("\n") if line.startswith("Arguments: hashpartitioning(_part")]
    assert plan.count("hashpartitioning(_part") <= 2 and "rangepartitioning" not in plan
    assert len(row_exchanges) <= 2


def test_exact_percentiles_equal_numpy(spark):
    r = np.random.default_rng(3)
    a, b = r.lognormal(3, 1, 999).round(2), r.integers(0, 4, 999).astype(float)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b],
                               "feature string, value double")
    steps = [i / 10 for i in range(11)]
    got = {x.feature: x.percentiles for x in O.exact_percentiles(df, steps).collect()}
    for name, values in (("a", a), ("b", b)):
        assert np.allclose(got[name], np.percentile(values, np.linspace(0, 100, 11)), atol=1e-9)


def psi_by_counting(reference, current):
    """Decile cuts from the standard library, rows counted one by one."""
    cuts = sorted({min(reference), *statistics.quantiles(reference, n=10, method="inclusive"), max(reference)})[1:-1]
    counts = [Counter(bisect.bisect_right(cuts, v) for v in side) for side in (reference, current)]
    total = 0.0
    for place in range(len(cuts) + 1):
        was, now = ((c[place] or 0.0001 * len(side)) / len(side) for c, side in zip(counts, (reference, current)))
        total += (now - was) * math.log(now / was)
    return total


def test_psi_of_a_hand_worked_table(spark):
    """Deciles of 0 to 10 are 1 to 9: eleven reference rows in bins of one, the last of two."""
    rows = [(float(v), True) for v in range(11)] + [(0.5, False), (9.5, False), (9.7, False), (20.0, False)]
    got = M.numeric_psi(spark.createDataFrame(rows, "x double, is_reference boolean"), ["x"]).first().psi
    want = (1 / 4 - 1 / 11) * math.log(11 / 4) + 8 * (0.0001 - 1 / 11) * math.log(0.0011) \
        + (3 / 4 - 2 / 11) * math.log(33 / 8)
    assert math.isclose(got, want, rel_tol=1e-9)


def test_psi_sees_drift_of_tiny_values(spark):
    rows = [(1e-8 * (1 + i / 100), True) for i in range(100)] + [(3e-8 * (1 + i / 100), False) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, is_reference boolean")
    scaled = df.selectExpr("x * 1e9 x", "is_reference")
    tiny, large = (M.numeric_psi(d, ["x"]).first().psi for d in (df, scaled))
    assert math.isclose(tiny, large, rel_tol=1e-9) and tiny > 1


@pytest.mark.parametrize("shift", [1.0, 1.3, 10.0])
def test_numeric_psi(spark, shift):
    r = np.random.default_rng(4)
    ref, cur = r.lognormal(2, 1, 800), r.lognormal(2, 1, 700) * shift
    df = spark.createDataFrame([(float(x), True) for x in ref] + [(float(x), False) for x in cur],
                               "x double, is_reference boolean")
    got = M.numeric_psi(df, ["x"]).collect()[0].psi
    assert math.isclose(got, psi_by_counting(ref.tolist(), cur.tolist()), abs_tol=1e-6)


def test_psi_of_the_same_and_of_constant_data(spark, scored):
    assert {r.drift_metric_psi for r in M.drift_between(scored, scored).collect()} == {0.0}
    constant = scored.selectExpr("1.0D payment_amount")
    other = scored.selectExpr("2.0D payment_amount")
    assert M.drift_between(constant, other).collect()[0].drift_metric_psi == 0.0


def test_new_category_counts_as_drift(spark):
    ref = spark.sql("select explode(split('a a a a b b b b', ' ')) failure_reason")
    cur = spark.sql("select explode(split('a a a a a a a c', ' ')) failure_reason")
    row = M.drift_between(ref, cur).collect()[0]
    a, b, c = ((7 / 8, .5), (.0001, .5), (1 / 8, .0001))
    want = sum((x - y) * math.log(x / y) for x, y in (a, b, c))
    assert row.drift_metric_psi == round(want, 4) and row.status == "DRIFT"


def test_quality_counts_rows_not_errors(spark, scored):
    bad = scored.drop("failed_at", "next_ok_ts").limit(10).withColumns({
        "payment_amount": F.lit(-100.0), "historical_success_rate": F.lit(1.5), "is_subscription": F.lit(2)})
    row = Q.data_quality(bad.unionByName(bad)).collect()[0]
    assert row.total_records == 20 and row.validation_failure_count == 20
    assert row.duplicate_count == 10 and row.validation_failure_rate == 1.0
    assert row.missing_value_count == 0


def test_transitions(spark):
    paths = spark.sql("select array('FAILED', 'CLOSED') state_history union all "
                      "select array('FAILED', 'ASSESSED', 'NOWHERE') union all select array('FAILED')")
    bad = {(r.from_state, r.to_state) for r in Q.transition_violations(Q.path_transitions(paths)).collect()}
    assert bad == {("FAILED", "CLOSED"), ("ASSESSED", "NOWHERE")}
    assert ("FAILED", "ASSESSED") in STATE_EDGES


def test_insert_if_absent(spark):
    incoming = spark.sql("select * from values ('a', 1), ('a', 2), ('b', 3), ('c', 4) t(k, n)")
    stored = spark.sql("select 'b' k")
    assert {(r.k, r.n) for r in S.insert_if_absent(incoming, stored, ["k"], ["n"]).collect()} == {
        ("a", 1), ("c", 4)}
    flags = {r.n: r.is_duplicate for r in S.insert_outcome(incoming, stored, ["k"], ["n"]).collect()}
    assert flags == {1: False, 2: True, 3: True, 4: False}


def test_exact_copies_are_one_insert(spark):
    copied = spark.sql("select * from values ('a', 1), ('a', 1), ('a', 1), ('b', 2), ('b', 2), ('c', 3) t(k, n)")
    stored = spark.sql("select 'b' k")
    rows = S.insert_if_absent(copied, stored, ["k"], ["n"]).collect()
    assert sorted((r.k, r.n) for r in rows) == [("a", 1), ("c", 3)]
    flags = Counter((r.k, r.is_duplicate) for r in S.insert_outcome(copied, stored, ["k"], ["n"]).collect())
    assert flags == {("a", False): 1, ("a", True): 2, ("b", True): 2, ("c", False): 1}
    assert S.first_per_key(copied, ["k"], ["n"]).count() == 3


def test_insert_keeps_rows_without_an_order_value(spark):
    incoming = spark.sql("select * from values ('a', 1, null), ('b', 2, 5) t(k, n, at)")
    rows = S.insert_if_absent(incoming, spark.sql("select 'x' k"), ["k"], ["at", "n"]).collect()
    assert {r.k for r in rows} == {"a", "b"}


def test_orphans_ignore_null_keys(spark):
    child = spark.sql("select explode(array('a', 'a', 'x', null)) k")
    assert [(r.k, r.rows) for r in Q.orphans(child, "k", spark.sql("select 'a' k")).collect()] == [("x", 1)]


def test_audit_summary_and_filters(spark):
    df = spark.sql("""select * from values ('Retry Payment', 'HIGH', 0.8, 100.0, 50.0),
        ('Retry Payment', 'HIGH', 0.8, 100.0, 50.0), ('Payment Method Reminder', 'MEDIUM', 0.5, 50.0, 0.0)
        t(recommended_action, recovery_priority, model_probability, expected_recovery, expected_retry_net_value)""")
    row = A.audit_summary(df).collect()[0]
    assert (row.retry_decisions, row.reminder_decisions, row.manual_review_decisions) == (2, 1, 0)
    assert row.simulated_recovery_count is None and row.total_expected_recovery == 250
    assert keep_matching(df, recommended_action="Retry Payment", recovery_priority=None).count() == 2
    assert A.filter_audit(df.withColumn("strategy_name", F.lit("s")), priority="MEDIUM").count() == 1


def test_audit_defaults(spark):
    bare = spark.sql("select cast(5000 as decimal(14,2)) payment_amount, cast(0.8 as decimal(7,6)) recovery_probability")
    first = A.audit_records(bare, "s", "2026-09-02T12:00:00Z").collect()[0]
    again = A.audit_records(bare, "s", "2026-09-02T12:00:00Z").collect()[0]
    assert first.audit_id == again.audit_id and len(first.audit_id) == 16
    assert first.payment_id == "UNKNOWN" and first.recovery_priority == "HIGH"
    assert first.recommended_action == "Unknown" and first.simulated_recovered is None
    assert len(first.asDict()) == 17 and first.expected_recovery == 4000
    now = A.audit_records(bare, "s").collect()[0].timestamp
    assert now.endswith("+00:00") and len(now) > 15


def test_rank_metrics_against_brute_force(spark):
    r = np.random.default_rng(9)
    y, p = r.integers(0, 2, 300), r.integers(0, 40, 300) / 40  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "recovered int, s double")
    row = E.rank_metrics(df, score="s").collect()[0]
    pos, neg = p[y == 1], p[y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert math.isclose(row.roc_auc, wins / (len(pos) * len(neg)), abs_tol=1e-12)
    ap = sum((y[p == s].sum() / y.sum()) * (y[p >= s].mean()) for s in np.unique(p))
    assert math.isclose(row.pr_auc, ap, abs_tol=1e-12)


def test_folds_are_balanced(spark, scored):
    folds = E.stratified_folds(scored.select("payment_id", "recovered"))
    counts = folds.groupBy("recovered", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r.recovered == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_champion_ties_stay_with_the_incumbent(spark):
    df = spark.sql("select * from values ('lr', 0.8D), ('gbt', 0.8D) t(model, roc_auc)")
    assert E.champion(df, "lr").collect()[0].champion == "lr"


def test_calibration_bins_are_right_closed(spark):
    df = spark.sql("select 1 recovered, explode(array(0.1D, 0.10001D, 1.0D)) recovery_probability")
    assert {(r.bin, r.n) for r in E.calibration_curve(df).collect()} == {(0, 1), (1, 1), (9, 1)}
