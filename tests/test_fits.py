"""The distributed isotonic fit and drift per window, against brute force."""

import random
from fractions import Fraction

import pytest

from dunwright.operators import isotonic, monitoring as M
from dunwright.operators.ordering import materialize
from dunwright.streaming import monitor


def brute_fit(rows):
    """max over starts of min over ends of the mean between, per distinct score."""
    scores = sorted({x for x, _ in rows})
    n = [sum(1 for x, _ in rows if x == s) for s in scores]
    p = [sum(y for x, y in rows if x == s) for s in scores]
    mean = lambda i, j: Fraction(sum(p[i:j + 1]), sum(n[i:j + 1]))
    return {s: float(max(min(mean(i, j) for j in range(k, len(scores))) for i in range(k + 1)))
            for k, s in enumerate(scores)}


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "few", "constant"])
def test_isotonic_fit_equals_brute_force(spark, kind):
    r = random.Random(kind)
    rows = []
    for i in range(240):
        x = r.randint(0, 60) / 64 if kind != "few" else r.choice([0.25, 0.5])
        p = {"noise": x, "rising": float(x > 0.4), "falling": 1 - x, "few": x, "constant": 1.0}[kind]
        rows.append((x, int(r.random() < p)))
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None), (float("nan"), 1)],
                               "model_score double, recovered int")
    want = brute_fit(rows)
    for ranges in (1, 7):
        steps = isotonic.fit_isotonic(df, ranges=ranges)
        got = spark.createDataFrame([(s,) for s in want], "s double").selectExpr("s", f"{steps.sql('s')} v")
        assert {x.s: x.v for x in got.collect()} == pytest.approx(want, abs=1e-12)
    assert all(a < b for a, b in zip(steps.boundaries, steps.boundaries[1:]))
    assert all(a <= b for a, b in zip(steps.predictions, steps.predictions[1:]))
    outside = spark.sql("select -5D s union all select 5D").selectExpr("s", f"{steps.sql('s')} v").collect()
    assert {x.s: x.v for x in outside} == {-5.0: steps.predictions[0], 5.0: steps.predictions[-1]}


def test_isotonic_fit_of_nothing_saves_and_loads(spark, tmp_path):
    none = spark.createDataFrame([], "model_score double, recovered int")
    steps = isotonic.fit_isotonic(none)
    assert steps == isotonic.IsotonicSteps([], [])
    assert spark.sql(f"select {steps.sql('0.5D')} v").first().v is None
    some = isotonic.IsotonicSteps([0.1, 0.30000000000000004], [0.0, 1 / 3])
    some.save(spark, str(tmp_path / "s"))
    assert isotonic.IsotonicSteps.load(spark, str(tmp_path / "s")) == some


def test_isotonic_fits_of_parts_equal_fits_on_their_own(spark):
    df = materialize(spark.range(3_000).selectExpr(
        "int(id % 3) part", "if(id % 3 = 2, null, round(rand(3), 2)) model_score",
        "int(rand(5) < 0.2 + 0.5 * rand(3)) recovered"))
    for ranges in (1, 7):
        got = isotonic.fit_isotonic_parts(df, "part", ranges=ranges)
        assert got == {p: isotonic.fit_isotonic(df.filter(f"part = {p}")) for p in (0, 1)}


def test_pooling_moves_blocks_only(spark):
    """Fifty thousand distinct scores in random order leave the tasks as a few blocks."""
    df = materialize(spark.range(50_000).selectExpr(
        "id / 50000D model_score", "int(rand(5) < 0.3 + 0.4 * id / 50000) recovered"))
    blocks = isotonic.isotonic_blocks(df).orderBy("lo").collect()
    assert len(blocks) < 500 and sum(b.n for b in blocks) == 50_000
    assert all(a.value < b.value and a.hi < b.lo for a, b in zip(blocks, blocks[1:]))


def test_drift_per_window_equals_drift_of_the_windows_rows(spark, scored, tmp_path):
    reference = materialize(scored.filter("day(failed_at) <= 10"))
    current = materialize(scored.filter("day(failed_at) > 10").drop("next_ok_ts"))
    profile = M.drift_profile(reference)
    feed = str(tmp_path / "feed")
    for k in range(3):
        current.filter(f"second(failed_at) % 3 = {k}").write.mode("append").parquet(feed)
    stream = spark.readStream.schema(current.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    monitor.run_drift_monitor(stream, profile, str(tmp_path / "bins"), str(tmp_path / "c"),
                              width="7 days", delay="60 days").awaitTermination()
    log = spark.read.parquet(str(tmp_path / "bins"))
    got = monitor.current_drift(log, profile).collect()
    windows = {r.window_start for r in got}
    assert len(windows) >= 3
    for start in windows:
        rows = current.filter(f"window(failed_at, '7 days').start = timestamp '{start}'")
        want = {tuple(r) for r in M.drift_between(reference, rows).collect()}
        assert {tuple(r)[1:] for r in got if r.window_start == start} == want
    same = M.window_drift(M.window_bins(reference, profile, width="4000 days"), profile).collect()
    assert {r.drift_metric_psi for r in same} == {0.0}
