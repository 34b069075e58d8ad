"""Model evaluation on scored tables: curves, metrics, calibration, folds.

Rank metrics first count labels per distinct score, compared as exact doubles of any size;
running sums over these counts are range-partitioned, so no step orders the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.decisions import REASON_WEIGHTS
from ..functions.scalars import double, ratio, text
from .ordering import with_global_rank, with_running_totals

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier")


def _running_scores(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Distinct scores with own and running counts, best first, place and class totals."""
    counts = df.groupBy(*by, F.expr(f"cast({score} as double) as score")).agg(
        F.expr(f"count_if({label} = 1) pos"), F.expr(f"count_if({label} = 0) neg"), F.expr("1L one"))
    return with_running_totals(counts, ["-score"], {"tp": "pos", "fp": "neg", "place": "one"},
                               {"P": "pos", "N": "neg"}, by)


def roc_curve(df: DataFrame, label: str = "recovered", score: str = "recovery_probability",
              by: list[str] | None = None) -> DataFrame:
    """A point per distinct score, plus the (0, 0) start with NULL threshold."""
    by = by or []
    points = _running_scores(df, by, label, score).selectExpr(
        *by, "score threshold", "tp", "fp", f"{ratio('tp', 'P')} tpr", f"{ratio('fp', 'N')} fpr")
    start = df.select(*by).distinct() if by else df.sparkSession.range(1)
    return points.unionByName(start.selectExpr(
        *by, "cast(null as double) threshold", "0L tp", "0L fp", "0.0D tpr", "0.0D fpr"))


def roc_corners(df: DataFrame, label: str = "recovered", score: str = "recovery_probability"
                ) -> DataFrame:
    """The ROC curve without points on a straight line between their neighbours.

    A step's slope is its own (pos, neg) pair, so a point stays when the next score
    has another pair; neighbours meet by position, not in one sorted task.
    """
    placed = _running_scores(df, [], label, score)
    following = placed.selectExpr("place - 1 place", "pos next_pos", "neg next_neg")
    kept = placed.join(following, "place", "left").filter(
        "next_pos is null or next_pos <> pos or next_neg <> neg")
    points = kept.selectExpr("score threshold", f"{ratio('tp', 'P')} tpr", f"{ratio('fp', 'N')} fpr")
    return points.unionByName(df.sparkSession.range(1).selectExpr(
        "cast(null as double) threshold", "0.0D tpr", "0.0D fpr"))


def rank_metrics(df: DataFrame, label: str = "recovered", score: str = "recovery_probability",
                 by: list[str] | None = None) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per group."""
    by = by or []
    # twice the area in whole numbers: neg · (2 · positives above + tied positives)
    sums = _running_scores(df, by, label, score).groupBy(*by).agg(*[F.expr(e) for e in (
        "sum(cast(neg as decimal(19,0)) * cast(2 * tp - pos as decimal(19,0))) twice",
        "sum(pos * tp / (tp + fp)) ap", "max(P) P", "max(N) N")])
    return sums.selectExpr(
        *by, f"{ratio('twice', '2.0D * P * N')} roc_auc", f"{ratio('ap', 'P')} pr_auc")


def confusion_matrix(df: DataFrame, label: str = "recovered", score: str = "recovery_probability",
                     threshold: float = 0.5) -> DataFrame:
    """Rows by actual class, columns by predicted class (score above the threshold)."""
    predicted = df.selectExpr(f"{label} actual", f"cast({score} > {double(threshold)} as int) predicted")
    return (predicted.groupBy("actual").pivot("predicted", [0, 1]).agg(F.expr("count(1)"))
            .na.fill(0).withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"}))


def classification_metrics(df: DataFrame, label: str = "recovered",
                           score: str = "recovery_probability", threshold: float = 0.5,
                           by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and Brier score per group, in one pass."""
    by = by or []
    hit = f"{score} > {double(threshold)}"
    sums = df.groupBy(*by).agg(*[F.expr(e) for e in (
        "count(1) n", f"count_if({label} = 1 and {hit}) tp", f"count_if({label} <> 1 and {hit}) fp",
        f"count_if({label} = 1 and not ({hit})) fn",
        f"avg(power(cast({score} as double) - {label}, 2)) brier")])
    return sums.selectExpr(
        *by, f"{ratio('n - fp - fn', 'n')} accuracy", f"{ratio('tp', 'tp + fp')} precision",
        f"{ratio('tp', 'tp + fn')} recall", f"{ratio('2 * tp', '2 * tp + fp + fn')} f1", "brier")


def all_metrics(df: DataFrame, label: str = "recovered", score: str = "recovery_probability",
                by: list[str] | None = None) -> DataFrame:
    """The seven metrics per group (models and folds, say)."""
    flat = classification_metrics(df, label, score, by=by)
    ranked = rank_metrics(df, label, score, by)
    if by:
        return flat.join(ranked, by)
    both = ranked.selectExpr("struct(roc_auc, pr_auc)").scalar()
    return flat.withColumn("_r", both).selectExpr("* except (_r)", "_r.*")


def brier_score(df: DataFrame, label: str = "recovered", score: str = "recovery_probability"
                ) -> DataFrame:
    return df.agg(F.expr(f"avg(power(cast({score} as double) - {label}, 2)) brier"))


def calibration_curve(df: DataFrame, label: str = "recovered", score: str = "recovery_probability",
                      bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean score and share of positives per uniform bin (inner edges right-closed)."""
    edges = ", ".join(double(i / bins) for i in range(1, bins))
    return df.groupBy(*(by or []), F.expr(
        f"size(filter(array({edges}), e -> e < cast({score} as double))) as bin")).agg(*[
            F.expr(e) for e in (
                "count(1) n", f"cast(sum({score}) as double) / count(1) mean_predicted",
                f"avg(cast({label} as double)) fraction_of_positives")])


def stratified_folds(df: DataFrame, label: str = "recovered", key: str = "payment_id",
                     folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0 … folds−1), balanced to within one row inside every class.

    Rows are ordered by class and a keyed hash with the distributed rank; classes are
    never gathered in a task.
    """
    shuffled = df.selectExpr("*", f"sha2(concat_ws('_', {key}, '{seed}'), 256) _h")
    ranked = with_global_rank(shuffled, [F.col(label), F.col("_h"), F.col(key)], "_rank")
    starts = ranked.groupBy(label).agg(F.expr("min(_rank) _start"))  # one row per class
    return ranked.join(F.broadcast(starts), label).selectExpr(
        "* except (_h, _rank, _start)", f"cast((_rank - _start) % {folds} as int) fold")


def nested_folds(df: DataFrame, folds: int, inner: int = 3, label: str = "recovered", key: str = "payment_id",
                 seed: int = 7) -> DataFrame:
    """Add ``inner_k`` for every ``fold`` k: the stratified inner fold among the rows outside k, NULL inside it.

    Equals :func:`stratified_folds` over each training set.  One order serves them all: a row's place in a
    training set is the running count of its class without fold k.
    """
    counted = df.selectExpr("*", f"sha2(concat_ws('_', {key}, '{seed}'), 256) _h", *[
        f"cast(fold <> {k} as bigint) _n{k}" for k in range(folds)])
    placed = with_running_totals(counted, ["_h", key], {f"_r{k}": f"_n{k}" for k in range(folds)}, group=[label])
    return placed.selectExpr(*[f"`{c}`" for c in df.columns], *[
        f"case when fold <> {k} then cast((_r{k} - 1) % {inner} as int) end inner_{k}" for k in range(folds)])


def holdout_split(df: DataFrame, label: str = "recovered", key: str = "payment_id",
                  seed: int = 42) -> DataFrame:
    """Stratified 80/20 split as a boolean ``is_test``."""
    return stratified_folds(df, label, key, 5, seed).selectExpr("* except (fold)", "fold = 0 is_test")


def fold_summary(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Mean and sample deviation over folds, four digits."""
    names = [m for m in METRICS if m in metrics.columns]
    return metrics.groupBy(model).agg(*[F.expr(e) for m in names for e in (
        f"round(avg({m}), 4) {m}_mean", f"round(stddev_samp({m}), 4) {m}_std")])


def champion(metrics: DataFrame, incumbent: str, model: str = "model", metric: str = "roc_auc"
             ) -> DataFrame:
    """Best model; a challenger replaces the incumbent only when strictly better."""
    return metrics.agg(F.expr(
        f"max_by(struct({model}, {metric}), struct({metric}, {model} = {text(incumbent)})) _m")
    ).selectExpr(f"_m.{model} champion", f"_m.{metric} {metric}")


def calibration_verdict(summary: DataFrame, plain: str, calibrated: str, gain: float = 0.001
                        ) -> DataFrame:
    """Accept calibration when its mean Brier score is lower; refit only past ``gain``."""
    brier = lambda name: f"max(case when model = {text(name)} then brier_mean end)"
    return summary.agg(F.expr(f"{brier(plain)} plain_brier"),
                       F.expr(f"{brier(calibrated)} calibrated_brier")).selectExpr(
        "*", "calibrated_brier < plain_brier calibration_accepted",
        f"plain_brier - calibrated_brier > {double(gain)} refit")


# Scorecard coefficient per raw feature.
SCORECARD_COEFFICIENTS = {
    "historical_success_rate": 3.0,
    "customer_tenure_months": 1.5 / 60.0,
    "time_since_last_success_days": -1.0 / 365.0,
    "past_failed_payments": -0.3,
    "days_overdue": -2.0 / 30.0,
    "recovery_attempts_so_far": -0.5,
    "is_subscription": 0.8,
    **{f"failure_reason={name}": weight for name, weight in REASON_WEIGHTS.items()},
}


def linear_attribution(df: DataFrame, coefficients: dict[str, float] | None = None) -> DataFrame:
    """Mean |coefficient · (x − mean)| per feature over all rows.

    ``column=value`` names a 0/1 indicator of a categorical column.
    """
    coefficients = coefficients or SCORECARD_COEFFICIENTS

    def feature(name: str) -> str:
        column, _, value = name.partition("=")
        return f"double({column} = {text(value)})" if value else f"double({column})"

    names = list(coefficients)
    wide = df.selectExpr(*[f"{feature(n)} x{i}" for i, n in enumerate(names)])
    averages = ", ".join(f"avg(x{i}) m{i}" for i in range(len(names)))
    means = wide.agg(F.expr(f"struct({averages})")).scalar()
    rows = ", ".join(
        f"named_struct('feature', {text(n)}, 'importance', "
        f"avg(abs({double(coefficients[n])} * (x{i} - _m.m{i}))))" for i, n in enumerate(names))
    return wide.withColumn("_m", means).agg(F.expr(f"array({rows}) r")).selectExpr("inline(r)")
