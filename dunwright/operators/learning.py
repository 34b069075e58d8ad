"""Training, cross-validation, calibration and batch scoring with ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from . import compiled  # imports this module too
from .decide import score_with_probability
from .evaluation import METRICS, all_metrics, nested_folds, stratified_folds
from .isotonic import IsotonicSteps, fit_isotonic, fit_isotonic_parts  # noqa: F401
from .ordering import materialize

MODEL_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES
PLAIN, CALIBRATED = "Uncalibrated LR", "Calibrated LR"
AT_ONCE = 4  # fits in flight: their short jobs overlap, and each holds the feature blocks of its training rows


def model_inputs(df: DataFrame) -> DataFrame:
    """Features in the types the pipeline expects; everything else is passed through."""
    return df.withColumns({
        **{c: F.expr(f"cast({c} as double)") for c in NUMERIC_FEATURES},
        **{c: F.expr(f"cast({c} as string)") for c in CATEGORICAL_FEATURES}})


def feature_stages() -> list:
    """Standardised numbers and one-hot categories; an unseen category is all zeros."""
    indexed = [f"{c}_index" for c in CATEGORICAL_FEATURES]
    return [
        VectorAssembler(inputCols=list(NUMERIC_FEATURES), outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=list(CATEGORICAL_FEATURES), outputCols=indexed,
                      handleInvalid="keep", stringOrderType="alphabetAsc"),
        # the extra slot that "keep" adds for unseen values is the dropped last one
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_hot" for c in CATEGORICAL_FEATURES],
                      dropLast=True),
        VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in CATEGORICAL_FEATURES]],
                        outputCol="features"),
    ]


def class_sizes(df: DataFrame, label: str = "recovered", sets: tuple[str, ...] = ("true",)
                ) -> list[tuple[int, int, int]]:
    """Rows, positives and negatives of every set of rows (conditions as SQL text), in one pass."""
    row = df.agg(*[F.expr(f"count_if(({s}) and {c})") for s in sets for c in (
        "true", f"{label} = 1", f"{label} = 0")]).first()
    return [tuple(row[i:i + 3]) for i in range(0, len(row), 3)]


def class_weights(df: DataFrame, label: str = "recovered", sizes: tuple[int, int, int] | None = None
                  ) -> DataFrame:
    """Add ``weight`` = rows / (2 · rows of the class)."""
    n, pos, neg = sizes or class_sizes(df, label)[0]
    return df.withColumn("weight", F.expr(f"{n}L / (2.0D * case when {label} = 1 then {pos}L else {neg}L end)"))


def logistic_estimator(rows: int, balanced: bool = False, label: str = "recovered"
                       ) -> LogisticRegression:
    """L2 logistic regression with unit inverse regularisation (regParam = 1/rows)."""
    estimator = LogisticRegression(
        featuresCol="features", labelCol=label, maxIter=1000, tol=1e-4,
        regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False)
    return estimator.setWeightCol("weight") if balanced else estimator


def boosted_estimator(label: str = "recovered", trees: int = 100, depth: int = 6) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth,
                         stepSize=0.3, seed=42)


def _fit_features(table: DataFrame) -> PipelineModel:
    """The fitted feature stages; labels are alphabetical, so distinct categories give what all rows give."""
    stages = feature_stages()
    numbers = Pipeline(stages=stages[:2]).fit(table)
    codes = Pipeline(stages=stages[2:]).fit(table.select(*CATEGORICAL_FEATURES).distinct())
    return PipelineModel(stages=numbers.stages + codes.stages)


def _fit_logistic(table: DataFrame, sizes: tuple[int, int, int], balanced: bool, label: str) -> PipelineModel:
    """The solver reads its rows twice, so they come as one compiled array, not from stage to stage."""
    features = _fit_features(table)
    extra = ["weight"] if balanced else []
    rows = class_weights(table, label, sizes) if balanced else table
    places = [F.expr(e) for e in compiled.feature_columns(features.stages, "features")]
    fitted = logistic_estimator(sizes[0], balanced, label).fit(
        rows.select(array_to_vector(F.array(*places)).alias("features"), label, *extra))
    return PipelineModel(stages=features.stages + [fitted])


def train_logistic(df: DataFrame, balanced: bool = False, label: str = "recovered") -> PipelineModel:
    """Fit on a table written once; the stages pass over it several times."""
    table = materialize(model_inputs(df).select(*MODEL_COLUMNS, label))
    return _fit_logistic(table, class_sizes(table, label)[0], balanced, label)


def train_boosted(df: DataFrame, label: str = "recovered", trees: int = 100) -> PipelineModel:
    """Gradient-boosted trees on the same features."""
    table = materialize(model_inputs(df).select(*MODEL_COLUMNS, label))
    features = _fit_features(table)  # trees need the vector's attributes, which tell categories from numbers
    fitted = boosted_estimator(label, trees).fit(features.transform(table).select("features", label))
    return PipelineModel(stages=features.stages + [fitted])


def predict(model: PipelineModel, df: DataFrame, output: str = "model_score") -> DataFrame:
    """Append the positive-class probability; the table's own columns are untouched."""
    # conversions overwrite feature columns, so the original row travels along as a struct
    converted = model_inputs(df.selectExpr("struct(*) _row", "*"))
    scored = model.transform(converted)
    return scored.select("_row.*", vector_to_array("probability")[1].alias(output))


def batch_score(model_path: str, df: DataFrame) -> DataFrame:
    """Load a saved pipeline, score a table and attach the decision columns."""
    scored = predict(PipelineModel.load(model_path), df, "_score")
    return score_with_probability(scored, "_score").drop("_score")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def apply_isotonic(model: IsotonicSteps, scored: DataFrame, score: str, output: str) -> DataFrame:
    """Calibrated probability: linear between the fitted points, flat outside."""
    return scored.withColumn(output, F.expr(model.sql(score)))


class CalibratedModel:
    """Mean of several (pipeline, isotonic) pairs, each fitted on its own inner split."""

    def __init__(self, pairs: list[tuple[PipelineModel, IsotonicSteps]]):
        self.pairs = pairs

    def transform(self, df: DataFrame, output: str = "model_score") -> DataFrame:
        for i, (pipeline, isotonic) in enumerate(self.pairs):
            df = apply_isotonic(isotonic, predict(pipeline, df, f"_m{i}"), f"_m{i}", f"_c{i}")
        terms = " + ".join(f"_c{i}" for i in range(len(self.pairs)))
        helpers = ", ".join(f"_{k}{i}" for i in range(len(self.pairs)) for k in "mc")
        return df.selectExpr(f"* except ({helpers})", f"({terms}) / {len(self.pairs)} {output}")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for i, (pipeline, isotonic) in enumerate(self.pairs):
            pipeline.write().overwrite().save(f"{path}/pipeline-{i}")
            isotonic.save(spark, f"{path}/isotonic-{i}")

    @classmethod
    def load(cls, path: str, parts: int = 3) -> "CalibratedModel":
        spark = SparkSession.active()
        return cls([(PipelineModel.load(f"{path}/pipeline-{i}"),
                     IsotonicSteps.load(spark, f"{path}/isotonic-{i}")) for i in range(parts)])


def _each(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of all jobs, a few at a time, as ``pyspark.ml.tuning`` runs its fits."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def _calibrated_pairs(table: DataFrame, splits: list[tuple[str, str]], sizes: list[tuple[int, int, int]],
                      label: str) -> list[tuple[PipelineModel, IsotonicSteps]]:
    """A balanced pipeline per split (training and held-out rows as SQL text) and its isotonic steps.

    The held-out scores of all splits are written and calibrated together.
    """
    def fitted(i: int) -> tuple[PipelineModel, DataFrame]:
        train, held_out = splits[i]
        pipeline = _fit_logistic(table.filter(train), sizes[i], True, label)
        return pipeline, materialize(table.filter(held_out).selectExpr(
            f"{i} part", label, f"{compiled.model_sql(pipeline)} model_score"))

    pipelines, scored = zip(*_each(table.sparkSession, [partial(fitted, i) for i in range(len(splits))]))
    steps = fit_isotonic_parts(reduce(DataFrame.unionByName, scored), "part", label)
    return [(pipeline, steps.get(i, IsotonicSteps([], []))) for i, pipeline in enumerate(pipelines)]


def _fold_inputs(df: DataFrame, label: str) -> DataFrame:
    """What folds and fits need of a table, in the pipeline's types."""
    return model_inputs(df).select("payment_id", label, *MODEL_COLUMNS)


def train_calibrated(df: DataFrame, folds: int = 3, label: str = "recovered") -> CalibratedModel:
    """Isotonic calibration over inner stratified folds; the folds' mean is the model."""
    table = materialize(stratified_folds(_fold_inputs(df, label), label, folds=folds, seed=7))
    splits = [(f"fold <> {k}", f"fold = {k}") for k in range(folds)]
    sizes = class_sizes(table, label, tuple(train for train, _ in splits))
    return CalibratedModel(_calibrated_pairs(table, splits, sizes, label))


def cross_validated_scores(df: DataFrame, folds: int = 5, label: str = "recovered",
                           calibrated: bool = True, inner: int = 3) -> DataFrame:
    """Out-of-fold scores: ``payment_id, label, fold, model, model_score``.

    Features, folds and the inner folds of every training set are written once; each fit is a filter on
    that table.  The driver loops over folds and models only; each fit and scoring is a Spark job.
    """
    spark = df.sparkSession
    table = stratified_folds(_fold_inputs(df, label), label, folds=folds)
    table = materialize(nested_folds(table, folds, inner, label) if calibrated else table)
    plain = [f"fold <> {k}" for k in range(folds)]
    splits = [(f"inner_{k} <> {j}", f"inner_{k} = {j}")  # null inside fold k
              for k in range(folds) for j in range(inner)] if calibrated else []
    sizes = class_sizes(table, label, (*plain, *[train for train, _ in splits]))
    models = [(k, PLAIN, m) for k, m in enumerate(_each(spark, [
        partial(_fit_logistic, table.filter(train), sizes[k], True, label) for k, train in enumerate(plain)]))]
    if calibrated:
        pairs = _calibrated_pairs(table, splits, sizes[folds:], label)
        models += [(k, CALIBRATED, CalibratedModel(pairs[k * inner:(k + 1) * inner]))
                   for k in range(folds)]

    def scored(k: int, name: str, model: PipelineModel | CalibratedModel) -> DataFrame:
        return materialize(table.filter(f"fold = {k}").selectExpr(
            "payment_id", label, "fold", f"'{name}' model", f"{compiled.model_sql(model)} model_score"))

    # one by one, so that no plan holds all models
    return reduce(DataFrame.unionByName, _each(spark, [partial(scored, *m) for m in models]))


def cross_validation_metrics(scores: DataFrame, label: str = "recovered") -> DataFrame:
    """The seven metrics per model and fold."""
    return all_metrics(scores, label, "model_score", ["model", "fold"]).select(
        "model", "fold", *METRICS)
