"""Fitted models as SQL text over the raw payment columns.

A pipeline's stages are folded into expressions: scaled numbers, one-hot tests, coefficients, trees and
isotonic steps.  The text scores a row without Python and without ``pyspark.ml``, so tables, streams and
single-event responses can all use it.  Trees and steps are literal tables that are walked by index, which
keeps the text (and the code generated from it) small.
"""

from __future__ import annotations

import json
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler

from ..functions.scalars import double, text
from . import learning  # imports this module too

_TREE = ("array<struct<w:double,f:array<int>,t:array<double>,l:array<int>,r:array<int>,v:array<double>>>")


def model_sql(model: PipelineModel | learning.CalibratedModel) -> str:
    """The positive-class probability as SQL text."""
    if isinstance(model, learning.CalibratedModel):
        parts = [isotonic.sql(model_sql(pipeline)) for pipeline, isotonic in model.pairs]
        return f"(({' + '.join(parts)}) / {len(parts)})"
    classifier = model.stages[-1]
    features = feature_columns(model.stages[:-1], classifier.getFeaturesCol())
    if isinstance(classifier, LogisticRegressionModel):
        terms = _sum([double(classifier.intercept), *[
            f"{double(c)} * {f}" for c, f in zip(classifier.coefficients.toArray(), features)]])
        return f"(1.0D / (1.0D + exp(-({terms}))))"
    if isinstance(classifier, GBTClassificationModel):
        return f"(1.0D / (1.0D + exp(-2.0D * {_trees_sql(classifier, features)})))"
    raise TypeError(f"no expression for {type(classifier).__name__}")


def _sum(terms: list[str]) -> str:
    """Halves added to halves, so that the expression stays flat."""
    if len(terms) == 1:
        return terms[0]
    half = len(terms) // 2
    return f"({_sum(terms[:half])} + {_sum(terms[half:])})"


def feature_columns(stages: list, name: str) -> list[str]:
    """An expression per place of the vector ``name`` that fitted feature stages make."""
    made: dict[str, list[str]] = {}    # vectors
    coded: dict[str, tuple[str, list[str]]] = {}  # index column -> (raw column, labels)
    for stage in stages:
        if isinstance(stage, VectorAssembler):
            made[stage.getOutputCol()] = [e for c in stage.getInputCols()
                                          for e in made.get(c, [f"cast({c} as double)"])]
        elif isinstance(stage, StandardScalerModel):
            made[stage.getOutputCol()] = [
                f"(({e} - {double(mean)}) * {double(1.0 / std if std else 0.0)})"
                for e, mean, std in zip(made[stage.getInputCol()], stage.mean.toArray(), stage.std.toArray())]
        elif isinstance(stage, StringIndexerModel):
            for raw, index, labels in zip(stage.getInputCols(), stage.getOutputCols(), stage.labelsArray):
                coded[index] = (raw, list(labels))
        elif isinstance(stage, OneHotEncoderModel):
            for index, out, size in zip(stage.getInputCols(), stage.getOutputCols(), stage.categorySizes):
                made[out] = [_one_hot(*coded[index], i) for i in range(size - int(stage.getDropLast()))]
        else:
            raise TypeError(f"no expression for {type(stage).__name__}")
    return made[name]


def _one_hot(raw: str, labels: list[str], i: int) -> str:
    if i < len(labels):
        return f"if({raw} <=> {text(labels[i])}, 1.0D, 0.0D)"
    return f"if(coalesce({raw} in ({', '.join(map(text, labels))}), false), 0.0D, 1.0D)"  # unseen values


def _trees_sql(model: GBTClassificationModel, features: list[str]) -> str:
    """The weighted sum of all trees; a walk takes as many steps as the deepest tree has levels."""
    trees = [{"w": w, **_tree_table(t.toDebugString)} for w, t in zip(model.treeWeights, model.trees)]
    depth = max([t.depth for t in model.trees] + [1])
    table = f"from_json({text(json.dumps(trees))}, '{_TREE}')"
    leaf = (f"aggregate(sequence(1, {depth}), 0, (n, i) -> if(tree.f[n] < 0, n,"
            " if(x[tree.f[n]] <= tree.t[n], tree.l[n], tree.r[n])))")
    return (f"transform(array(array({', '.join(features)})), x -> aggregate({table}, 0.0D,"
            f" (total, tree) -> total + tree.w * tree.v[{leaf}]))[0]")


_SPLIT = re.compile(r"If \(feature (\d+) (<=|in|not in) (.*)\)$")


def _tree_table(shown: str) -> dict[str, list]:
    """Node arrays (feature or -1, threshold, left, right, value) of a tree as Spark prints it."""
    lines = [line.strip() for line in shown.split("\n")[1:] if line.strip()]
    table: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "v": []}

    def node(at: int) -> tuple[int, int]:
        """Read the node that starts in line ``at``; its number and the line after it."""
        n = len(table["f"])
        for c, empty in zip("ftlrv", (-1, 0.0, 0, 0, 0.0)):
            table[c].append(empty)
        if lines[at].startswith("Predict: "):
            table["v"][n] = float(lines[at].removeprefix("Predict: "))
            return n, at + 1
        feature, test, value = _SPLIT.match(lines[at]).groups()
        left, at = node(at + 1)
        right, at = node(at + 1)  # after the line "Else (...)"
        if test != "<=":  # a 0/1 feature, printed as a category
            categories = {float(v) for v in value.strip("{}").split(",")}
            if not categories <= {0.0, 1.0}:
                raise ValueError(f"a split on categories {value} has no threshold")
            if (categories == {1.0}) == (test == "in"):
                left, right = right, left
            value = 0.5
        table["f"][n], table["t"][n], table["l"][n], table["r"][n] = int(feature), float(value), left, right
        return n, at

    node(0)
    return table


def linear_coefficients(model: PipelineModel) -> dict[str, float]:
    """Coefficients of a logistic pipeline per raw column, ``column=value`` for categories.

    Scaling is undone, so they are those of the unscaled columns (see ``evaluation.linear_attribution``).
    """
    if not isinstance(model.stages[-1], LogisticRegressionModel):
        raise TypeError("only linear models have coefficients")
    names: list[tuple[str, float]] = []
    scaled: dict[str, list[tuple[str, float]]] = {}
    coded: dict[str, tuple[str, list[str]]] = {}
    for stage in model.stages[:-1]:
        if isinstance(stage, VectorAssembler):
            names = [e for c in stage.getInputCols() for e in scaled.get(c, [(c, 1.0)])]
            scaled[stage.getOutputCol()] = names
        elif isinstance(stage, StandardScalerModel):
            scaled[stage.getOutputCol()] = [(c, 1.0 / std if std else 0.0) for (c, _), std in zip(
                scaled[stage.getInputCol()], stage.std.toArray())]
        elif isinstance(stage, StringIndexerModel):
            coded.update({i: (r, list(v)) for r, i, v in zip(
                stage.getInputCols(), stage.getOutputCols(), stage.labelsArray)})
        elif isinstance(stage, OneHotEncoderModel):
            for index, out, size in zip(stage.getInputCols(), stage.getOutputCols(), stage.categorySizes):
                raw, labels = coded[index]
                scaled[out] = [(f"{raw}={v}", 1.0) for v in labels[:size - int(stage.getDropLast())]]
    return {name: float(c * unit) for (name, unit), c in zip(
        names, model.stages[-1].coefficients.toArray())}
