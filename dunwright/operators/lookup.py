"""Lookups of small fixed tables: as expressions, and as a dimension join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import dec, text


def rows_of(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A small literal table; Spark knows its size and plans joins with it accordingly."""
    def literal(v) -> str:
        if v is None:
            return "null"
        return text(v) if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {values} as t({columns})")


def action_value(action: str, table: dict[str, tuple[float, float]], field: int,
                 precision: int = 10, default: float | None = 0.0) -> str:
    """Cost (field 0) or multiplier (field 1) of an action; a missing action takes the default.

    A handful of literals compiles into the stage, so no join is planned at all.
    """
    whens = " ".join(f"when {text(name)} then {dec(pair[field], precision, 2)}"
                     for name, pair in table.items())
    other = "null" if default is None else dec(default, precision, 2)
    return f"case {action} {whens} else {other} end"


def action_dimension(spark: SparkSession, table: dict[str, tuple[float, float]]) -> DataFrame:
    """The action table as rows ``(action, cost, multiplier)``."""
    rows = [(name, float(cost), float(multiplier)) for name, (cost, multiplier) in table.items()]
    return rows_of(spark, "action, cost, multiplier", rows).selectExpr(
        "action", "cast(cost as decimal(10,2)) cost", "cast(multiplier as decimal(3,2)) multiplier")


def join_actions(df: DataFrame, action: str, actions: DataFrame) -> DataFrame:
    """Left lookup join; an action outside the table gives NULLs.

    Actions are a fixed handful of rows, so the broadcast does not grow with the data.
    """
    return df.join(F.broadcast(actions.withColumnRenamed("action", action)), action, "left")


def densify(df: DataFrame, column: str, categories: tuple, measures: list[str]) -> DataFrame:
    """One row per category in the given order, absent ones with zeros."""
    spine = rows_of(df.sparkSession, f"{column}, position",
                    [(c, i) for i, c in enumerate(categories)])
    return spine.join(df, column, "left").selectExpr(
        column, "position", *[f"coalesce({m}, 0) {m}" for m in measures])


def keep_matching(df: DataFrame, **equals) -> DataFrame:
    """Conjunctive equality filters; an argument of None means no filter."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df
