"""Data quality: profiles, domain checks, constraints and transition conformance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType, StructType

from ..config import (
    EVENT_STATUSES, FAILURE_REASONS, OUTCOME_SOURCES, PAYMENT_METHODS, PRIORITIES, STATE_EDGES,
)
from ..functions import validation as V
from ..functions.scalars import double, text, texts
from .lookup import rows_of


def surplus_copies(df: DataFrame) -> DataFrame:
    """One row: how many full-row copies there are beyond the first.

    Only 64-bit hashes are shuffled for the whole table; rows are compared column by
    column just where a hash occurs again, and copies are counted before that shuffle.
    """
    hashed = df.withColumn("_h", F.expr(f"xxhash64({', '.join(df.columns)})"))
    again = hashed.groupBy("_h").agg(F.expr("count(1) n")).filter("n > 1").select("_h")
    copies = hashed.join(again, "_h", "left_semi").groupBy(*df.columns).agg(F.expr("count(1) n"))
    return copies.agg(F.expr("coalesce(sum(n - 1), 0) duplicate_count"))


def data_quality(df: DataFrame) -> DataFrame:
    """One row: records, missing values (total and per column), duplicates, invalid rows."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    missing = lambda c: f"{c} is null" + (f" or isnan({c})" if c in floating else "")
    out = V.with_errors(df, V.typed_fields(df)).agg(*[F.expr(e) for e in (
        "count(1) total_records", "count_if(not is_valid) validation_failure_count",
        *[f"count_if({missing(c)}) missing_{c}" for c in df.columns])])
    return out.withColumn("duplicate_count", surplus_copies(df).scalar()).selectExpr(
        "*", " + ".join(f"missing_{c}" for c in df.columns) + " missing_value_count",
        "case when total_records > 0 then round(validation_failure_count / total_records, 4) "
        "else 0.0D end validation_failure_rate")


def dataset_checks(df: DataFrame) -> DataFrame:
    """Rows ``(check, violations)`` for impossible values."""
    return _counted_checks(df, "check", {
        "negative_payment_amount": "payment_amount < 0",
        "success_rate_out_of_bounds": "historical_success_rate not between 0 and 1",
        "invalid_subscription_flag": "is_subscription not in (0, 1)",
        "invalid_target": "recovered not in (0, 1)",
    })


def _counted_checks(df: DataFrame, label: str, checks: dict[str, str]) -> DataFrame:
    wide = df.agg(*[F.expr(f"count_if({bad}) {name}") for name, bad in checks.items()])
    return wide.unpivot([], list(checks), label, "violations")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each column pair over the rows where both are known.

    The pairs of a row are exploded inside the scan stage and folded into one small
    map-side group per pair; one wide aggregate of all pairs would outgrow what the
    JVM compiles.
    """
    names = sorted({c for pair in pairs for c in pair})
    doubles = df.selectExpr(*[f"cast({c} as double) {c}" for c in names])
    both = ", ".join(f"named_struct('x', {a}, 'y', {b})" for a, b in pairs)
    grouped = doubles.selectExpr(f"posexplode(array({both})) as (i, v)").groupBy("i").agg(
        F.expr("corr(v.x, v.y) correlation"))
    return grouped.selectExpr(
        f"element_at(array({texts(a for a, _ in pairs)}), i + 1) feature_a",
        f"element_at(array({texts(b for _, b in pairs)}), i + 1) feature_b", "correlation")


def leakage_check(df: DataFrame, target: str = "recovered", limit: float = 0.8) -> DataFrame:
    """Correlation of every numeric column with the target; large ones are suspicious."""
    pairs = [(c, target) for c in numeric_columns(df) if c != target]
    return _correlations(df, pairs).selectExpr(
        "feature_a feature", "correlation",
        f"coalesce(abs(correlation) > {double(limit)}, false) suspicious")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlations as rows ``(feature_a, feature_b, correlation)``, each pair once."""
    return _correlations(df, list(combinations(columns or numeric_columns(df), 2)))


# Constraint name -> SQL condition that breaks it, per stored table.
EVENT_CONSTRAINTS = {
    "chk_payment_events_amount": "payment_amount <= 0",
    "chk_payment_events_is_subscription": "is_subscription not in (0, 1)",
    "chk_payment_events_failure_reason": f"failure_reason not in ({texts(FAILURE_REASONS)})",
    "chk_payment_events_payment_method": f"payment_method not in ({texts(PAYMENT_METHODS)})",
    "chk_payment_events_success_rate": "historical_success_rate not between 0 and 1",
    "chk_payment_events_status": f"processing_status not in ({texts(EVENT_STATUSES)})",
}
DECISION_CONSTRAINTS = {
    "chk_rd_probability": "model_probability not between 0 and 1",
    "chk_rd_priority": f"recovery_priority not in ({texts(PRIORITIES)})",
}
OUTCOME_CONSTRAINTS = {
    "chk_ro_source": f"outcome_source not in ({texts(OUTCOME_SOURCES)})",
}


def not_null_constraints(schema: StructType) -> dict[str, str]:
    return {f"nn_{f.name}": f"{f.name} is null" for f in schema.fields if not f.nullable}


def with_violations(df: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """Add ``violations``; a check that is NULL counts as met, as in SQL."""
    found = ", ".join(f"case when {bad} then '{name}' end" for name, bad in constraints.items())
    return df.selectExpr("*", f"array_compact(array({found})) violations")


def split_by_constraints(df: DataFrame, constraints: dict[str, str]
                         ) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their violations)."""
    checked = with_violations(df, constraints)
    return (checked.filter("size(violations) = 0").drop("violations"),
            checked.filter("size(violations) > 0"))


def constraint_report(df: DataFrame, constraints: dict[str, str]) -> DataFrame:
    """Rows ``(constraint, violations)``, zero ones included, in one pass."""
    return _counted_checks(df, "constraint", constraints)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; copies are counted before the shuffle."""
    return df.groupBy(*keys).agg(F.expr("count(1) copies")).filter("copies > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None
            ) -> DataFrame:
    """Foreign keys without a parent, as ``(key, rows)``; NULL keys are allowed.

    References are counted per key first: a parent that a third of the table points
    to becomes one row before the join.
    """
    refs = child.filter(f"{key} is not null").groupBy(key).agg(F.expr("count(1) rows"))
    return refs.join(parent.selectExpr(f"{parent_key or key} {key}"), key, "left_anti")


@dataclass(frozen=True)
class Reference:
    """A foreign key: ``child.key`` must be among the values of its domain's parent."""

    name: str
    child: DataFrame
    key: str
    domain: str


def all_orphans(references: list[Reference], parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows ``(reference, key, rows)`` of keys without a parent, over all foreign keys at once.

    ``parents`` maps a domain to its table and key.  Parents and children are one tagged union: an
    aggregation by (domain, key) counts every reference and notes the parent, so each table is read once
    and each key meets its parent in one shuffle, combined before it.  NULL keys are allowed.
    """
    names = [r.name for r in references]
    none = ", ".join("0L" for _ in names)
    sides = [table.selectExpr(f"{text(domain)} domain", f"cast({key} as string) key", "1 found", f"array({none}) n")
             for domain, (table, key) in parents.items()]
    for r in references:
        own = ", ".join("1L" if n == r.name else "0L" for n in names)
        sides.append(r.child.selectExpr(f"{text(r.domain)} domain", f"cast({r.key} as string) key", "0 found",
                                        f"array({own}) n"))
    counted = reduce(DataFrame.unionByName, sides).filter("key is not null").groupBy("domain", "key").agg(
        F.expr("max(found) found"), *[F.expr(f"sum(n[{i}]) n{i}") for i in range(len(names))])
    rows = ", ".join(f"struct({text(n)} as reference, n{i} as rows)" for i, n in enumerate(names))
    return counted.filter("found = 0").selectExpr("key", f"inline(array({rows}))").filter(
        "rows > 0").select("reference", "key", "rows")


def all_constraints(tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Rows ``(table, constraint, violations)`` of several tables, each read once."""
    return reduce(DataFrame.unionByName, [
        constraint_report(df, checks).selectExpr(f"{text(name)} table", "constraint", "violations")
        for name, (df, checks) in tables.items()])


def path_transitions(paths: DataFrame, states: str = "state_history") -> DataFrame:
    """Counted state changes ``(from_state, to_state, transitions)`` of array paths.

    Equal paths are counted first, so only distinct ones are taken apart.  The outer
    generator keeps Spark from pushing a size test back through the path expression.
    """
    distinct = paths.groupBy(F.expr(f"{states} as _path")).agg(F.expr("count(1) n"))
    last = "greatest(size(_path) - 1, 0)"
    steps = (f"zip_with(slice(_path, 1, {last}), slice(_path, 2, {last}), "
             "(a, b) -> named_struct('from_state', a, 'to_state', b))")
    return (distinct.selectExpr("n", f"inline_outer({steps})").filter("to_state is not null")
            .groupBy("from_state", "to_state").agg(F.expr("sum(n) transitions")))


def log_transitions(log: DataFrame, path: str, position: str, state: str) -> DataFrame:
    """Counted state changes of a log with one row per step, positions without gaps.

    Neighbours meet by an equi-join on (path, position), which spreads a path of any
    length over all tasks; a window per path would not.
    """
    before = log.selectExpr(path, f"{position} + 1 {position}", f"{state} from_state")
    steps = log.selectExpr(path, position, f"{state} to_state").join(before, [path, position])
    return steps.groupBy("from_state", "to_state").agg(F.expr("count(1) transitions"))


def conformance(transitions: DataFrame) -> DataFrame:
    """Flag each counted transition as allowed or not (unknown states are not)."""
    edges = rows_of(transitions.sparkSession, "from_state, to_state, ok",
                    [(a, b, 1) for a, b in STATE_EDGES])
    return transitions.join(F.broadcast(edges), ["from_state", "to_state"], "left").selectExpr(
        "from_state", "to_state", "transitions", "ok is not null allowed")


def transition_violations(transitions: DataFrame) -> DataFrame:
    """Only the transitions no edge allows."""
    return conformance(transitions).filter("not allowed").drop("allowed")
