"""Sinks and scans: tables written by the writers and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import audit as A
from ..operators.ordering import shared_folder
from ..schemas import FAILED_PAYMENTS, SCORED_PAYMENTS
from ..sources import readers, writers
from .decision_queries import _FEATURES, _FEATURES_SQL, _SCORED
from .registry import Tables, money, query


def _path(t: Tables, kind: str) -> str:
    return f"{shared_folder(t.spark)}/{kind}-{uuid.uuid4().hex}"


@query("csv_round_trip", _FEATURES_SQL)
def csv_round_trip(t: Tables) -> DataFrame:
    """Payments through the CSV sink and the declared-schema CSV scan."""
    path = _path(t, "csv")
    writers.write_csv(t.payments.select(*FAILED_PAYMENTS.fieldNames()), path)
    return readers.read_payments_csv(t.spark, path).selectExpr(*_FEATURES)


@query("scored_parquet_round_trip", f"SELECT {', '.join(_SCORED)} FROM scored")
def scored_parquet_round_trip(t: Tables) -> DataFrame:
    path = _path(t, "scored")
    writers.write_parquet(t.scored.select(*SCORED_PAYMENTS.fieldNames()), path)
    return readers.read_payments(t.spark, path, SCORED_PAYMENTS).selectExpr(*_SCORED)


@query("audit_partitioned_sink", f"""
SELECT 'Blind Retry' AS strategy_name, recommended_action, count(*) AS records,
  {money('sum(expected_recovery)', 'expected_recovery')} FROM scored GROUP BY recommended_action""")
def audit_partitioned_sink(t: Tables) -> DataFrame:
    """Two strategies' audit rows in one table; the filter reads one strategy's folder only."""
    path = _path(t, "audit")
    for strategy in ("Blind Retry", "Current Rule-Based Strategy"):
        writers.write_audit(A.audit_records(t.scored_table, strategy, "2024-02-01T00:00:00Z"), path,
                            mode="append")
    one = A.filter_audit(t.spark.read.parquet(path), strategy="Blind Retry")
    return one.groupBy("strategy_name", "recommended_action").agg(
        F.expr("count(1) records"), F.expr(money("sum(expected_recovery)", "expected_recovery")))
