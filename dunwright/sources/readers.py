"""Scans with declared schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.history import payments_from_events
from ..schemas import FAILED_PAYMENTS


def read_payments_csv(spark: SparkSession, path: str, schema=FAILED_PAYMENTS) -> DataFrame:
    """Payments from CSV with a header; pass ``schemas.SCORED_PAYMENTS`` for scored files."""
    return spark.read.schema(schema).option("header", True).option(
        "enforceSchema", False).csv(path)


def read_payments(spark: SparkSession, path: str, schema=FAILED_PAYMENTS) -> DataFrame:
    """Payments from Parquet; column pruning and filters reach the scan."""
    return spark.read.schema(schema).parquet(path)


def read_event_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event per line, as text in ``value`` (see ``decide.parse_events``)."""
    return spark.read.text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 32,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A relational table; with a numeric column and bounds it is read in parallel slices."""
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties or {})
    low, high = bounds
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=low, upperBound=high,
                           numPartitions=partitions, properties=properties or {})


def payments_from_event_table(spark: SparkSession, folder: str) -> DataFrame:
    """Failed payments derived from ``events.parquet`` in a data folder."""
    return payments_from_events(spark.read.parquet(f"{folder}/events.parquet"))


def to_json_events(payments: DataFrame, payload: list[str]) -> DataFrame:
    """Rows as JSON text in ``value``, the inverse of parsing."""
    return payments.select(F.to_json(F.struct(*payload)).alias("value"))
