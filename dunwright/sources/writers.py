"""Sinks: Parquet, CSV, JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.scalars import join_factors


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index; arrays become ' | ' text, structs and maps JSON."""
    flat = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType):
            flat.append(join_factors(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, (StructType, MapType)):
            flat.append(F.to_json(f.name).alias(f.name))
        else:
            flat.append(F.col(f.name))
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def write_audit(audit: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Audit rows partitioned by strategy, so strategy filters prune folders."""
    write_parquet(audit, path, ["strategy_name"], mode)


def append_jdbc(df: DataFrame, url: str, table: str, partitions: int = 16,
                properties: dict[str, str] | None = None) -> None:
    """Append over at most ``partitions`` connections."""
    df.write.option("numPartitions", partitions).jdbc(url, table, "append", properties or {})
