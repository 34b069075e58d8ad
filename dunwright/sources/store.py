"""The five decision tables as Parquet folders, one sub-folder per stream and batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.scalars import text
from ..operators.store import conform, table_counts
from ..schemas import EVENT_STATUS_LOG, STORE_TABLES
from .key_index import KeyIndex

_SCHEMAS = {**STORE_TABLES, "event_status_log": EVENT_STATUS_LOG}
_COMMIT = StructType([StructField("done", LongType()), StructField("key_group", StringType())])
_PLACE = [StructField("stream", StringType()), StructField("batch_id", LongType())]


@dataclass(frozen=True)
class ParquetStore:
    """Tables under one folder on storage every executor can reach.

    A batch of a stream is written to ``table/stream=S/batch_id=N``; running it again
    replaces its own rows and no others.  A batch counts once its entry in ``commits`` is
    there, which is written last: readers join on it, so they see whole batches only.
    """

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def batch_path(self, table: str, stream: str, batch_id: int) -> str:
        return f"{self.path(table)}/stream={stream}/batch_id={batch_id}"

    def _raw(self, table: str, schema: StructType) -> DataFrame:
        """All written rows with their stream and batch; empty when nothing was written."""
        placed = StructType(schema.fields + _PLACE)
        try:
            return self.spark.read.schema(placed).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], placed)

    def read(self, table: str, other_than: tuple[str, int] | None = None,
             schema: StructType | None = None) -> DataFrame:
        """Rows of committed batches, without those of the batch ``other_than``."""
        rows = self._raw(table, schema or _SCHEMAS[table])
        commits = self.commits().select("stream", "batch_id").distinct()  # one row per batch
        rows = rows.join(commits, ["stream", "batch_id"], "left_semi")
        if other_than is not None:
            stream, batch_id = other_than
            rows = rows.filter(~((F.col("stream") == stream) & (F.col("batch_id") == batch_id)))
        return rows.drop("stream", "batch_id")

    def write_batch(self, table: str, rows: DataFrame, stream: str, batch_id: int) -> None:
        conform(rows, _SCHEMAS[table]).write.mode("overwrite").parquet(
            self.batch_path(table, stream, batch_id))

    @property
    def keys(self) -> KeyIndex:
        return KeyIndex(self.spark, self.path("key_index"))

    def commits(self) -> DataFrame:
        """Committed batches, with the group of the key index that holds their keys."""
        return self._raw("commits", _COMMIT)

    def known_keys(self, keys: DataFrame, own: tuple[str, int]) -> DataFrame:
        """Stored keys, without those of the batch ``own``; complete for the given ``keys`` (column ``key``)."""
        return self.keys.lookup(keys, self.commits(), own)

    def commit(self, stream: str, batch_id: int, keys: DataFrame | None = None) -> None:
        """Publish a batch and the keys (column ``key``) it added; nothing of it is read before."""
        group = None if keys is None else self.keys.add(keys, stream, batch_id)
        named = "cast(null as string)" if group is None else text(group)
        self.spark.range(1).selectExpr("id done", f"{named} key_group").write.mode("overwrite").parquet(
            self.batch_path("commits", stream, batch_id))
        if group is not None:
            self.keys.compact_if_due(self.commits())

    def counts(self) -> DataFrame:
        """Row counts of the five tables, zero for those never written."""
        tables = {t: self.read(t) for t in STORE_TABLES}
        return table_counts(tables)
