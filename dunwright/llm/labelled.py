"""Bounded samples of labelled documents, turned into features by tasks and fitted on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import small_batches


def held_out(modulus: int, remainder: int) -> str:
    """SQL: the rows whose labels no fit may see."""
    return f"crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {remainder}"


def sample_features(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], rows: int,
                    features: Callable[[list[bytes]], list[tuple[bytes, bytes]]]) -> list[tuple]:
    """(label, features, more features) of at most ``rows`` labelled documents in a fixed random order.

    ``rows`` is the documented bound on what a fit reads.  Labels that are null, and labelled ids without
    a document, take no part; repeated labels count once, and of the documents with one id that with the
    smallest digest of its features.  Only features go to the driver, at most one row for each of the
    ``rows``; a row is no larger than the features' space.
    """
    small_batches(docs.sparkSession)
    chosen = (labels.selectExpr("doc_id", f"cast({label} as int) label")
              .filter(f"doc_id is not null and label in (0, 1) and not ({held_out(*fold)})")
              .dropDuplicates().selectExpr("*", "xxhash64(doc_id) _place")
              .orderBy("_place", "doc_id", "label").limit(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            found = features(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_place"), batch.column("doc_id"), batch.column("label"),
                 pa.array([a for a, _ in found], pa.binary()),
                 pa.array([b for _, b in found], pa.binary())],
                ["_place", "doc_id", "label", "own", "more"])

    found = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
             .select("_place", "doc_id", "label", "text")
             .mapInArrow(run, "_place bigint, doc_id bigint, label int, own binary, more binary")
             .groupBy("_place", "doc_id", "label").agg(
                 F.expr("min_by(struct(own, more), sha2(own, 256)) found"))
             .select("_place", "doc_id", "label", "found.own", "found.more"))
    rows_found = {}
    collected = found.collect()  # at most ``rows`` rows
    while collected:  # rows are let go as they are taken over
        r = collected.pop()
        rows_found[r["_place"], r["doc_id"], r["label"]] = (r["label"], bytes(r["own"]), bytes(r["more"]))
    return [rows_found[k] for k in sorted(rows_found)]


def scored(docs: DataFrame, score: Callable[[list[bytes]], list[float]],
           name: str = "score") -> DataFrame:
    """Append the score to every row of ``docs`` (column text), whole texts, null read as empty."""
    small_batches(docs.sparkSession)
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score(texts), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
