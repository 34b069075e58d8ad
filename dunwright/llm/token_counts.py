"""Token counts through a digest cache.

Every text's digest and the tokenizer's digest together are the key of a stored count.  Texts that the
cache lacks are reduced to one per digest, only those are encoded, and their counts are appended to the
cache (a Parquet folder that driver and executors share).  A rerun encodes nothing but new texts.

Nulls and empty texts have 0 bytes and 0 tokens.  Texts of any length are encoded whole.  Repeated rows and
equal texts share one cache entry, a hot digest is reduced inside each map task before it is shuffled.
Extra columns are kept (``n_bytes n_tokens over_limit`` are replaced); empty tables give empty results.
An append that fails half-way leaves rows of finished tasks only where the file committer says so; entries
that two runs append twice are equal, and readers take one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, fresh_folder, small_batches
from .registry import query

LIMIT = 4096
TOKENIZER = "piece_bpe_32k.model"
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(path: str):
    """Counts of a list of texts as the file's own library gives them, added tokens left out."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in
                              tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [t.encode() for t in texts]
            counts: list[int] = []
            for lo, hi in chunks(sizes, 1 << 18):
                counts += count(texts[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])
    return run


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer; an unwritten cache is empty."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    return (spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
            .groupBy("digest").agg(F.expr("max(n_tokens) n_tokens")))


def fill_cache(texts: DataFrame, tokenizer: str, cache: str) -> str:
    """Encode the distinct texts (column text) that the cache lacks and append their counts."""
    spark, version = texts.sparkSession, tokenizer_digest(tokenizer)
    small_batches(spark)
    distinct = (texts.filter("text is not null and text <> ''")
                .selectExpr("unhex(sha2(text, 256)) digest", "text")
                .groupBy("digest").agg(F.expr("first(text) text")))
    misses = distinct.join(cached_counts(spark, cache, version), "digest", "left_anti")
    counted = misses.mapInArrow(_count_batches(tokenizer), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens") \
        .write.mode("append").parquet(cache)
    return version


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit to every row of ``docs`` (column text)."""
    version = fill_cache(docs.select("text"), tokenizer, cache)
    counts = cached_counts(docs.sparkSession, cache, version).withColumnRenamed("n_tokens", "_tokens")
    kept = [f"`{c}`" for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return (  # the rows travel as one struct, so their names clash with nothing
        docs.selectExpr(f"struct({', '.join(kept)}) kept", "coalesce(octet_length(text), 0) bytes",
                        "case when text <> '' then unhex(sha2(text, 256)) end own_digest")
        .join(counts, F.expr("own_digest = digest"), "left")
        .selectExpr("kept.*", "cast(bytes as bigint) n_bytes", "coalesce(_tokens, 0) n_tokens",
                    f"coalesce(_tokens, 0) > {limit} over_limit"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path(TOKENIZER)
    cache = fresh_folder(spark, "token-cache")
    version = fill_cache(docs, path, cache)
    counts = cached_counts(spark, cache, version)
    return (
        docs.selectExpr("doc_id", "coalesce(octet_length(text), 0) _bytes",
                        "case when text <> '' then unhex(sha2(text, 256)) end _digest")
        .join(counts, F.expr("_digest = digest"), "left")
        .selectExpr("doc_id", "cast(_bytes as bigint) n_bytes", "coalesce(n_tokens, 0) n_tokens",
                    f"coalesce(n_tokens, 0) > {LIMIT} over_limit"))
