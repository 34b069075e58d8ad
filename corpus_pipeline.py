"""The corpus pipeline: documents through quality, toxicity, near copies, mixing and segmentation.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of ``documents``.  Classifiers learn from the labelled rows among their input, bounded
as their modules say.  Documents without text pass the filters or not by their score; the join keeps one
row of each component; the mix repeats a document whose source is taken more than once, leaves out those
beyond their source's target, and keeps documents without words once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dunwright.llm import jaccard_join, mixing, quality_classifier, segmentation, toxicity
from dunwright.llm.common import written

_SCORE = "_stage_score"
WORD_TABLE = 2_000_000  # edges of solved words a task; small, as heaps have grown in the stages before


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the quality classifier rejects go."""
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score_quality(docs, model, _SCORE).filter(
        f"{_SCORE} >= {quality_classifier.THRESHOLD}").select(docs.columns)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the toxicity classifier rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model, _SCORE).filter(
        f"{_SCORE} < {toxicity.THRESHOLD}").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each component stays."""
    return jaccard_join.one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: sources are brought to their targets."""
    return mixing.repeat_taken(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: sampled segmentations of every document of the mix, as piece ids."""
    import public_tokenizers

    return segmentation.with_digests(segmentation.segment(
        docs, public_tokenizers.path(segmentation.MODEL), most_edges=WORD_TABLE))


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("near_copies", keep_one_of_near_copies),
          ("mixing", mix), ("segmentation", segment)]

ORACLE_SQL = None  # trained models and sampled segmentations; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
