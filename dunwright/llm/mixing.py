"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Sources, in code-point order with null last, weigh 5, 2, 1, repeating, and share a budget of 150 % of all
words; no source gives more than twice its own size, and what it cannot give is shared again by weight.
Within a source the documents are ordered by a digest of their id and text.  The order is cut into ranges
of the digest (even by construction, whatever a source's share), ranges are summed, prefix-summed per
source, and the budget is cut at the exact word; a budget above the source's size starts a second epoch.

Digests replace random numbers, so reruns and retried tasks agree.  Nulls: a null text has size 0, a null
source is a source of its own, a null id hashes as the empty string.  Repeated rows are documents like
others: rows equal in id and text take their words one after the other.  An empty table gives an empty
result; a source without words has target 0.  Extra columns are kept (``size source_size target taken``
are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5     # times all words
MOST = 2.0       # times a source's words
RANGE_ROWS = 1000  # documents per digest range, on average
SIZE = r"if(text is null, 0, regexp_count(text, '[^\\x20\\x09-\\x0D]+'))"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET,
                   most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source throughout.

    Sharing again until no source is above its bound ends where every source has the same multiple of
    its weight or its bound.  With sources in order of bound / weight, the multiple that is left for a
    source and its followers rises while sources reach their bounds and falls after, so it is the maximum.
    """
    order = "order by source is null, cast(source as binary)"
    pick = "element_at(array({}), cast((row_number() over ({}) - 1) % {} + 1 as int))".format(
        ", ".join(f"{w!r}D" for w in weights), order, len(weights))
    return (
        sizes.selectExpr("source", "source_size", f"{pick} w", f"source_size * {most!r}D cap",
                         f"sum(source_size) over () * {budget!r}D total")
        .selectExpr("*", """coalesce(sum(cap) over (order by cap / w, cast(source as binary)
            rows between unbounded preceding and 1 preceding), 0D) full_before""", """
            sum(w) over (order by cap / w, cast(source as binary)
            rows between current row and unbounded following) w_left""")
        .selectExpr("*", "(total - full_before) / w_left level")
        .selectExpr("*", "max(level) over () final")
        .selectExpr("source", "source_size", "least(cap, w * final) target"))


def _mixed(docs: DataFrame, keep: list[str], seed: str, id_col: str) -> DataFrame:
    """The struct ``kept`` with _size, _source_size, _target and _taken; only they and the key are shuffled."""
    kept = f"struct({', '.join(f'`{c}`' for c in keep)}) kept"  # one struct, so its names clash with nothing
    digest = f"""sha2(concat_ws('\n', '{seed}', cast({id_col} as string), text), 256)"""
    width = 281474976710656 // (1 + docs.count() // RANGE_ROWS)  # of 48 bits
    sized = docs.selectExpr(kept, f"cast({SIZE} as bigint) _size", f"{digest} _digest",
                            "struct(source) _source").selectExpr(
        "*", f"cast(conv(left(_digest, 12), 16, 10) as bigint) div {width} _range")
    ranges = sized.groupBy("_source", "_range").agg(F.expr("sum(_size) _words"))
    sources = source_targets(ranges.groupBy("_source").agg(F.expr("sum(_words) source_size"))
                             .selectExpr("_source.source source", "source_size"))
    placed = ranges.selectExpr("_source", "_range", """coalesce(sum(_words) over (partition by _source
        order by _range rows between unbounded preceding and 1 preceding), 0) _offset""")
    placed = placed.join(sources.selectExpr(
        "struct(source) _source", "source_size _source_size", "target _target"), "_source")
    taken = " + ".join(
        f"greatest(0, least(_size, cast(round(_target) as bigint) - {epoch} * _source_size - _upto + _size))"
        for epoch in range(int(MOST)))
    return (
        sized.join(placed, ["_source", "_range"])
        .selectExpr("*", """_offset + sum(_size) over (partition by _source, _range order by _digest
            rows between unbounded preceding and current row) _upto""")
        .selectExpr("kept", "_size", "_source_size", "_target", f"cast({taken} as bigint) _taken"))


def mix_sources(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id",
                keep: list[str] | None = None) -> DataFrame:
    """Rows with size, source_size, target (of the source) and taken (words, repeats counted).

    ``keep`` names the columns that travel through the shuffle; by default all but the four.
    """
    names = ("size", "source_size", "target", "taken")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    return _mixed(docs, keep, seed, id_col).selectExpr("kept.*", *[f"_{n} {n}" for n in names])


def repeat_taken(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every document once per epoch that reaches it, with the columns of ``docs``.

    A document that the budget cuts is kept whole, so a source may give a part of one document more.
    Documents without words cost nothing and stay once.
    """
    return _mixed(docs, docs.columns, seed, id_col).filter("_taken > 0 or _size = 0").selectExpr(
        "kept", "explode(array_repeat(0, if(_size = 0, 1, cast(ceil(_taken / _size) as int)))) copy").select("kept.*")


@query("op10_mixing", sql=r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    sha256(concat_ws(chr(10), 'mix', doc_id::VARCHAR, text)) AS digest FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source
), totals AS (SELECT sum(source_size) * 1.5::DOUBLE AS total FROM sources
), steps AS (
  SELECT s.*, 2.0::DOUBLE * source_size AS cap,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source::BLOB
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source::BLOB
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM sources s
), levels AS (
  SELECT *, (total - full_before) / w_left AS level FROM steps, totals
), targets AS (
  SELECT source, source_size, least(cap, w * (SELECT max(level) FROM levels)) AS target FROM levels
), placed AS (
  SELECT z.doc_id, z.size, t.source_size, t.target, sum(z.size) OVER (PARTITION BY z.source
    ORDER BY z.digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, round(target)::BIGINT - upto + size))
   + greatest(0, least(size, round(target)::BIGINT - source_size - upto + size)))::BIGINT AS taken
FROM placed""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs, keep=["doc_id"])
