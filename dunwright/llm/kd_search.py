"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt into shards by a hash of their id.  A task builds its shard's KD-tree (median splits on
the widest dimension, tight bounding boxes) and answers a block of queries: the largest inner product that
a box allows bounds what its subtree can hold, a query visits its leaves best bound first, and stops at
the first bound below its kth score.  A first round over one shard gives every query a kth score, which
the second round over all shards starts from; at the end the shards' lists are merged.  The result is
exact; where boxes do not prune, as with random directions in many dimensions, leaves are scanned by
matrix products.

Vectors that are null, or hold null or non-finite components, and rows without an id take no part.  Vectors
of different lengths are not compared.  Equal scores go to the smaller id, then rows repeat as they are in
the table; equal query rows are one query.  A query's own id is never its result.  Empty tables give
empty results.  Very many equal vectors form one leaf.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, written
from .registry import query

K = 20
LEAF = 128
SHARD_ROWS = 4096
LEAST_SHARD_ROWS = 256
QUERY_BLOCK = 2048  # queries that a task holds at once
_NONE = -(1 << 62)


class KdTree:
    """Leaves as ranges of reordered rows, and the boxes of all nodes, level by level."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # low, high, parent
        self.leaves: list[tuple[int, int, int, int]] = []  # level, node, first row, end
        nodes = [(0, len(points), 0)]
        while nodes:
            boxes, parents, below = [], [], []
            for i, (a, b, parent) in enumerate(nodes):
                own = points[self.order[a:b]]
                low, high = own.min(axis=0), own.max(axis=0)
                boxes.append((low, high))
                parents.append(parent)
                extent = high - low
                if b - a <= leaf or not extent.size or extent.max() == 0:
                    self.leaves.append((len(self.levels), i, a, b))
                    continue
                d, middle = int(extent.argmax()), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, d], middle)]
                below += [(a, a + middle, i), (a + middle, b, i)]
            self.levels.append((np.array([x for x, _ in boxes]), np.array([x for _, x in boxes]),
                                np.array(parents)))
            nodes = below
        self.points = points[self.order]

    def leaf_bounds(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Per query and leaf the largest possible product, -inf where some box above rules it out."""
        positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
        out = np.full((len(queries), len(self.leaves)), -np.inf)
        alive = np.ones((len(queries), 1), dtype=bool)
        bounds = []
        for low, high, parent in self.levels:
            bound = positive @ high.T + negative @ low.T
            alive = alive[:, parent] & (bound >= floor[:, None])
            bounds.append(np.where(alive, bound, -np.inf))
        for k, (level, node, _, _) in enumerate(self.leaves):
            out[:, k] = bounds[level][:, node]
        return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then by smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def search_shard(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
                 floor: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, ids and scores of its k best rows of a shard, without those below ``floor``."""
    exact = np.float64 if max(1.0, float(np.abs(points).max(initial=0))) * max(
        1.0, float(np.abs(queries).max(initial=0))) * max(1, points.shape[1]) < 2 ** 52 else np.int64
    tree = KdTree(points.astype(exact))
    sorted_ids, queries = ids[tree.order], queries.astype(exact)
    asked = queries.astype(np.float64)
    # what rounding may take from a bound: its terms are no larger than these products together
    margin = 1e-12 * (np.abs(asked) @ np.abs(points.astype(np.float64)).max(axis=0, initial=0)) + 1
    bound = tree.leaf_bounds(asked, floor.astype(np.float64) - margin)
    visit = np.argsort(-bound, axis=1, kind="stable")
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in queries]
    kth = floor.copy()
    active = np.arange(len(queries))
    for step in range(len(tree.leaves)):
        leaf = visit[active, step]
        ahead = bound[active, leaf]
        active = active[ahead + margin[active] >= kth[active].astype(np.float64)]
        if not len(active):
            break
        leaf = visit[active, step]
        for number in np.unique(leaf):
            asking = active[leaf == number]
            _, _, a, b = tree.leaves[number]
            scores = (queries[asking] @ tree.points[a:b].T).astype(np.int64)
            hits = (scores >= kth[asking][:, None]) & (sorted_ids[a:b][None, :] != query_ids[asking][:, None])
            for row in np.flatnonzero(hits.any(axis=1)).tolist():
                q, at = int(asking[row]), np.flatnonzero(hits[row])
                own = np.concatenate([found[q][0], sorted_ids[a + at]])
                score = np.concatenate([found[q][1], scores[row, at]])
                best = _best(score, own, k)
                found[q] = own[best], score[best]
                if len(best) == k:
                    kth[q] = max(kth[q], int(score[best[-1]]))
    return found


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64)
    return data.reshape(len(column), size)


def _answer(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        out: list[list] = [[], [], [], []]
        if len(left) and len(right):
            size = len(left.column("packed")[0].as_py()) // 8
            asked = right.column("query_id").to_numpy()
            keys = right.column("query").to_pylist()
            found = search_shard(left.column("vec_id").to_numpy(), _matrix(left.column("packed"), size),
                                 asked, _matrix(right.column("packed"), size),
                                 right.column("floor").to_numpy().copy(), k)
            for key, q, (ids, scores) in zip(keys, asked.tolist(), found):
                out[0] += [key] * len(ids)
                out[1] += [q] * len(ids)
                out[2] += ids.tolist()
                out[3] += scores.tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, out)})
    return run


def _pack(batches):
    for batch in batches:
        rows = [np.array(v, dtype=np.int64).tobytes() for v in batch.column("vector").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(rows, pa.binary())], ["vec_id", "packed"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(vec_id bigint, vector array<bigint>) and the same for queries: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = written(vectors.mapInArrow(_pack, "vec_id bigint, packed binary"), "vectors")
    asked = written(queries.mapInArrow(_pack, "vec_id bigint, packed binary").distinct().selectExpr(
        "vec_id query_id", "packed", "xxhash64(vec_id, packed) query"), "queries")
    n, q = rows.count(), asked.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // SHARD_ROWS), min(2 * parts, -(-n // LEAST_SHARD_ROWS)))
    blocks = max(1, -(-q // QUERY_BLOCK))
    dealt = rows.selectExpr("vec_id", "packed", f"cast(pmod(xxhash64(vec_id), {shards}) as int) shard",
                            "octet_length(packed) size")
    placed = asked.selectExpr("*", f"cast(pmod(query, {blocks}) as int) block", "octet_length(packed) size")
    result = "query bigint, query_id bigint, vec_id bigint, score bigint"
    keys = ["shard", "block", "size"]

    def answers(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        return candidates.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_answer(k), result)

    # first round: every block of queries asks one shard
    first = answers(
        dealt.selectExpr("*", f"explode(filter(sequence(0, {blocks - 1}), b -> b % {shards} = shard)) block"),
        placed.selectExpr("query", "query_id", "packed", "size", "block",
                          f"block % {shards} shard", f"cast({_NONE} as bigint) floor"))
    floors = first.groupBy("query").agg(F.expr(f"if(count(1) >= {k}, min(score), {_NONE}) floor"))
    placed = written(placed.join(floors, "query", "left").selectExpr(
        "query", "query_id", "packed", "size", "block", f"coalesce(floor, {_NONE}) floor"), "queries")
    found = answers(
        dealt.selectExpr("*", f"explode(sequence(0, {blocks - 1})) block"),
        placed.selectExpr("*", f"explode(sequence(0, {shards - 1})) shard"))
    return found.selectExpr("query_id", """cast(row_number() over (partition by query, query_id
        order by score desc, vec_id) as int) rank""", "vec_id", "score").filter(f"rank <= {k}")


def quantised(embeddings: DataFrame) -> DataFrame:
    """Whole rows as vectors of floor(64 x); rows that take no part are left out."""
    return (embeddings.filter("vec_id is not null and embedding is not null")
            .selectExpr("cast(vec_id as bigint) vec_id",
                        "transform(embedding, x -> cast(x as double)) _v")
            .filter("forall(_v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
            .selectExpr("vec_id", "transform(_v, x -> cast(floor(64 * x) as bigint)) vector"))


@query("op7_kd_search", sql="""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def op7_kd_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))
