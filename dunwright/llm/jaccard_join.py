"""N-gram Jaccard join by token-combination prefixes, and the components of its links.

Every text is the set of hashes of its distinct five-word shingles.  Two texts link when their sets'
intersection is at least 80 % of their union.  The join is exact (up to collisions of 64-bit hashes):

1. Equal sets are one class; only one row per class goes on, so copies are never paired.
2. ``_sharing`` (first use): of each set only the hash-smallest part is looked at, a bit more than a set may
   lack of a linked one.  A linked set must share ``least_shared`` of these with other classes; sets that do
   not are done.  This drops texts that have but a passage in common with others.
3. ``_sharing`` (second use): all shingles of the sets left.  Those that no other class has are dropped; a
   set that keeps less than 80 % is done.  A shingle of more than ``FREQUENT`` classes is frequent.
4. Prefixes: rare shingles first.  A rare one is a signature alone; frequent ones are dealt into groups by
   their hash, and the pairs inside a group are signatures.  A set without a common signature would lack at
   least one rare shingle each and all but one of every group, so a prefix is extended until that is more
   than a linked set may lack.  Linked sets then share a signature.  The number of groups depends on the
   size class of the larger set, so sets sign for every size class that a linked set may be in.
5. Classes with a common signature are verified on their sets.  A large group of near copies would make
   a square of pairs, so classes first meet the most central one of their signature, and components are
   built.  Signatures whose classes are still in different components are pooled by the component that most
   of them have; the classes outside of it are the queries, all classes of the pool the rows that they are
   counted against, block by block of bounded size.  Only links leave a block.

Shingles travel as packed arrays in hash ranges of bounded size.  A shingle that very many texts of one map
task have is sent once as a witness, and its occurrences go straight on, so no hot shingle meets in a task.

Null and empty texts have the empty set: ``n_shingles`` 0, a component of their own.  Repeated rows and
equal texts are one class.  Ids may repeat; a null id never names a component, and its row gets the one of
its component (null if no row of it has an id).  Texts of any length are read whole; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import chunks, small_batches, written
from .components import components
from .hashing import Spans, mix
from .registry import query

WORDS = 5
FREQUENT = 16            # classes beyond which a shingle is frequent
HOT = 16                 # classes of one flush beyond which only a witness is counted
FLUSH = 1_000_000        # shingles that a map task holds
RANGE_TOKENS = 1_000_000  # shingles per hash range, on average
BLOCK_TOKENS = 500_000   # shingles of a block
BROADCAST_ROWS = 1_000_000  # most rows (16 bytes each) that are broadcast, checked by a count
_U = np.uint64


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        out += Spans(texts[lo:hi]).shingles(WORDS)
    return out


def set_class(shingles: np.ndarray) -> int:
    """One 64-bit digest per set, never 0."""
    total = mix(np.array([shingles.sum(dtype=_U) + _U(len(shingles))]))[0]
    return int(total.astype(np.int64)) or 1


def most_lacking(n: int) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - (4 * n + 4) // 5


def _extension(n: int) -> int:
    return 1 + 6 * n // 100


def looked_at(n: int) -> int:
    """Hash-smallest shingles that the first use looks at."""
    return min(n, most_lacking(n) + _extension(n))


def least_shared(n: int) -> int:
    """How many of these a linked set has among its own, however large it is."""
    return _extension((4 * n + 4) // 5)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def set_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, class); class is null for the empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(_texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_class(s) if len(s) else None for s in sets], pa.int64())],
                ["doc_id", "n_shingles", "class"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint")


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal values, and per row the number of its run."""
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _by_token(token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by token and class, without repeats."""
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    return token[new], cls[new]


_PACKED = "range int, passed boolean, token binary, class binary"


def _packed(bits: int, part: Callable[[int], int] | None):
    """Map side: packed (range, shingles, classes); with ``part``, 32 bits of a shingle beside its range."""
    def flush(tokens: list[np.ndarray], classes: list[np.ndarray]) -> pa.RecordBatch:
        token, cls = _by_token(np.concatenate(tokens), np.concatenate(classes))
        start, run = _runs(token)
        size = np.diff(np.append(start, len(token)))
        hot = size[run] > HOT
        witness = start[size > HOT]
        sent = np.concatenate([token[~hot], token[witness]])
        owner = np.concatenate([cls[~hot], np.zeros(len(witness), dtype=np.int64)])
        rows: list[tuple] = []
        for passed, t, c, key in ((False, sent, owner, sent),
                                  (True, token[hot], cls[hot], mix(cls[hot].astype(_U)))):
            where = (key >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            t, c, where = t[order], c[order], where[order]
            if part is not None:
                t = (t >> _U(32 - bits)).astype(np.uint32)
            first, _ = _runs(where)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(where)]):
                rows.append((int(where[a]), passed, t[a:b].tobytes(), c[a:b].tobytes()))
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()),
             pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
            ["range", "passed", "token", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes, held = [], [], 0
        for batch in batches:
            for s in shingle_sets(_texts(batch)):
                if not len(s):
                    continue
                taken = s if part is None else s[:part(len(s))]
                tokens.append(taken)
                classes.append(np.full(len(taken), set_class(s), dtype=np.int64))
                held += len(taken)
                if held >= FLUSH:
                    yield flush(tokens, classes)
                    tokens, classes, held = [], [], 0
        if held:
            yield flush(tokens, classes)

    return run


def _shared(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduce side of one range: (shingle, class, frequent) of shingles that two classes or more have."""
    def joined(column: str, rows: pa.Table, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype=dtype)

    passed = table.column("passed")
    counted = table.filter(pa.compute.invert(passed))
    token, cls = _by_token(joined("token", counted, kind), joined("class", counted, np.int64))
    start, run = _runs(token)
    witness = np.add.reduceat((cls == 0).astype(np.int64), start) if len(start) else start
    size = np.diff(np.append(start, len(token))) - witness
    keep = (cls != 0) & ((size >= 2) | (witness > 0))[run]
    often = ((size > FREQUENT) | (witness > 0))[run]
    direct = table.filter(passed)
    more_token, more_cls = joined("token", direct, kind), joined("class", direct, np.int64)
    return (np.concatenate([token[keep], more_token]), np.concatenate([cls[keep], more_cls]),
            np.concatenate([often[keep], np.ones(len(more_token), dtype=bool)]))


def _bits(spark: SparkSession, tokens: int) -> int:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(31, max(1, (max(4 * parts, tokens // RANGE_TOKENS) - 1).bit_length()))


def _count_shared(docs: DataFrame, tokens: int) -> DataFrame:
    """(class, shared): how many of the looked-at shingles other classes have (never too few)."""
    bits = _bits(docs.sparkSession, tokens)

    def reduce(table: pa.Table) -> pa.Table:
        _, cls, _ = _shared(table, np.uint32)
        values, counts = np.unique(cls, return_counts=True)
        return pa.table({"class": pa.array(values, pa.int64()), "shared": pa.array(counts, pa.int64())})

    return (docs.select("text").mapInArrow(_packed(bits, looked_at), _PACKED)
            .groupBy("range").applyInArrow(reduce, "class bigint, shared bigint")
            .groupBy("class").agg(F.expr("sum(shared) shared")))


def _shared_tokens(docs: DataFrame, tokens: int) -> DataFrame:
    """(class, rare, often): all shingles that other classes have, as arrays."""
    bits = _bits(docs.sparkSession, tokens)

    def reduce(table: pa.Table) -> pa.Table:
        token, cls, often = _shared(table, np.uint64)
        order = np.lexsort((token, often, cls))
        token, cls, often = token[order].astype(np.int64), cls[order], often[order]
        start, _ = _runs(cls)
        ends = [*start[1:].tolist(), len(cls)]
        rows = [(int(cls[a]), token[a:b][~often[a:b]].tobytes(), token[a:b][often[a:b]].tobytes())
                for a, b in zip(start.tolist(), ends)]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table({"class": pa.array(columns[0], pa.int64()),
                         "rare": pa.array(columns[1], pa.binary()),
                         "often": pa.array(columns[2], pa.binary())})

    return (docs.select("text").mapInArrow(_packed(bits, None), _PACKED)
            .groupBy("range").applyInArrow(reduce, "class bigint, rare binary, often binary")
            .groupBy("class").agg(F.expr("collect_list(rare) rare"), F.expr("collect_list(often) often")))


def _unpacked(parts: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(parts), dtype=np.uint64))


def size_classes(n: int) -> list[int]:
    """Size classes (powers of two) of the larger one of two linked sets, for one of size n."""
    return list(range(n.bit_length() - 1, (5 * n // 4).bit_length()))


def signatures(n: int, rare: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Signatures of a set of n shingles; ``rare`` and ``often`` are sorted, what no one else has is left out."""
    need = len(rare) + len(often) - (n - most_lacking(n)) + 1  # what an unlinked set must lack
    if need <= 0:
        return np.zeros(0, dtype=_U)
    out = [mix(rare[:need] + _U(1))]
    need -= len(rare)
    if need > 0:
        for k in size_classes(n):
            groups = (1 << k) // 8
            if groups == 0:
                out.append(mix(often[:need] + _U(2)))
                continue
            group = (mix(often + _U(3)) % _U(groups)).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            counts = np.ones(len(often), dtype=np.int64)
            counts[first] = 0
            end = int(np.searchsorted(np.cumsum(counts), need)) + 1
            token, group = often[:end], group[:end]
            order = np.lexsort((token, group))
            token, group = token[order], group[order]
            for step in range(1, len(token)):
                same = np.flatnonzero(group[step:] == group[:-step])
                if not len(same):
                    break
                out.append(mix(token[same] * _U(2 * k + 5) + mix(token[same + step])))
    return np.unique(np.concatenate(out))


def _signed(sets: DataFrame) -> DataFrame:
    """(class, n, rare, often) to (signature, class, n, kept, weight): kept counts the shingles that others
    have, weight is the share of frequent ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, n, rare, often in zip(*(batch.column(c).to_pylist()
                                             for c in ("class", "n", "rare", "often"))):
                rare, often = (np.array(x, dtype=np.int64).view(np.uint64) for x in (rare, often))
                found = signatures(n, np.sort(rare), np.sort(often)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), cls), pa.int64()),
                     pa.array(np.full(len(found), n), pa.int64()),
                     pa.array(np.full(len(found), len(rare) + len(often)), pa.int64()),
                     pa.array(np.full(len(found), len(often) / n), pa.float32())],
                    ["signature", "class", "n", "kept", "weight"])

    return sets.mapInArrow(run, "signature bigint, class bigint, n bigint, kept bigint, weight float")


def _unpack_sets(grouped: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cls, n, rare, often in zip(*(batch.column(c).to_pylist()
                                             for c in ("class", "n", "rare", "often"))):
                often = _unpacked(often)
                rare = np.setdiff1d(_unpacked(rare), often)
                if len(rare) + len(often) >= n - most_lacking(n):
                    rows.append((cls, n, rare.view(np.int64), often.view(np.int64)))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64()))],
                ["class", "n", "rare", "often"])

    return grouped.mapInArrow(run, "class bigint, n bigint, rare array<bigint>, often array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    whole = sets.selectExpr("class", "n", "concat(rare, often) tokens")
    left = whole.selectExpr("class a", "n n_a", "tokens tokens_a")
    right = whole.selectExpr("class b", "n n_b", "tokens tokens_b")
    return (pairs.join(right, "b").join(left, "a")
            .selectExpr("a", "b", "n_a + n_b both", "size(array_intersect(tokens_a, tokens_b)) common")
            .filter("100 * common >= 80 * (both - common)").select("a", "b"))


# 100 i >= 80 (n_a + n_b - i) for the intersection i, which no more than the kept shingles can be in
_CAN_LINK = "9 * least(kept_a, kept_b) >= 4 * (n_a + n_b)"


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links (a, b) between the queries and the rows of a block."""
    out_a, out_b = [], []
    if len(left) and len(right):
        rows = [np.array(t, dtype=np.int64) for t in right.column("tokens").to_pylist()]
        sizes = right.column("n").to_numpy()
        classes, labels = right.column("class").to_numpy(), right.column("label").to_numpy()
        flat = np.concatenate(rows)
        start = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        known, flat = np.unique(flat, return_inverse=True)
        present = np.zeros(len(known), dtype=np.int64)
        for cls, n, label, tokens in zip(*(left.column(c).to_pylist()
                                           for c in ("class", "n", "label", "tokens"))):
            tokens = np.array(tokens, dtype=np.int64)
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            at = at[known[at] == tokens]
            present[at] = 1
            common = np.add.reduceat(present[flat], start)
            present[at] = 0
            hit = np.flatnonzero((labels != label) & (100 * common >= 80 * (n + sizes - common)))
            out_a += [cls] * len(hit)
            out_b += classes[hit].tolist()
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _pool_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the classes of each pool that are in different components.

    ``placed`` has main (the pool), class and label, one row per pool and class.
    """
    tokens = sets.selectExpr("class", "n", "concat(rare, often) tokens")
    rows = placed.join(tokens, "class").selectExpr("main", "class", "label", "n", "tokens",
                                                   "size(tokens) held", "label <> main asks")
    rows = written(rows, "pools")
    pools = rows.groupBy("main").agg(
        F.expr(f"cast(1 + sum(held) div {BLOCK_TOKENS} as int) row_blocks"),
        F.expr(f"cast(1 + sum(if(asks, held, 0)) div {BLOCK_TOKENS} as int) query_blocks"))
    rows = rows.join(pools, "main")
    own = "cast(pmod(xxhash64(class), {}) as int)"
    queries = rows.filter("asks").selectExpr(  # new names for the same columns keep the two sides apart
        "main main", "class class", "label label", "n n", "tokens tokens", f"{own.format('query_blocks')} i",
        "explode(sequence(0, row_blocks - 1)) j")
    against = rows.selectExpr(
        "main", "class", "label", "n", "tokens", f"{own.format('row_blocks')} j",
        "explode(sequence(0, query_blocks - 1)) i")
    keys = ["main", "i", "j"]
    return queries.groupBy(*keys).cogroup(against.groupBy(*keys)).applyInArrow(
        _block_links, "a bigint, b bigint")


def class_links(docs: DataFrame, sizes: DataFrame) -> DataFrame | None:
    """Links (a, b) between classes that join all that belong together; None when there are none.

    ``sizes`` is ``set_sizes(docs)``, written.
    """
    classes = sizes.filter("class is not null").groupBy("class").agg(
        F.expr("min(doc_id) first_id"), F.expr("max(n_shingles) n"))
    total = sizes.agg(F.expr("sum(n_shingles) n")).first()["n"] or 0
    counted = _count_shared(docs, total // 4)
    need = "1 + 6 * ((4 * n + 4) div 5) div 100"  # least_shared(n)
    left = written(classes.join(counted, "class").filter(f"shared >= {need}").select("class", "first_id", "n"),
                   "sharing")
    rows, tokens = left.agg(F.expr("count(1) c"), F.expr("sum(n) n")).first()
    if not rows:
        return None
    ids = left.filter("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct()
    if rows <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    some = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    if not left.filter("first_id is null").isEmpty():  # sets that only rows without an id have
        some = some.unionByName(docs.select("doc_id", "text").filter("doc_id is null"))
    grouped = _shared_tokens(some, tokens).join(left.select("class", "n"), "class")
    sets = written(_unpack_sets(grouped), "sets")
    signed = written(_signed(sets), "signatures")
    buckets = signed.groupBy("signature").agg(
        F.expr("count(1) size"), F.expr("max(struct(weight, class, n, kept)) best")).filter("size > 1") \
        .selectExpr("signature", "best.class a", "best.n n_a", "best.kept kept_a")
    star = (signed.selectExpr("signature", "class b", "n n_b", "kept kept_b").join(buckets, "signature")
            .filter(f"a <> b and {_CAN_LINK}").select("a", "b").distinct())
    links = written(_verified(star, sets), "links")
    labels = components(links)
    # what is still apart: signatures with several components, pooled by the most frequent one
    placed = signed.join(labels.selectExpr("node class", "label"), "class", "left").selectExpr(
        "signature", "class", "coalesce(label, class) label")
    mixed = placed.groupBy("signature", "label").agg(F.expr("count(1) size")).groupBy("signature").agg(
        F.expr("count(1) labels"), F.expr("max(struct(size, label)).label main")).filter("labels > 1")
    pooled = placed.join(mixed.select("signature", "main"), "signature").select(
        "main", "class", "label").distinct()
    return links.union(_pool_links(pooled, sets))


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row per document: doc_id, n_shingles, component_id, class, component.

    ``component`` is a class of the component; unlike ids, which may repeat, it tells components apart.
    """
    small_batches(docs.sparkSession)
    sizes = written(set_sizes(docs), "set-sizes")
    classes = sizes.filter("class is not null").groupBy("class").agg(F.expr("min(doc_id) first_id")) \
        .selectExpr("class", "first_id", "class component")
    links = class_links(docs, sizes)
    if links is not None:
        labels = components(links)
        named = classes.join(labels.selectExpr("node class", "label"), "class", "left") \
            .selectExpr("class", "first_id", "coalesce(label, class) label")
        smallest = named.groupBy("label").agg(F.expr("min(first_id) smallest"))
        classes = named.join(smallest, "label").selectExpr("class", "smallest first_id", "label component")
    return sizes.join(classes, "class", "left").selectExpr(
        "doc_id", "n_shingles", "if(class is null, doc_id, first_id) component_id", "class", "component")


def _with_class(docs: DataFrame) -> DataFrame:
    """Append _class, the digest of the text's set, null for the empty set."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_class", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_class(s) if len(s) else None for s in shingle_sets(_texts(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def one_per_component(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per component: of the rows with the smallest id, that of the smallest class and text.

    Rows without words are components of their own by id; those without an id too all stay.  Ids that occur
    once select their rows; texts of null and repeated ids are told apart by the digests of their sets.
    """
    found = written(near_components(docs), "near")
    heads = found.filter("doc_id <=> component_id")
    chosen = heads.filter("class is not null").groupBy("component").agg(
        F.expr("min(struct(class, doc_id)) head")).selectExpr("head.doc_id", "head.class").unionByName(
        heads.filter("class is null").select("doc_id", "class").distinct())
    repeated = written(found.groupBy("doc_id").agg(F.expr("count(1) copies"))
                       .filter("copies > 1 or doc_id is null").select("doc_id"), "repeated")
    odd = not repeated.isEmpty()
    kept = chosen.select("doc_id").filter("doc_id is not null")
    kept = written(kept.join(repeated, "doc_id", "left_anti") if odd else kept, "kept")
    chosen_docs = docs.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, "doc_id", "left_semi")
    if not odd:
        return chosen_docs
    several = _with_class(docs.join(repeated, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null")))
    nameless = several.filter("doc_id is null and _class is null").select(docs.columns)
    first = several.filter("doc_id is not null or _class is not null").groupBy(
        F.col("doc_id").alias("_id"), "_class").agg(F.expr(
            f"min_by(struct({', '.join(f'`{c}`' for c in docs.columns)}), coalesce(text, '')) _row"))
    wanted = chosen.selectExpr("doc_id _head", "class _head_class")
    first = first.join(wanted, F.expr("_id <=> _head and _class <=> _head_class"), "left_semi").select("_row.*")
    return chosen_docs.unionByName(first).unionByName(nameless)


@query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return near_components(docs).select("doc_id", "n_shingles", "component_id")
