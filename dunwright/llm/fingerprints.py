"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame functions only.

A document's set holds the hashes of its distinct five-word shingles (the whole word sequence when it has
fewer words).  The fingerprint retains every hash below a fixed fraction of the hash range, and in any
case the ``AT_LEAST`` smallest, and states below which hash it is complete (its bound).  The union of two
fingerprints cut at the smaller bound is the fingerprint of the union of the sets, so sketches merge; the
share of common hashes below the smaller bound estimates the Jaccard likeness, and the share of the
smaller one's hashes its containment, however unequal the documents are.

Nulls and texts without words have the empty fingerprint; two empty ones are alike (1), an empty and
another are not (0).  Texts of any length are read whole.  Rows may repeat and ids may tie: equal ids
follow each other in the order of their texts, null ids come first.  Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name
from .registry import query

FRACTION = 8     # one hash in so many is retained
AT_LEAST = 64     # smallest hashes that are retained anyway
TOP = 1 << 62     # hashes are 0 to TOP - 1
WORDS = 5
BUCKETS = 100_000  # most id ranges; their edges travel as literals of a plan
RANGES_PER_PARTITION = 8


def shingle_hashes(text: str) -> str:
    """SQL: sorted distinct hashes of a text's shingles."""
    words = (f"filter(split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             r"'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    return f"""transform(array({words}), w -> array_sort(array_distinct(
        if(size(w) = 0, cast(array() as array<bigint>),
        transform(sequence(1, greatest(1, size(w) - {WORDS - 1})),
            i -> shiftrightunsigned(xxhash64(slice(w, i, {WORDS})), 2))))))[0]"""


def sketch(hashes: str) -> str:
    """SQL: struct(bound, kept) of a sorted array of hashes."""
    least = TOP // FRACTION
    bound = f"""case when size({hashes}) <= {AT_LEAST} then {TOP}
        else greatest({least}, {hashes}[{AT_LEAST} - 1] + 1) end"""
    return f"""named_struct('bound', {bound}, 'kept', case when size({hashes}) <= {AT_LEAST} then {hashes}
        else filter({hashes}, (h, i) -> i < {AT_LEAST} or h < {least}) end)"""


def likeness(a: str, b: str) -> str:
    """SQL: Jaccard estimate from two sketches (not null)."""
    cut = f"least({a}.bound, {b}.bound)"
    left = f"filter({a}.kept, h -> h < {cut})"
    right = f"filter({b}.kept, h -> h < {cut})"
    common = f"size(array_intersect({left}, {right}))"
    return f"""case when size({a}.kept) = 0 and size({b}.kept) = 0 then 1D
        when size({a}.kept) = 0 or size({b}.kept) = 0 then 0D
        else {common} / cast(size({left}) + size({right}) - {common} as double) end"""


def containment(a: str, b: str) -> str:
    """SQL: estimated share of a's set that b's set holds; null where no hash of a is below the cut."""
    cut = f"least({a}.bound, {b}.bound)"
    left = f"filter({a}.kept, h -> h < {cut})"
    return f"""case when size({a}.kept) = 0 then 1D
        else try_divide(size(array_intersect({left}, {b}.kept)), cast(size({left}) as double)) end"""


def as_text(s: str) -> str:
    """SQL: the fingerprint as text: bound and hashes in hex."""
    return f"concat_ws('-', hex({s}.bound), concat_ws('.', transform({s}.kept, h -> hex(h))))"


def with_fingerprint(docs: DataFrame, name: str = "sketch", text: str = "text") -> DataFrame:
    """Append the sketch of a text column; a column called ``name`` is replaced."""
    hashes, made = free_name(docs, "_hashes"), free_name(docs, "_sketch")
    kept = [f"`{c}`" for c in docs.columns if c.lower() != name.lower()]
    return docs.selectExpr("*", f"{shingle_hashes(f'coalesce(`{text}`, {chr(39)*2})')} {hashes}") \
        .selectExpr(*kept, f"{sketch(hashes)} {made}").withColumnRenamed(made, name)


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Append ``next_<c>``, the named columns of the row that follows by id; the last gets the first.

    Columns that are already called so are replaced.

    Ids are cut into even ranges, and the first rows of every range are sent to the range before as well,
    so each range finds its followers alone: one shuffle, no global window.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(BUCKETS, max(1, parts * RANGES_PER_PARTITION))
    fractions = ", ".join(f"{i / n!r}D" for i in range(n + 1))
    found = docs.agg(F.expr(f"percentile_approx({id_col}, array({fractions}), {n * 20}) edges"),
                     F.expr(f"min({id_col}) first"),
                     F.expr(f"count_if({id_col} is null) > 0 nulls")).first()
    edges = sorted({e for e in (found["edges"] or []) if e > found["first"]})
    side = max(1, int(len(edges) ** 0.5))
    coarse = ", ".join(f"{e}L" for e in edges[::side])
    groups = ", ".join("array({})".format(", ".join(f"{e}L" for e in edges[i:i + side]))
                       for i in range(0, len(edges), side))
    if edges:  # the range of an id: number of edges up to it, found in two steps
        step = f"size(filter(array({coarse}), e -> e <= {id_col}))"
        place = f"""if({id_col} is null, 0, if({step} = 0, 0, ({step} - 1) * {side}
            + size(filter(element_at(array({groups}), {step}), e -> e <= {id_col}))))"""
        is_edge = f"""({step} > 0 and array_contains(element_at(array({groups}), greatest(1, {step})),
            {id_col}))"""
    else:
        place, is_edge = "0", "false"
    head = f"{id_col} is null" if found["nulls"] else f"{id_col} <=> " + (
        "null" if found["first"] is None else f"{found['first']}L")
    docs = docs.drop(*[f"next_{c}" for c in columns])
    own, at = free_name(docs, "_range"), free_name(docs, "_at")
    rows = docs.selectExpr("*", f"cast({place} as int) {own}") \
        .selectExpr("*", f"""explode(array_compact(array(named_struct('range', {own}, 'role', 0),
            if({is_edge}, named_struct('range', {own} - 1, 'role', 1), null),
            if({head}, named_struct('range', {len(edges)}, 'role', 2), null)))) {at}""")
    ordered = f"over (partition by {at}.range order by {at}.role, {id_col}, text)"
    following = [f"lead(`{c}`) {ordered} next_{c}" for c in columns]
    return rows.selectExpr("*", *following).filter(f"{at}.role = 0").drop(own, at)


def edited(text: str, following: str) -> str:
    """SQL: a text whose last half is replaced by as much of the following text's start."""
    return f"""concat(left({text}, char_length({text}) - char_length({text}) div 2),
        left({following}, cast(char_length({text}) div 2 as int)))"""


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet") \
        .selectExpr("doc_id", "coalesce(text, '') text")
    paired = with_next(with_fingerprint(docs), ["text", "sketch"])
    changed = paired.selectExpr("doc_id", "text", "sketch", "next_sketch",
                                f"{edited('text', 'next_text')} edited_text")
    both = with_fingerprint(changed, "edited_sketch", "edited_text")
    return both.selectExpr(
        "doc_id", "cast(char_length(text) as bigint) n_chars", "sha2(edited_text, 256) edited_sha256",
        f"{as_text('sketch')} fingerprint", f"{as_text('edited_sketch')} edited_fingerprint",
        f"{likeness('sketch', 'edited_sketch')} near_edited",
        f"{likeness('sketch', 'next_sketch')} near_next",
        f"{containment('sketch', 'edited_sketch')} held_by_edited")
