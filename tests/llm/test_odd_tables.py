"""Null ids that bridge components, large negative scores, clashing helper names, documents without words."""

import numpy as np
import pytest

from dunwright.llm import fingerprints, jaccard_join, kd_search, mixing, token_counts, url_rules
from dunwright.llm.common import fresh_folder

WORDS = [f"w{i}" for i in range(60)]


def near(*changed):
    return " ".join("other" if i in changed else w for i, w in enumerate(WORDS))


def test_null_ids_bridge_components(spark, documents):
    """1 is like the nameless row, that is like 2, but 1 is not like 2."""
    a, b, c = near(), near(0, 59), near(0, 59, 10)
    rows = [(1, a), (None, b), (2, c), (None, near(1)), (None, "lonely " * 9), (5, "something else " * 9)]
    found = jaccard_join.near_components(documents(rows))
    got = sorted(map(repr, [(r.doc_id, r.component_id) for r in found.collect()]))
    links = {(x, y) for x, (_, s) in enumerate(rows) for y, (_, t) in enumerate(rows) if x != y and linked(s, t)}
    assert sorted(map(repr, brute(rows, links))) == got
    assert ("(2, 1)" in got) and got.count("(None, 1)") == 2 and "(None, None)" in got
    named = jaccard_join.near_components(documents([(9 if r[0] is None and i == 1 else r[0], r[1])
                                                    for i, r in enumerate(rows)]))
    assert {r.component_id for r in named.collect() if r.doc_id in (1, 2, 9)} == {1}
    kept = [r.doc_id for r in jaccard_join.one_per_component(documents(rows)).collect()]
    assert sorted(map(str, kept)) == ["1", "5", "None"]


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def linked(s, t):
    s, t = shingles(s), shingles(t)
    return 100 * len(s & t) >= 80 * len(s | t)


def brute(rows, links):
    for start, (doc_id, _) in enumerate(rows):
        reached, todo = {start}, [start]
        while todo:
            x = todo.pop()
            more = {y for a, y in links if a == x} - reached
            reached |= more
            todo += more
        yield doc_id, min((rows[i][0] for i in reached if rows[i][0] is not None), default=None)


@pytest.mark.parametrize("size", [600, 3000])
@pytest.mark.parametrize("top", [10 ** 6, 2 ** 29, 2 ** 30])
def test_large_negative_scores_keep_their_ties(spark, size, top):
    """All products are equal and far below zero: the smallest ids win."""
    vectors = spark.range(size).selectExpr("id vec_id", f"array(bigint(-{top}), bigint({top})) vector")
    query = spark.sql(f"select 1000000L vec_id, array(bigint({top}), bigint(-{top})) vector")
    got = [(r.rank, r.vec_id, r.score) for r in kd_search.top_k(vectors, query).orderBy("rank").collect()]
    assert got == [(i + 1, i, -2 * top * top) for i in range(20)]


def test_bounds_that_cancel_rule_nothing_out(spark):
    r = np.random.default_rng(2)
    big = r.integers(2 ** 24, 2 ** 25, 900)
    rows = [(i, [int(b), int(b + r.integers(-3, 4))]) for i, b in enumerate(big)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, vector array<bigint>")
    query = spark.sql(f"select 5000L vec_id, array(bigint({2 ** 25}), bigint(-{2 ** 25})) vector")
    want = sorted(((-(2 ** 25) * (v[0] - v[1]) * -1, i) for i, v in rows), key=lambda x: (-x[0], x[1]))[:20]
    got = [(r.score, r.vec_id) for r in kd_search.top_k(vectors, query).orderBy("rank").collect()]
    assert got == want


HELPERS = ["_hashes", "_sketch", "sketch", "_range", "_at", "next_text", "next_sketch", "_url", "_best", "_key", "page",
           "own_url", "digest", "own_digest", "_tokens", "bytes", "kept", "_size", "_digest", "_source",
           "_source_size", "_target", "_taken", "_offset", "_words", "_upto", "_copy", "copy", "rule_host",
           "rule_digest", "_suffix", "_path", "_host", "n_tokens"]


@pytest.fixture(scope="module")
def clashing(documents):
    rows = [(i, text, "s" if i % 2 else None) for i, text in enumerate(
        ["a b c d e f", "a b c d e f", "", None, "x y " * 30, "one"])]
    return documents(rows, *[f"{i} {c}" for i, c in enumerate(HELPERS)], "concat('http://a.net/', doc_id) url")


def unchanged(before, after, *made):
    """Every column of the input that the operator does not make is still there, with its values."""
    kept = [c for c in before.columns if c not in made]
    assert set(after.columns) == {*kept, *made}
    assert after.count() == before.count()
    rows = lambda df: sorted(map(repr, df.select(*[f"`{c}`" for c in kept]).collect()))
    assert rows(after) == rows(before)


def test_fingerprints_keep_clashing_columns(clashing):
    made = fingerprints.with_fingerprint(clashing)
    unchanged(clashing, made, "sketch")
    unchanged(made, fingerprints.with_next(made, ["text", "sketch"]), "next_text", "next_sketch")


def test_token_counts_keep_clashing_columns(spark, clashing):
    import public_tokenizers

    out = token_counts.count_tokens(clashing, public_tokenizers.path(token_counts.TOKENIZER),
                                    fresh_folder(spark, "cache"))
    unchanged(clashing, out, "n_bytes", "n_tokens", "over_limit")


def test_url_rules_keep_clashing_columns(spark, clashing):
    docs = clashing.selectExpr("* except (url)", "if(doc_id = 3, null, url) url")
    out = url_rules.judge_urls(docs, url_rules.production_rules(spark))
    unchanged(docs, out, "host", "path", "rule", "verdict")
    assert {r.verdict for r in out.filter("url is not null").collect()} == {"block"}


def test_mixing_keeps_clashing_columns_and_documents_without_words(clashing):
    unchanged(clashing, mixing.mix_sources(clashing), "size", "source_size", "target", "taken")
    out = mixing.repeat_taken(clashing)
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(2) == ids.count(3) == 1  # the empty and the null text
    assert len(set(ids)) >= 4
