"""URL rules, mixing, token counts and top-k search, with odd rows; and the queries that have SQL."""

import random

import numpy as np
import pytest

from dunwright.llm import kd_search, mixing, token_counts, url_rules
from dunwright.llm.common import fresh_folder
from dunwright.llm.queries import ORACLES, QUERIES
from tests.compare import difference, oracle_connection
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), oracle_connection(SMALL), ORACLES[name]) is None


# URL rules

def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]
        path = path if path.startswith("/") else ""
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])] \
        if host or path else []
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow"), ("b.org", "/x", "block"), ("org", "/x/12", "allow"), ("a.b.org", "", "block")]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    hosts = ["example.net", "WWW.Example.NET", "net", "annet", "x.net", "example.com", "b.org", "a.b.org",
             "z.a.b.org", "ab.org", "", "org", "." * 300 + "net"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/de/x?y=/de/", "/fr/#a", "/x", "/x/12", "/xyz", "?q=/en/", "#/en/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x", "") for h in hosts for p in paths]
    urls += [None, "", "no scheme", "a://b://c.net/", "http://e.net/" + "p" * 50_000, urls[5], urls[5]]
    rng.shuffle(urls)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: judge(u, RULES) for i, u in enumerate(urls)}


def test_url_rules_on_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.judge_urls(pages, url_rules.production_rules(spark)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://x.net/")], "page_id bigint, url string")
    assert url_rules.judge_urls(one, none).first().verdict == "allow"


# Mixing

def shared_targets(sizes):
    """Share, stop the sources above their bound, share their excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        each = left / sum(weight[s] for s in free)
        above = {s for s in free if each * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: each * weight[s] for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(4)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 7, 50, 400, 9000]) for s in [None, "", "é", "Z", "a", "aa", "b", "c"]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = shared_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix_meets_budgets_and_agrees_with_itself(documents, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "b"), (502, " \n", None), (7, rows[7][1], rows[7][2]), (None, "x y", "c")]
    docs = documents(rows, "1.5 target")
    first, again = (sorted(map(tuple, mixing.mix_sources(d).select("doc_id", "source", "size", "target", "taken").collect()),
                           key=str) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows)
    for source in ("a", "b", "c", None):
        own = [r for r in first if r[1] == source]
        assert sum(r[4] for r in own) == round(own[0][3]) and all(0 <= r[4] <= 2 * r[2] for r in own)
    mix = mixing.repeat_taken(docs)
    assert mix.columns == docs.columns
    assert sum(r[4] for r in first) <= sum(len(r.text.split()) for r in mix.collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


# Token counts

def test_token_counts_and_cache(spark, documents):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello <s> world", "", None, "a\n\n b", "same text", "same text", "é" * 3000, "word " * 20_000, "<unk></s>"]
    docs = documents(list(enumerate(texts)), "'x' n_tokens")
    cache = fresh_folder(spark, "cache")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, cache).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    assert spark.read.parquet(cache).count() == 6
    token_counts.count_tokens(documents([(1, "same text"), (2, "new")]), path, cache).collect()
    assert spark.read.parquet(cache).count() == 7  # only the miss was appended
    assert token_counts.count_tokens(docs.limit(0), path, cache).count() == 0


def test_token_counts_by_the_other_library(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a <|endoftext|> b"
    row = token_counts.count_tokens(documents([(1, text)]), path, fresh_folder(spark, "cache")).first()
    assert row.n_tokens == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_registered_counts_are_the_library_s(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, SMALL).collect()}
    assert got == {i: len(library.encode(t)) for i, t in texts.items()}


# Top-k search

def brute_top(vectors, k):
    out = {}
    for i, v in vectors:
        if i is not None and i % 20 == 0:
            others = sorted((-int(np.dot(v, w)), j) for j, w in vectors if j is not None and j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in others[:k]]
    return out


@pytest.mark.parametrize("kind", ["normal", "ties", "one vector", "clusters"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(kd_search, "SHARD_ROWS", 100)
    monkeypatch.setattr(kd_search, "LEAF", 8)
    monkeypatch.setattr(kd_search, "QUERY_BLOCK", 9)
    rng = np.random.default_rng(8)
    values = {"normal": lambda: rng.normal(0, 30, 8), "ties": lambda: rng.integers(-1, 2, 8),
              "one vector": lambda: np.ones(8) * 3,
              "clusters": lambda: rng.normal(0, 2, 8) + 50 * rng.integers(0, 3)}[kind]
    vectors = [(i, [int(x) for x in values()]) for i in range(450)]
    df = spark.createDataFrame(vectors, "vec_id bigint, vector array<bigint>").repartition(4)
    got = {}
    for r in kd_search.top_k(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == brute_top(vectors, 20)


def test_search_leaves_out_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]),
            (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (20, [0.01, -0.01]), (20, [0.01, -0.01]), (7, [])]
    df = kd_search.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    got = sorted(map(tuple, kd_search.top_k(df, df.filter("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 1, 64 * 32 * 2), (0, 2, 20, -32), (0, 3, 20, -32), (20, 1, 0, -32), (20, 2, 1, -64)]
    assert kd_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_tree_boxes_are_tight_and_bound():
    rng = np.random.default_rng(9)
    points = rng.integers(-50, 50, (700, 5)).astype(float)
    tree = kd_search.KdTree(points, leaf=16)
    queries = rng.integers(-50, 50, (20, 5)).astype(float)
    bounds = tree.leaf_bounds(queries, np.full(20, -1e18))
    for k, (level, node, a, b) in enumerate(tree.leaves):
        low, high, _ = tree.levels[level]
        assert (low[node] == tree.points[a:b].min(axis=0)).all() and (high[node] == tree.points[a:b].max(axis=0)).all()
        assert ((queries @ tree.points[a:b].T).max(axis=1) <= bounds[:, k]).all()
    assert sorted(tree.order) == list(range(700)) and max(b - a for *_, a, b in tree.leaves) <= 16
