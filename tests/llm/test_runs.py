"""Run detection and resampling against brute force, with odd rows."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from dunwright.llm import resampling, run_detection
from dunwright.llm.queries import QUERIES
from dunwright.llm.recompression import Grammar
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    found = {}
    n = len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def brute_collapse(words, runs):
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def odd_strings(rng):
    yield [0] * 500
    yield list(range(50))
    yield [0, 1] * 40 + [2] + [1, 0] * 40
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    for _ in range(120):
        kind, n = rng.integers(4), int(rng.integers(1, 200))
        if kind == 0:
            yield rng.integers(0, 2, n).tolist()
        elif kind == 1:
            yield np.tile(rng.integers(0, 3, int(rng.integers(1, 30))), 8)[:n].tolist()
        elif kind == 2:
            yield np.repeat(rng.integers(0, 3, n), rng.integers(1, 20, n)).tolist()
        else:
            unit = rng.integers(0, 5, int(rng.integers(1, 20))).tolist()
            yield rng.integers(0, 5, n).tolist() + unit * 3 + unit[:2] + rng.integers(0, 5, 9).tolist()


def test_extension_queries_equal_scans():
    rng = np.random.default_rng(5)
    strings = [np.array(s) for s in odd_strings(rng)]
    grammar = Grammar(strings)
    level = grammar.symbols[0]
    ask = []
    for s, place in zip(strings, grammar.place.tolist()):
        if len(s) > 1:
            for _ in range(20):
                a, b = sorted(rng.choice(len(s), 2, replace=False).tolist())
                ask.append((place + a, place + b))
    a, b = np.array(ask).T
    for step in (1, -1):
        got = grammar.mismatch(a, b, step)
        for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
            while level[x] == level[y]:
                x, y = x + step, y + step
            assert x == z


@pytest.mark.parametrize("least", [9, 12, 15])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(run_detection, "POINTS", 50)  # many slices of grid points
    strings = list(odd_strings(np.random.default_rng(11)))
    got = run_detection.runs_of([np.array(s, dtype=np.int64) for s in strings], least)
    assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(s, least) for s in strings]


def test_short_runs_are_refused():
    with pytest.raises(ValueError):
        run_detection.runs_of([np.arange(3)], 8)


def repeated_tail(words, doc_id):
    h = crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_run_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op12_run_detection"](spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    with_runs = 0
    for doc_id, text in texts.items():
        words = repeated_tail(WORD.findall(text or ""), doc_id)
        runs = brute_runs(words) if len(words) < 3000 else None
        row = got[doc_id]
        if runs is None:
            continue
        with_runs += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == tuple(best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256(
            "".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(
            " ".join(brute_collapse(words, runs)).encode()).hexdigest()
    assert with_runs > 10


def test_runs_of_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a b " * 9), (4, "x " * 40), (4, "x " * 40),
            (5, "é ü " * 15), (6, "a b c"), (7, " ".join(map(str, range(60_000))) + " y" * 30_000)]
    docs = documents(rows, "1 runs", "2 collapsed", "'k' kept", "3 whole", "4 hash", "5 rest")
    out = run_detection.detect_runs(docs)
    assert set(out.columns) == {*docs.columns, "n_words", "runs", "collapsed"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    for k in (1, 2, 3):
        assert (got[k]["runs"], got[k]["collapsed"], got[k]["n_words"]) == ([], "", 0)
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 18, 2)] and got[None]["collapsed"] == "a b"
    assert [tuple(r) for r in got[4]["runs"]] == [(0, 40, 1)] and got[4]["kept"] == "k"
    assert got[5]["collapsed"] == "é ü" and got[6]["collapsed"] == "a b c"
    assert [tuple(r) for r in got[7]["runs"]] == [(60_000, 30_000, 1)]
    tails = run_detection.with_repeated_tails(docs)
    assert set(tails.columns) == set(docs.columns) and tails.count() == len(rows)
    assert run_detection.detect_runs(docs.limit(0)).count() == 0
    assert run_detection.with_repeated_tails(docs.limit(0)).count() == 0


# resampling

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = FEATURE_WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_resample(docs, target):
    s, t = Counter(), Counter()
    for count, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            count.update(crc32(f.encode()) % 10000 for f in brute_features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
            for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, features = brute_features(text)
        weight = sum(gain[crc32(f.encode()) % 10000] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(features), weight, score, len(words)])
    can = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(can[:25 * len(can) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def as_rows(df):
    return sorted(df.select("doc_id", "n_features", "weight", "score", "rank").collect(), key=repr)


def test_resampling_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = as_rows(QUERIES["op13_importance_resampling"](spark, SMALL))
    assert [tuple(r) for r in got] == sorted(brute_resample(docs, target), key=repr)
    assert sum(r["rank"] is not None for r in got) > 20


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("Ab cd-é9 " * 50 + "x" * 300 + " tail").encode()
    whole = sorted(h for _, f in resampling.feature_hashes(text, 3) for h in f)
    monkeypatch.setattr(resampling, "PIECE", 7)
    pieces = list(resampling.feature_hashes(text, 3))
    assert len(pieces) > 10 and sorted(h for _, f in pieces for h in f) == whole
    assert sum(n for n, _ in pieces) == 152


def test_resampling_ties_copies_and_nulls(spark, documents):
    long = " ".join(f"w{i % 7}" for i in range(25))
    rows = [(9, long)] * 8 + [(None, long)] * 3 + [(-5, long)] + [(i, "Some Words here " * 9) for i in range(20)] \
        + [(50, None), (51, ""), (52, "...")]
    docs = documents(rows, "'r' row", "'t' tied", "'k' kept", "1 id", "'d' down", "7 rank", "8 n_words")
    target = documents([(1, "w1 w2 w3"), (2, None)])
    out = resampling.resample(docs, target)
    assert set(out.columns) == {*docs.columns, "n_features", "weight", "score", "rank"}
    got = out.collect()
    assert {r["row"] for r in got} == {"r"} and {r["n_words"] for r in got} == {8}
    expected = brute_resample(rows, ["w1 w2 w3", None])
    as_tuples = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got]
    assert sorted(as_tuples, key=repr) == sorted(expected, key=repr)
    everything = resampling.resample(docs, target, share=(100, 100)).filter("rank is not null")
    assert everything.count() == 32
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)


def test_cutoff_counts_ties(spark):
    rows = spark.createDataFrame([(a, b) for a in (-(1 << 63), -3, 0, (1 << 63) - 1) for b in range(9)],
                                 "a bigint, b bigint")
    order = sorted(map(tuple, rows.collect()))
    for k in (1, 9, 10, 17, 18, 30, 36):
        cut = tuple(resampling.cutoff(rows, ["a", "b"], k))
        assert sum(o[:len(cut)] <= cut for o in order) == k
