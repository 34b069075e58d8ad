"""Fingerprints and the Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from dunwright.llm import fingerprints, jaccard_join
from dunwright.llm.hashing import Spans
from dunwright.llm.queries import QUERIES
from tests.conftest import SMALL

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 80 * (len(a) + len(b) - common):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets}


def found_components(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(df).collect()}


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows, base = [], [[word() for _ in range(n)] for n in (12, 40, 150, 700)]
    for g, words in enumerate(base):
        for _ in range(40):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[:len(copy) - rng.randrange(len(copy) // 6 + 1)]
            rows.append(" ".join(copy))
    for _ in range(60):  # texts that share a passage but are not near
        rows.append(" ".join([word() for _ in range(rng.randrange(10, 90))] + passage))
    rows += ["one two three", "ONE two  three", "one two", "", " \n ", None, "x" * 50_000, "x" * 50_000]
    return [(10 * i + 3, t) for i, t in enumerate(rows)]


def test_join_equals_brute_force(documents, near_copies):
    assert found_components(documents(near_copies)) == brute_components(near_copies)


def test_join_with_low_limits_equals_brute_force(documents, near_copies, monkeypatch):
    """Everything frequent, hot and in many blocks."""
    for name, value in (("FREQUENT", 2), ("HOT", 3), ("FLUSH", 2000), ("BLOCK_TOKENS", 3000),
                        ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert found_components(documents(near_copies)) == brute_components(near_copies)


def test_linked_sets_share_a_signature():
    """The signatures' promise itself, on random sets around the threshold."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        pool = np.unique(rng.integers(0, 1 << 60, 2 * n).astype(np.uint64))
        a = np.sort(pool[:n])
        lost = int(rng.integers(0, jaccard_join.most_lacking(n) + 1))
        b = np.sort(np.concatenate([rng.permutation(a)[lost:], pool[n:n + int(rng.integers(0, lost + 1))]]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        often = rng.random(len(pool)) < rng.random()
        kept = lambda s, other: [s[np.isin(s, other) & ~often[np.searchsorted(pool, s)]],
                                 s[np.isin(s, other) & often[np.searchsorted(pool, s)]]]
        own, theirs = kept(a, b), kept(b, a)
        assert len(np.intersect1d(jaccard_join.signatures(len(a), *own),
                                  jaccard_join.signatures(len(b), *theirs)))


def test_join_keeps_one_row_per_component(documents):
    rows = [(5, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "q r s t u v"), (4, "q r s t u v"), (9, None)]
    kept = jaccard_join.one_per_component(documents(rows, "1 size"))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 9]
    assert kept.columns[-1] == "size"


def test_join_keeps_rows_of_null_and_repeated_ids(documents):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x"
    rows = [(None, "one two three four five six"), (None, "One two  three four five six"), (None, "seven eight"), (None, ""), (None, None),
            (5, "red green blue"), (5, "north south west"), (5, "north south west"), (5, ""), (5, None),  # unlinked texts of one id
            (1, near), (3, near + " y"), (3, "top bottom"),  # a near copy whose id heads another component
            (7, "left right"), (8, "left right"), (None, "left right")]
    kept = jaccard_join.one_per_component(documents(rows, "'c' class", "1 size")).select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([
        ("None", "One two  three four five six"), ("None", "seven eight"), ("None", ""), ("None", ""), ("5", "red green blue"),
        ("5", "north south west"), ("5", ""), ("1", near), ("3", "top bottom"), ("7", "left right")])


def test_join_of_empty_and_unlinked_tables(documents):
    assert found_components(documents([])) == {}
    assert found_components(documents([(1, "a b"), (2, "c d")])) == {1: (1, 1), 2: (1, 2)}
    assert found_components(documents([(None, "a b"), (7, "a b")])) == {None: (1, 7), 7: (1, 7)}


def test_registered_join_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in QUERIES["op2_jaccard_join"](spark, SMALL).collect()}
    assert got == brute_components(rows)


def test_shingle_hashes_are_those_of_equal_shingles():
    texts = ["A b c D e f", "a b c d e f", "b c d e f", "a\tb", "a b ", "", "é ä ö ü ß e"]
    sets = Spans([t.encode() for t in texts]).shingles()
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert list(sets[0]) == list(sets[1]) and set(sets[2]) < set(sets[1]) and list(sets[3]) == list(sets[4])


def test_fingerprints_of_the_small_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op1_fingerprints"](spark, SMALL).collect()}
    errors = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
        if len(a) <= fingerprints.AT_LEAST and len(b) <= fingerprints.AT_LEAST:
            assert errors[-1] < 1e-12  # small sets are kept whole
    assert np.mean(errors) < 0.05 and len({got[i].fingerprint for i, _ in rows}) == len({t for _, t in rows})


def test_fingerprint_edges(documents):
    rows = [(2, "a b c d e f"), (1, None), (4, ""), (4, "a b c d e f"), (9, "z " * 30_000)]
    df = documents(rows).selectExpr("doc_id", "coalesce(text, '') text")
    paired = fingerprints.with_next(fingerprints.with_fingerprint(df), ["text"])
    follows = {(r.doc_id, r.text[:3]): r.next_text[:3] for r in paired.collect()}
    assert follows == {(1, ""): "a b", (2, "a b"): "", (4, ""): "a b", (4, "a b"): "z z", (9, "z z"): ""}
    alike = paired.selectExpr(f"{fingerprints.as_text('sketch')} f", "text").collect()
    assert len({r.f for r in alike if r.text == "a b c d e f"}) == 1
    assert fingerprints.with_next(df.limit(0), ["text"]).count() == 0
    one = fingerprints.with_next(df.filter("doc_id = 2"), ["text"]).first()
    assert one.next_text == one.text


def test_likeness_of_very_unequal_documents(spark):
    words = [f"w{i}" for i in range(20_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:400]))], "a string, b string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "x", "a"), "y", "b")
    row = both.selectExpr(f"{fingerprints.containment('y', 'x')} inside", f"{fingerprints.likeness('x', 'y')} near",
                          f"{fingerprints.likeness('x', 'x')} own").first()
    assert row.inside == 1.0 and row.own == 1.0 and abs(row.near - 396 / 19996) < 0.02
