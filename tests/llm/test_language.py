"""Language identification: paths against brute force, script ranges, spans, held-out accuracy, odd rows."""

import itertools
import random

import numpy as np
import pytest

from dunwright.llm import language_id as L
from dunwright.llm.queries import QUERIES
from tests.conftest import SMALL


def brute_path(scores, prior, penalty):
    n = scores.shape[1]
    return max(itertools.product(range(n), repeat=len(scores)), key=lambda path: (
        max(prior[path[0]], L.FLOOR) + sum(scores[i, s] for i, s in enumerate(path))
        - penalty * sum(a != b for a, b in zip(path, path[1:]))))


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_best_paths_equal_all_paths(block):
    rng = np.random.default_rng(block)
    lengths = [0, 1, 2, 7, 6, 0, 5, 7, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores, prior = rng.normal(0, 2, (int(first[-1]), 3)), rng.normal(-1, 1, 3)
    path = L.best_paths(scores.copy(), first, prior, 1.5, block)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert tuple(path[a:b]) == brute_path(scores[a:b], prior, 1.5)


def test_words_keep_places_and_scripts():
    text = "Ab ćd, Привет世界x ٣ İstanbul का"
    words = L.Words([text, "", "12 --", "ab"])
    got = [(p, (text if p == 0 else "ab")[s:s + n], L.SCRIPTS[k]) for p, s, n, k in zip(
        words.piece.tolist(), words.start.tolist(), words.length.tolist(), words.script.tolist())]
    assert got == [(0, "Ab", "Latin"), (0, "ćd", "Latin"), (0, "Привет", "Cyrillic"), (0, "世界", "Han"),
                   (0, "x", "Latin"), (0, "İstanbul", "Latin"), (0, "का", "Devanagari"), (3, "ab", "Latin")]
    assert words.distinct[0] == words.distinct[7] and len(set(words.distinct.tolist())) == 7
    bucket, begin = words.grams()
    padded = words._length + 2
    assert np.array_equal(np.diff(np.append(begin, len(bucket))),
                          sum(np.maximum(0, padded - n + 1) for n in L.GRAMS))


SYLLABLES = {"aa": "ka to mi re su", "bb": "sch ung ein ber ich", "cc": "при вет ста ние об", "dd": "世 界 人 大 中"}


def sentence(rng, lang, words=30):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def model(spark, documents):
    rng = random.Random(3)
    docs = documents([(i, sentence(rng, lang)) for i, lang in enumerate(list(SYLLABLES) * 30)])
    return L.train(docs.selectExpr("doc_id", "text", "element_at(array('aa', 'bb', 'cc', 'dd'), "
                                   "cast(doc_id % 4 + 1 as int)) lang"))


def test_mixed_text_is_cut_into_spans(model):
    rng = random.Random(4)
    order = ["aa", "cc", "bb", "dd", "aa"]
    parts = [sentence(rng, lang) for lang in order]
    text = ". ".join(parts)
    (lang, score, spans), = L.label_texts(model, [text])
    assert lang == "aa" and 0.2 < score < 0.7
    assert [s["lang"] for s in spans] == order
    at = 0
    for part, span in zip(parts, spans):
        assert (span["start"], span["end"]) == (at, at + len(part))
        at += len(part) + 2


def test_scripts_narrow_and_unknown_scripts_say_nothing(model):
    assert model.written[L.SCRIPTS.index("Cyrillic")].tolist() == [False, False, True, False]
    words = L.Words(["ελληνικα ставобние kato"])
    scores = dict(zip(words.scripts.tolist(), model.word_scores(words).tolist()))
    assert scores[L.SCRIPTS.index("Greek")] == [0, 0, 0, 0]
    assert np.argmax(scores[L.SCRIPTS.index("Cyrillic")]) == 2
    assert scores[L.SCRIPTS.index("Latin")][2] == L.FLOOR == scores[L.SCRIPTS.index("Latin")][3]


def test_pieces_and_blocks_give_the_same_labels(model, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(sentence(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 90)) for _ in range(5))
             for _ in range(10)] + ["", "x"]
    whole = L.label_texts(model, texts)
    monkeypatch.setattr(L, "PIECE", 200)
    monkeypatch.setattr(L, "BLOCK", 10)
    assert L.label_texts(model, texts) == whole


def test_odd_rows(spark, documents, model):
    rows = [(1, None), (2, ""), (3, "123 .,; ́ ٣"), (None, "kato mire"), (5, "schung einber"),
            (5, "schung einber"), (6, "ставобние " * 40_000)]
    docs = documents(rows, "1 kept", "2 whole", "'z' spans", "3 score")
    out = L.label_languages(docs, model)
    assert set(out.columns) == {*docs.columns, "lang_pred"}
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["kept"]) for r in out.collect()}
    assert got == {1: ("und", 0.0, 1), 2: ("und", 0.0, 1), 3: ("und", 0.0, 1), None: ("aa", 1.0, 1),
                   5: ("bb", 1.0, 1), 6: ("cc", 1.0, 1)}
    assert L.label_languages(docs.limit(0), model).count() == 0
    for nothing in (docs.limit(0), docs.selectExpr("* except (lang)", "cast(null as string) lang")):
        empty = L.train(nothing)
        assert empty.languages == []
        assert {(r["lang_pred"], r["score"]) for r in L.label_languages(docs, empty).collect()} == {("und", 0.0)}


def test_most_frequent_languages_are_learned(spark, documents):
    rng = random.Random(6)
    docs = documents([(i, sentence(rng, "aa")) for i in range(60)]).selectExpr(
        "doc_id", "text", "case when doc_id < 5 then 'z' when doc_id < 30 then 'y' else 'x' end lang")
    assert L.train(docs, languages=2).languages == ["x", "y"]


def test_held_out_accuracy_of_the_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op11_language_id"](spark, SMALL).join(docs, "doc_id").filter(
        "lang is not null and lang_pred <> 'und'").selectExpr(
        "held_out", "lang = lang_pred good", "score between 0 and 1 fine").collect()
    assert all(r["fine"] for r in got)
    for held in (True, False):
        rows = [r["good"] for r in got if r["held_out"] == held]
        assert len(rows) > 20 and sum(rows) / len(rows) > 0.95
