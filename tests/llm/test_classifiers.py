"""Quality and toxicity: held-out accuracy, what labels may be read, and odd rows."""

import numpy as np
import pytest

from dunwright.llm import labelled, quality_classifier, toxicity
from dunwright.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op6_quality_classifier", "quality", 0.97),
                                                ("op3_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, FOLDER)
    assert got.count() == 1000
    joined = got.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out")
    share = joined.selectExpr(f"avg(cast(predicted = {label} as int)) a").first().a
    assert share >= least


def test_held_out_rows_follow_crc32(spark):
    import zlib

    rows = spark.range(200).selectExpr("id doc_id").selectExpr(
        "doc_id", f"{labelled.held_out(5, 0)} h", f"{labelled.held_out(4, 2)} g").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.g == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_fit_reads_no_held_out_label_and_at_most_the_bound(spark, documents):
    docs = documents([(i, f"t{i}") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)],
                                   "doc_id bigint, quality int")
    ids = lambda texts: [(t, b"") for t in texts]
    seen = labelled.sample_features(docs, labels, "quality", (4, 2), 1000, ids)
    import zlib
    assert {int(own[1:]) for _, own, _ in seen} == {
        i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(labelled.sample_features(docs, labels, "quality", (4, 2), 7, ids)) == 7


@pytest.mark.parametrize("module, score, label", [
    (quality_classifier, "score_quality", "quality"), (toxicity, "score_toxicity", "toxic")])
def test_no_labels_null_texts_and_clashing_columns(spark, documents, module, score, label):
    docs = documents([(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)], "'old' score")
    labels = spark.createDataFrame([], f"doc_id bigint, {label} int")
    model = module.train(docs, labels)
    rows = getattr(module, score)(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert getattr(module, score)(docs.limit(0), model).count() == 0
    one_class = spark.createDataFrame([(1, 1), (3, 1)], f"doc_id bigint, {label} int")
    rows = getattr(module, score)(docs, module.train(docs, one_class)).collect()
    assert all(r.score > 0.5 for r in rows)


def test_ngram_buckets_are_distinct_and_of_the_whole_text():
    a, b, c = quality_classifier.ngram_buckets([b"", b"the the the", ("lang " * 9000 + "END!!").encode()])
    assert len(a) == 0 and len(np.unique(b)) == len(b)
    shorter = quality_classifier.ngram_buckets([("lang " * 9000).encode()])[0]
    assert len(np.setdiff1d(c, shorter)) > 0


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(10, 90, 20), [i % 2]])) for i in range(200)]
    model = quality_classifier.fit([i % 2 for i in range(200)], rows, bits=7)
    margins = model.margins(rows)
    assert all((m > 0) == (i % 2 == 1) for i, m in enumerate(margins))
    assert model.slope > 0


def test_swapping_takes_the_weight_from_group_names():
    """Labels that blame a group's name: the penalty moves the weight to the insult."""
    insults, plain = ["you scum", "what scum they are", "scum again"], ["a fine day", "see you soon", "hello there"]
    texts, labels = [], []
    for i in range(90):
        texts.append((insults[i % 3] + " muslim").encode())
        labels.append(1)
        texts.append(plain[i % 3].encode())
        labels.append(0)
    rows = toxicity.word_features(texts)
    pairs = []
    for t in texts:
        other = toxicity.swapped(t)
        if other != t:
            pairs.append(tuple(toxicity.word_features([t, other])))
    free = toxicity.fit(labels, rows, [])
    bound = toxicity.fit(labels, rows, pairs)
    neutral = [b"the muslim says hello"]
    assert bound.scores(neutral)[0] < free.scores(neutral)[0]
    weight = lambda model, word: float(model.weight[model.slots(toxicity.word_features([word])[0])].sum())
    assert abs(weight(bound, b"muslim")) < 0.3 * abs(weight(free, b"muslim"))
    assert weight(bound, b"scum") > weight(free, b"scum")
    assert bound.scores([b"what scum they are"])[0] > bound.scores(neutral)[0]


def test_swapped_names_stay_in_their_kind():
    for term, (kind, _) in toxicity._KIND.items():
        other = toxicity.swapped(b"the " + term + b" here")
        name = other[4:-5].decode()
        assert name in toxicity.IDENTITY_TERMS[kind] and name.encode() != term
    assert toxicity.swapped(b"manners") == b"manners"


def test_dual_descent_solves_the_dual(monkeypatch):
    """The same margins as plain projected gradient steps on the dual problem."""
    monkeypatch.setattr(quality_classifier, "EPOCHS", 400)
    rng = np.random.default_rng(1)
    width, ratio = 40, rng.normal(0, 1, 40)
    rows = [np.flatnonzero(rng.random(width) < 0.3) for _ in range(30)]
    y = np.where(rng.random(30) < 0.4, 1, -1)
    weight = quality_classifier._dual_descent(rows, y, ratio)
    x = np.zeros((30, width))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / max(np.sqrt((ratio[f] ** 2).sum()), 1e-9)
    cost = np.where(y > 0, quality_classifier.COST,
                    quality_classifier.COST * max(1.0, (y > 0).sum() / (y < 0).sum()) ** 0.5)
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(30), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    want = x @ (x.T @ (alpha * y))
    got = np.array([weight[f].sum() / max(np.sqrt((ratio[f] ** 2).sum()), 1e-9) for f in rows])
    assert np.allclose(got, want, atol=1e-3)


def test_toxicity_fit_equals_a_plain_solver():
    """Features, labels and swapped sentences by hand: within 2 % of the loss that many small steps reach."""
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(1, 1 << 63, 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    y = (rng.random(120) < 0.5).astype(int)
    rows = [np.sort(names[(rng.random(12) < (0.2 + 0.5 * label * (np.arange(12) < 4)))]) for label in y]
    pairs = [(names[:1], names[5:6]), (names[1:3], names[2:4])]
    model = toxicity.fit(y.tolist(), rows, pairs)
    table, evidence = toxicity._vocabulary(rows, y.astype(float))
    slot = (names >> np.uint64(64 - toxicity.SLOTS_BITS)).astype(np.int64)
    scale = np.where(table[slot] == names, evidence[slot], 0.0)
    x = np.array([np.isin(names, r) for r in rows]) * scale
    change = np.array([(np.isin(names, a).astype(float) - np.isin(names, b)) for a, b in pairs]) * scale
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5

    def loss(w, c):
        p = np.clip(1 / (1 + np.exp(-(x @ w + c))), 1e-12, 1 - 1e-12)
        return -(balance * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean() \
            + toxicity.RIDGE / 2 * w @ w + toxicity.SWAP_PENALTY / len(pairs) * ((change @ w) ** 2).sum()

    w, c = np.zeros(12), 0.0
    for _ in range(40_000):
        error = balance * (1 / (1 + np.exp(-(x @ w + c))) - y) / len(y)
        g = x.T @ error + toxicity.RIDGE * w + 2 * toxicity.SWAP_PENALTY / len(pairs) * (change.T @ (change @ w))
        w, c = w - 0.05 * g, c - 0.05 * error.sum()
    fitted = np.where(scale > 0, model.weight[slot] / np.where(scale > 0, scale, 1), 0.0)
    assert loss(fitted, model.intercept) < 1.02 * loss(w, c)
    eps = 1e-6  # the gradient is the one that finite differences of this loss give
    for j in range(12):
        d = np.zeros(12)
        d[j] = eps
        assert abs((loss(w + d, c) - loss(w - d, c)) / (2 * eps)) < 1e-2


def test_many_documents_with_one_labelled_id_are_one_row(spark, documents):
    docs = documents([(1, f"text {i}") for i in range(500)] + [(2, "two")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    seen = labelled.sample_features(docs, labels, "quality", (4, 9), 100, lambda t: [(x, b"") for x in t])
    assert len(seen) == 2 and sorted(s[0] for s in seen) == [0, 1]
