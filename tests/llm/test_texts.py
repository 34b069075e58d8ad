"""HTML extraction, segmentation and the whole pipeline."""

import collections
import html
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from dunwright.llm import html_templates, mixing, quality_classifier, segmentation, toxicity
from dunwright.llm.common import chunks, written
from dunwright.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.test_pairs import brute_components

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head>
<body><header class="site">Name</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div>
<div class="cookie-notice">We use cookies</div><{tag}><h1>Head &amp; {n}</h1><p><b>First {n} line<br>goes on<p>Second
 {n}&nbsp;line</p><form><input value="x"><p>Sign up</p></form>{extra}</{tag}><aside>Side</aside>
<section id="comments"><article class="comment"><p>Nice {n}</p></article></section>
<footer>&copy; Name &middot; {n}</footer></body>"""


def extract(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in html_templates.extract_articles(pages, **more).collect()}


@pytest.mark.parametrize("tag", ["article", "main", "div class='story'"])
@pytest.mark.parametrize("hosts", [10_000, 0])
def test_articles_of_a_host(spark, tag, hosts):
    rows = [(i, f"http://h.net/{i}", PAGE.format(tag=tag, n="x" * (i + 1), extra="").replace("</div class='story'>", "</div>"))
            for i in range(12)]
    got = extract(spark, rows, broadcast_hosts=hosts)
    assert got == {i: f"Head & {'x' * (i + 1)} First {'x' * (i + 1)} line goes on Second {'x' * (i + 1)} line"
                   for i in range(12)}


def test_repeated_text_of_a_template_is_dropped_and_of_few_pages_kept(spark):
    extra = "<div><p>Read more stories</p></div>"
    make = lambda n: [(i, "http://h.net/", PAGE.format(tag="article", n=f"n{i}", extra=extra)) for i in range(n)]
    assert all("Read more" not in t for t in extract(spark, make(12)).values())
    assert all(t.endswith("Read more stories") for t in extract(spark, make(5)).values())
    copies = [(i, "http://h.net/", make(1)[0][2]) for i in range(30)]
    assert all(t.endswith("Read more stories") for t in extract(spark, copies).values())


@pytest.mark.parametrize("repeats", [html_templates.BROADCAST_REPEATS, 0])
def test_copies_of_a_page_keep_their_article(spark, repeats):
    page = "<body><div>Site</div><article id='post-{0}'><p>Alone {0}</p><p>More {0}</p></article></body>"
    rows = [(i, "http://h.net/", page.format(i)) for i in range(12)] + [(i, "http://h.net/", page.format("c")) for i in range(12, 42)]
    assert extract(spark, rows) == {i: f"Alone {n} More {n}" for i in range(42) for n in [i if i < 12 else "c"]}
    pages = spark.createDataFrame([("h", h) for _, _, h in rows] + [("g", rows[0][2]), ("h", None), ("h", ""), ("", "x"), ("", "x")],
                                  "host string, html string")
    found = [tuple(r) for r in html_templates.distinct_pages(pages, repeats).collect()]
    assert len(found) == len(set(found)) and ("h", "") in found and ("g", rows[0][2]) in found
    assert sum(h == "h" for h, _ in found) == 14 and found.count(("", "x")) == 1


@pytest.mark.parametrize("host_texts", [html_templates.HOST_TEXTS, 0])
def test_a_notice_on_few_pages_of_a_large_host_is_dropped(spark, host_texts):
    notice = "<div class='box'><p>Read this first</p></div>"
    rows = [(i, "http://h.net/", f"<body><article><p>Own {i}</p>{notice if i < 12 else ''}</article></body>") for i in range(260)]
    got = extract(spark, rows + [(260, "http://g.net/", "<p>Own 260</p>")], host_texts=host_texts)
    assert got == {i: f"Own {i}" for i in range(261)}


@pytest.mark.parametrize("page, text", [
    ("<div class='layout with-sidebar'><article>Long text</article></div>", "Long text"),
    ("<article class='post comments-open'><p>Long text</article>", "Long text"),
    ("<article class='post has-header'><p>Long text</article>", "Long text"),
    ("<div class='content-with-menu'><p>Long text</div>", "Long text"),
    ("<div id='search-results'><main>Long text</main></div>", "Long text"),
    ("<h1>Top</h1><div class='sidebar'><article>Long text<p class='share'>Share</p></article></div>", "Long text"),
    ("<article class='widget'>Long text<div class='comments'><article>Nice</article></div></article>", "Long text"),
    ("<main><h1>Top</h1><div class='search'><article>Long text</article></div></main>", "Top Long text"),
    ("<main>Long text<div class='sidebar'><article>Short</article></div></main>", "Long text"),
    ("<p>Long text<div class='comments'><article>Nice, and much longer</article></div>", "Long text"),
    ("<div class='related'><article>Long text</article></div>", "Long text"),
    ("<p>Long text<div class='cookie-notice'>Yes?</div><aside><article>Side, longer</article></aside>", "Long text")])
def test_class_words_do_not_hide_the_article(page, text):
    assert html_templates.article_text(f"<body>{page}</body>", set(), None) == text


def bare(page):
    """A page whose tags and classes say nothing of its parts."""
    page = re.sub(r"<(/?)(nav|article|footer|header|aside|main)\b", r"<\1div", page)
    return re.sub(r"<div [^>]*>", "<div>", page)


@pytest.mark.parametrize("optional", [False, True])
def test_slots_decide_where_tags_say_nothing(spark, optional):
    rows = [r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect() if r.html][:30]
    pages = [bare(r.html) for r in rows]
    if optional:  # a notice on some pages moves what follows it
        pages = [p.replace("<body>", "<body><div>Site moves on Monday</div>") if i % 3 else p for i, p in enumerate(pages)]
    got = extract(spark, [(i, "http://h.net/", p) for i, p in enumerate(pages)])
    wanted = [html_templates.article_text(r.html, set(), None) for r in rows]
    assert sum(got[i] == text for i, text in enumerate(wanted)) >= 0.95 * len(rows)
    assert sum(got[i] != html_templates.article_text(p, set(), None) for i, p in enumerate(pages)) >= 0.95 * len(rows)


def test_lists_of_varying_length_have_no_places(spark):
    page = "<body><div><p>Menu</p></div><div><h2>Top {0}</h2>{1}</div><div><p>Foot {0}</p></div></body>"
    rows = [(i, "http://h.net/", page.format(i, "".join(f"<div>Part {j} of {i}{' long' * 90 * (j == 0)}</div>" for j in range(1 + i % 3))))
            for i in range(12)]
    got = extract(spark, rows)
    assert got == {i: " ".join([f"Top {i}", *(f"Part {j} of {i}{' long' * 90 * (j == 0)}" for j in range(1 + i % 3))])
                   for i in range(12)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "plain text &lt;b&gt; only"), (4, "http://a/", "<p>a<p>b"),
            (5, "http://b/", "<article><p>" + "w " * 60_000 + "</article>"), (6, "http://c/", "<script>never closed"),
            (7, "http://d/", "a < b <3 <article>x<ul><li>1<li>2</ul><i>y</i>z</article>"), (7, "http://d/", "<p>a<p>b")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 n_chars", "'h' host")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_templates.extract_articles(pages).collect())
    assert [t for _, t, _ in got] == ["", "", "plain text <b> only", "a b", ("w " * 60_000).strip(), "", "a b", "x 1 2 yz"]
    assert all(n == len(t) for _, t, n in got)
    assert html_templates.extract_articles(pages.limit(0)).count() == 0


def test_registered_pages_equal_their_article_elements(spark):
    got = {r.page_id: r.text for r in QUERIES["op9_html_extraction"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")
        assert got[r.page_id] == " ".join(html.unescape(inner).split())


# Segmentation

@pytest.fixture(scope="module")
def lattices():
    import public_tokenizers

    return segmentation.Lattices(segmentation.Pieces(public_tokenizers.path(segmentation.MODEL)))


def test_words_are_those_that_no_piece_links():
    texts = ["", " ", "a  b\n\n c ", "\n", "▁x ▁▁", "\udc81".encode("utf-8", "replace").decode(), "一 二\n"]
    points, start, end, sizes = segmentation.words_of(texts)
    found = ["".join(map(chr, points[a:b])) for a, b in zip(start, end)]
    wanted = [re.findall("▁*[^▁\n]+|▁+|\n", "▁" + t.replace("▁", "\udc81").replace(" ", "▁")) if t else []
              for t in texts]
    assert found == [w for words in wanted for w in words]
    assert sizes.tolist() == [len(words) for words in wanted]


def test_words_held_by_a_worker_change_no_sample(lattices):
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column("text").to_pylist()[:60]
    small = segmentation.Lattices(lattices.pieces, most_edges=3000)
    trimmed = 0
    for i in range(0, len(rows), 5):
        texts, keys = [t or "" for t in rows[i:i + 5]], list(range(i, min(i + 5, len(rows))))
        full = small.n_edges > small.most_edges
        a = segmentation.sample_texts(small, keys, texts, 3)
        trimmed += full
        b = segmentation.sample_texts(lattices, keys, texts, 3)
        for x, y in zip(a, b):
            assert x[-1] == y[-1]
            assert [p[1:] for p in x[:-1]] == [p[1:] for p in y[:-1]]
            assert [segmentation._ids(small, p[0]).tolist() for p in x[:-1]] == \
                [segmentation._ids(lattices, p[0]).tolist() for p in y[:-1]]
    assert trimmed and len(small.hashes) == len(small.first) == len(small.sizes)


def all_segmentations(lat, text):
    """Every segmentation of a text as pieces, with its probability from the pieces alone."""
    pieces, out = lat.pieces, {}

    def go(rest, ids, value):
        if not rest:
            out[tuple(ids)] = math.exp(value)
        for n in range(1, len(rest) + 1):
            i = pieces.ids.get(rest[:n])
            if i is not None:
                go(rest[n:], ids + [i], value + pieces.log_p[i])
        if rest and rest[0] not in pieces.ids:
            spelled = [int(pieces.byte_id[b]) for b in rest[0].encode()]
            go(rest[1:], ids + spelled, value + sum(pieces.log_p[i] for i in spelled))

    go("▁" + text.replace(" ", "▁"), [], 0.0)
    total = sum(out.values())
    return {ids: p / total for ids, p in out.items()}


@pytest.mark.parametrize("text", ["ab c", "the cat", "a\nb", "né"])
def test_samples_follow_sampling_without_replacement(lattices, text):
    n, k = 4000, 3
    p = all_segmentations(lattices, text)
    first, second, estimate = collections.Counter(), collections.Counter(), collections.Counter()
    for *paths, threshold in segmentation.sample_texts(lattices, [segmentation.row_key(i, 1) for i in range(n)],
                                                       [text] * n, k):
        ids = [tuple(segmentation._ids(lattices, e).tolist()) for e, _, _ in paths]
        assert len(set(ids)) == min(k, len(p)) and all(abs(math.log(p[i]) - v) < 1e-3 for i, (_, v, _) in zip(ids, paths))
        values = [v for _, _, v in paths] + [threshold]
        assert values == sorted(values, reverse=True)
        first[ids[0]] += 1
        second[ids[0], ids[1]] += 1
        for i, (_, v, _) in zip(ids, paths):
            estimate[i] += math.exp(v - segmentation.log_inclusion(v, threshold)) / n
    near = lambda got, want: abs(got / n - want) < 4.5 * math.sqrt(want * (1 - want) / n) + 1e-3
    likely = sorted(p, key=p.get, reverse=True)[:5]
    assert all(near(first[i], p[i]) for i in likely)
    assert all(near(second[i, j], p[i] * p[j] / (1 - p[i])) for i in likely[:3] for j in likely[:3] if i != j)
    assert all(abs(estimate[i] - p[i]) < 0.05 for i in likely)  # inclusion scores undo the sampling


def test_round_trip_and_odd_texts(spark, documents):
    import public_tokenizers

    texts = ["", None, " ", "a  b   c ", "▁raw ▁▁ mark", "tab\tand\r\nlines\n", "漢字 and 🎉 emoji", "x" * 3000,
             "long text " * 8000, "a", "a"]
    docs = documents(list(enumerate(texts)) + [(None, "null key")])
    rows = segmentation.segment(docs, public_tokenizers.path(segmentation.MODEL), k=3).collect()
    assert all(r.decoded for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(range(len(texts))) | {None}
    assert len(by[0]) == len(by[1]) == 1 and by[0][0].n_pieces == 0 and by[0][0].log_inclusion == 0.0
    assert all(len({bytes(r.ids) for r in own}) == len(own) for own in by.values())
    assert sorted(r.rank for r in by[8]) == [1, 2, 3]
    again = segmentation.segment(docs.repartition(5), public_tokenizers.path(segmentation.MODEL), k=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert segmentation.segment(docs.limit(0), public_tokenizers.path(segmentation.MODEL)).count() == 0


def test_registered_segments_decode(spark):
    got = QUERIES["op4_segmentation"](spark, SMALL)
    assert got.filter("not decoded").count() == 0 and got.select("doc_id", "ids_sha256").distinct().count() == 400


def test_stored_ids_decode_to_the_texts(spark, documents):
    import public_tokenizers

    model = public_tokenizers.path(segmentation.MODEL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for found in (QUERIES["op4_segmentation"](spark, SMALL), corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)):
        got = segmentation.decode(written(found, "test"), model).collect()
        assert len(got) == 2 * len(texts) and all(r.text == texts[r.doc_id] for r in got)
    odd = documents([(1, "漢字 ▁ 🎉\n"), (2, None), (3, "")])
    rows = segmentation.segment(odd, model).selectExpr("doc_id", "if(doc_id = 3, null, ids) ids", "'x' text")
    got = segmentation.decode(rows, model).collect()
    assert {(r.doc_id, r.text) for r in got} == {(1, "漢字 ▁ 🎉\n"), (2, ""), (3, None)}


def test_chunks_hold_every_text_once():
    texts = [b"x" * n for n in (5, 0, 30, 2, 2, 2)]
    spans = list(chunks(texts, 8))
    assert [i for a, b in spans for i in range(a, b)] == list(range(6)) and list(chunks([], 8)) == []


# The pipeline

def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        after = written(stage(spark, docs, SMALL), "test")
        kept = after.collect()
        if name in ("quality", "toxicity"):
            module, floor = (quality_classifier, 0.7) if name == "quality" else (toxicity, 0.5)
            model = module.train(docs, labels)
            scores = model.scores([r.text.encode() for r in before])
            want = {r.doc_id for r, s in zip(before, scores) if (s >= floor) == (name == "quality")}
            assert {r.doc_id for r in kept} == want
        if name == "near_copies":
            want = {c for _, c in brute_components([(r.doc_id, r.text) for r in before]).values()}
            assert sorted(r.doc_id for r in kept) == sorted(want)
        if name == "mixing":
            taken = {r.doc_id: math.ceil(r.taken / r.size) for r in mixing.mix_sources(docs).collect() if r.taken}
            assert collections.Counter(r.doc_id for r in kept) == taken
        if name == "segmentation":
            assert all(r.decoded for r in kept) and len(kept) == 2 * len(before)
        else:
            assert after.columns == docs.columns and set(map(str, kept)) <= set(map(str, before))
        docs = after


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "test")
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, SMALL).collect()))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_stages_on_odd_rows(spark, documents):
    rows = [(None, None, None), (1, "", "s"), (2, "word " * 30_000, "s"), (3, "a b c d e f g", None), (3, "a b c d e f g", None)]
    docs = documents(rows, "'x' size", "7 taken", "'y' score", "'z' target", "'c' class")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SMALL), "test")
        if name != "segmentation":
            assert out.columns == docs.columns, name


def test_near_copies_keep_their_article(spark):
    """One article under many addresses, each with its own token and counter, beside pages that are all different."""
    article = "".join(f"<p>Paragraph {i} of the article that is served again and again.</p>" for i in range(6))
    notice = '<div class="box"><p>A short line that many pages of the host show.</p></div>'
    page = lambda i, body: (f'<html><head><meta name="csrf" content="{i * 7919}"></head><body>{notice}'  # noqa: E731
                            f'<article id="post-{17 if body is article else i}">{body}</article>'
                            f'<footer>page {i}</footer></body></html>')
    own = lambda i: "".join(f"<p>Words of page {i} number {j}, not on others.</p>" for j in range(4))
    rows = [(i, f"http://a.org/{i}", page(i, article if i % 2 else own(i))) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_templates.extract_articles(pages).collect()}
    whole = " ".join(f"Paragraph {i} of the article that is served again and again." for i in range(6))
    assert {got[i] for i in range(1, 40, 2)} == {whole}
    assert all(got[i] == " ".join(f"Words of page {i} number {j}, not on others." for j in range(4))
               for i in range(0, 40, 2))


def test_template_changes_texts_without_telling_tags(spark):
    """A repeated block of plain elements is found by its class and leaves every text."""
    page = lambda i: (f"<html><body><div><section>{'This line stands on every page of the host. '}</section>"  # noqa: E731
                      f"<div><p>Own text {i} of this page, which is long enough to be its article {i}.</p>"
                      f"<p>More own text {i * 31}.</p></div></div></body></html>")
    pages = spark.createDataFrame([(i, "http://b.org/x", page(i)) for i in range(30)],
                                  "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_templates.extract_articles(pages).collect()}
    assert all(got[i] == f"Own text {i} of this page, which is long enough to be its article {i}. More own text {i * 31}."
               for i in range(30))
    changed = sum(html_templates.article_text(page(i), set(), None) != got[i] for i in range(30))
    assert changed == 30
