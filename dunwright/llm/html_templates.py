"""HTML extraction by templates deduced from equivalence classes of tokens.

The tokens of a page are its elements (by path, class and id) and its text runs (by path and text).  A
token's occurrence vector says how often each page of the host has it; vectors are compared by sums of
page hashes, which combine before they are shuffled.  Tokens with equal vectors are an equivalence class.
Vectors go over the distinct pages of a host: copies of one page are one page.  The class of the page itself,
once on every page, is the skeleton of the host's template; a further class is valid when it has an element,
occurs at most once a page, on at least ``LEAST_PAGES`` distinct pages, however many the host has, and holds no
more than ``MOST_OWN`` of what those pages have as possible article text: it nests in the skeleton as an
optional part.  A class with more is an article that the host serves under many addresses, with an id, a date or a
counter that differs.  Texts of valid classes belong to the template, everything else is content of slots.

Containers are also tokens by place: the way from the root with number and count among like siblings, so that bare
``div`` elements are told apart, and lists of varying length have no place of their own.  The article is read from
the slots below a place that every page of the host shares and that holds most of the host's possible article text,
the deepest of these; ``article`` and ``main`` only decide between such places, and on pages without one.  Places
among like siblings count from ``LEAST_PAGES`` distinct pages on.  Parts that elements, roles, or whole class
or id tokens name as menus, headers, footers, sidebars, notices, adverts, forms or comments are left out.  Such
a token on or above a content element does not hide it for good (``article_text``).

Null and empty pages give an empty text; a null or odd URL belongs to the host ''.  Pages of any length are read
whole, repeated pages count once in every statistic and are all returned, extra columns are kept
(``text n_chars`` are replaced), empty tables give empty results.  A host with a third of all pages is no hot
task: statistics are combined, and pages meet their template by broadcast below ``BROADCAST_HOSTS`` hosts and
``BROADCAST_TEXTS`` template texts (counted, not assumed, numbers), else by host and salt.  A host with more than
``HOST_TEXTS`` template texts has no array of them: its pages' texts meet them by host, token and salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import small_batches, written
from .html_blocks import Element, blocks, places
from .registry import query
from .url_rules import host_and_path

LEAST_PAGES = 10        # distinct pages of a host before a repeated text can be part of its template
MOST_OWN = 0.8          # of its pages' possible article text, that a class may hold as a template part
MOST_TEXT = 0.7         # of the possible article text of the places all pages share, below the content's
BROADCAST_HOSTS = 10_000
BROADCAST_TEXTS = 1_000_000  # most template texts (8 bytes each) that are broadcast
HOST_TEXTS = 2_000      # most template texts that travel beside a page
BROADCAST_REPEATS = 100_000  # pages with copies whose digests are broadcast, checked by a count
SALTS = 32
_LEVEL = 1_000_000  # more than any depth that tells places apart


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(),
                          "big", signed=True)


def _element(role: str) -> int:
    return _number("e" + role)


def _text(role: str, text: str) -> int:
    return _number(f"t{role}\n{text}")


def page_tokens(html: str) -> dict[int, list]:
    """Token to [count, is element, depth, characters of possible article text in or below it, role].

    Places of containers are tokens too: their roles begin with ``@1`` (no like siblings) or ``@2``, and their
    depths with what the tag says of content.
    """
    runs, elements = blocks(html)
    out: dict[int, list] = {0: [1, False, 0, 0, ""]}
    numbers: dict[str, int] = {}
    found = places(elements)
    for e in elements:
        if e.role not in numbers:
            numbers[e.role] = _element(e.role)
        entry = out.setdefault(numbers[e.role], [0, True, e.depth, 0, e.role])
        entry[0] += 1
    spots = {e: _number(f"p{place}") for e, (place, _) in found.items()}
    for e, (place, alone) in found.items():
        out[spots[e]] = [1, True, e.content * _LEVEL + min(e.depth, _LEVEL - 1), 0, f"@{1 if alone else 2}{place}"]
    for e, text in runs:
        own = out.setdefault(_text(e.role, text), [0, False, 0, 0, ""])
        own[0] += 1
        if not (e.boilerplate or e.header):
            own[3] += len(text)
            out[0][3] += len(text)
            up = e
            while up is not None and up.role in numbers:
                out[numbers[up.role]][3] += len(text)
                if up in spots:
                    out[spots[up]][3] += len(text)
                up = up.parent
    return out


_STATISTICS = ("host string, token bigint, element boolean, depth int, role string, pages bigint, "
               "total bigint, once boolean, chars bigint, page_chars bigint, sum_1 bigint, sum_2 bigint")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, host and token: sums over pages; vectors as two 31-bit sums of page hashes."""
    for batch in batches:
        held: dict[tuple, list] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            digest = hashlib.blake2b((html or "").encode("utf-8", "surrogatepass"), digest_size=8).digest()
            key = int.from_bytes(digest, "big")
            tokens = page_tokens(html or "")
            page_chars = tokens[0][3]
            for token, (n, element, depth, chars, role) in tokens.items():
                row = held.get((host, token))
                if row is None:
                    row = held[host, token] = [element, depth, role, 0, 0, True, 0, 0, 0, 0]
                mixed = (key * 0x9E3779B97F4A7C15 + n * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
                row[3] += 1
                row[4] += n
                row[5] &= n == 1
                row[6] += chars
                row[7] += page_chars
                row[8] += mixed >> 33
                row[9] += (mixed & (1 << 33) - 1) >> 2
        rows = [(host, token, *row) for (host, token), row in held.items()]
        columns = list(zip(*rows)) or [[]] * 12
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.int64(),
                 pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in _STATISTICS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def distinct_pages(pages: DataFrame, broadcast_repeats: int = BROADCAST_REPEATS) -> DataFrame:
    """(host, html) without repeats; null and empty pages are one.  Only pages with copies are shuffled."""
    keyed = pages.selectExpr("host", "coalesce(html, '') html").selectExpr("*", "md5(html) digest")
    repeated = written(keyed.groupBy("host", "digest").agg(F.expr("count(1) copies")).filter("copies > 1")
                       .select("host", "digest"), "repeated")
    one = lambda df: df.groupBy("host", "digest").agg(F.expr("first(html) html")).select("host", "html")
    if repeated.count() > broadcast_repeats:
        return one(keyed)
    digests = F.broadcast(repeated)
    return keyed.join(digests, ["host", "digest"], "left_anti").select("host", "html").union(
        one(keyed.join(digests, ["host", "digest"], "left_semi")))


def deduce_templates(pages: DataFrame, host_texts: int = HOST_TEXTS,
                     broadcast_repeats: int = BROADCAST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(host, html) to one row per host (host, n_texts, texts, content), and all template texts (host, token).

    ``texts`` is null when a host has more than ``host_texts`` of them; ``content`` is a place.
    """
    sums = distinct_pages(pages, broadcast_repeats).mapInArrow(_statistics, _STATISTICS).groupBy(
        "host", "token", "element").agg(*[F.expr(e) for e in (
            "min(depth) depth", "first(role) role", "sum(pages) pages", "sum(total) total",
            "bool_and(once) once", "sum(chars) chars", "sum(page_chars) page_chars", "sum(sum_1) sum_1",
            "sum(sum_2) sum_2")])
    sums = written(sums.filter(f"token = 0 or element or pages >= {LEAST_PAGES}"), "tokens")
    hosts = sums.filter("token = 0").selectExpr(
        "host", "pages all_pages", "sum_1 all_1", "sum_2 all_2", "total all_total")
    known = sums.filter("token <> 0").join(hosts, "host")
    skeleton = "sum_1 = all_1 and sum_2 = all_2 and pages = all_pages and total = all_total"
    content = known.filter(f"role like '@%' and chars > 0 and {skeleton}").filter(
        f"role like '@1%' or all_pages >= {LEAST_PAGES}")
    most = content.groupBy("host").agg(F.expr("max(chars) most"))
    content = content.join(most, "host").filter(f"chars >= {MOST_TEXT} * most").groupBy("host").agg(
        F.expr("substr(max(struct(depth, chars, role)).role, 3) content"))
    classes = ["host", "pages", "sum_1", "sum_2"]
    possible = known.filter(f"role not like '@%' and once and pages >= {LEAST_PAGES}")
    nested = possible.groupBy(*classes).agg(
        F.expr("bool_or(element) nested"), F.expr("count_if(not element) texts"),
        F.expr("sum(if(element, 0, chars)) own"), F.expr("max(page_chars) page_chars")) \
        .filter(f"nested and texts > 0 and own <= {MOST_OWN} * page_chars").select(*classes)
    tokens = written(possible.filter("not element").join(nested, classes, "left_semi").select("host", "token"),
                     "template-texts")
    counts = tokens.groupBy("host").agg(F.expr("count(1) n_texts"))
    few = tokens.join(counts.filter(f"n_texts <= {host_texts}"), "host", "left_semi").groupBy("host").agg(
        F.expr("collect_list(token) texts"))
    found = hosts.select("host").join(content, "host", "left").join(counts, "host", "left").join(few, "host", "left")
    return found.selectExpr(
        "host", "coalesce(n_texts, 0) n_texts",
        "if(n_texts is null, cast(array() as array<bigint>), texts) texts", "content"), tokens


def _marked_content(elements: list[Element], others: bool) -> set[Element]:
    """Content elements that only words mark, those with the fewest marks; ``others``: of other articles too."""
    found = [e for e in elements if e.content and e.words and not e.certain and (others or not e.others)]
    least = min((e.words for e in found), default=0)
    level = max((e.content for e in found if e.words == least), default=0)
    return {e for e in found if e.words == least and e.content == level}


def _below(e: Element, roots: set[Element]) -> Element | None:
    while e is not None and e not in roots:
        e = e.parent
    return e


def _plain(runs: list[tuple[Element, str]], elements: list[Element],
           slot: set[Element]) -> tuple[set[Element], list[bool]]:
    """Content elements, and for each run whether it is article text; within ``slot`` unless this is empty.

    Without a slot, content elements decide; within one they tell its article from what else it holds.
    """
    inside = [e for e in elements if e.content and not e.boilerplate and (not slot or _below(e, slot))]
    level = max((e.content for e in inside), default=0)
    roots = {e for e in inside if e.content == level}
    return roots, [not e.boilerplate and (
        _below(e, roots) is not None if roots else not e.header and (not slot or _below(e, slot) is not None))
        for e, _ in runs]


def article_text(html: str, texts: set[int], content: str | None) -> str:
    """The article of one page, given its host's template.

    What lies below an element that words mark is left out, except content elements: when they have more
    text than the page has without them, or no other content element is there, they are the article or a
    part of it.  Those of comments, adverts and related articles are it only when there is no other text.
    """
    runs, elements = blocks(html)
    runs = [(e, text) for e, text in runs if not e.certain and _text(e.role, text) not in texts]
    slot = {e for e, (place, _) in places(elements).items() if place == content} if content else set()
    roots, plain = _plain(runs, elements, slot)
    if slot and not any(plain):  # nothing in the host's slot: read the page as one without a template
        roots, plain = _plain(runs, elements, set())
    held = sum(len(text) for (_, text), p in zip(runs, plain) if p)
    for others in (False, True):
        marked = _marked_content(elements, others)
        if not marked or (others and held):
            continue
        tops = [_below(e, marked) for e, _ in runs]
        opened = [top is not None and e.words == top.words for (e, _), top in zip(runs, tops)]
        more = sum(len(text) for (_, text), o in zip(runs, opened) if o)
        if not more or (roots and more <= held):
            continue
        if not roots and more >= held:
            plain = opened
        else:
            plain = [p or o for p, o in zip(plain, opened)]
        held += more
    return " ".join(text for (_, text), p in zip(runs, plain) if p)


def _run_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, html) to page, host and the distinct tokens of its text runs."""
    for batch in batches:
        for page, host, html in zip(*(batch.column(c).to_pylist() for c in ("page", "host", "html"))):
            found = list({_text(e.role, text) for e, text in blocks(html or "")[0]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([page] * len(found), pa.string()), pa.array([host] * len(found), pa.string()),
                 pa.array(found, pa.int64())], ["page", "host", "token"])


def _own_texts(met: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages of hosts with large templates, with those template texts that they have themselves."""
    pages = written(met.drop("_texts").selectExpr("*", "uuid() _page"), "large-template-pages")
    runs = pages.selectExpr("_page page", "_host host", "html").mapInArrow(
        _run_tokens, "page string, host string, token bigint").selectExpr("*", f"pmod(xxhash64(page), {SALTS}) salt")
    salted = tokens.selectExpr("host", "token", f"explode(sequence(0L, {SALTS - 1}L)) salt")
    own = runs.join(salted, ["host", "token", "salt"], "left_semi").groupBy("page").agg(
        F.expr("collect_list(token) _texts"))
    return pages.join(own, F.expr("_page = page"), "left").drop("page", "_page")


def extract_articles(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS,
                     host_texts: int = HOST_TEXTS) -> DataFrame:
    """Append text and n_chars to every row (columns url and html)."""
    small_batches(pages.sparkSession, 200)
    own = pages.drop("text", "n_chars")
    placed = own.selectExpr("*", f"{host_and_path('url')['host']} _host")
    templates, tokens = deduce_templates(placed.selectExpr("_host host", "html"), host_texts)
    templates = written(templates.selectExpr(
        "host _site", "n_texts _n_texts", "texts _texts", "content _content"), "templates")
    hosts, texts, largest = templates.agg(
        F.expr("count(1)"), F.expr(f"coalesce(sum(if(_n_texts <= {host_texts}, _n_texts, 0)), 0)"),
        F.expr("coalesce(max(_n_texts), 0)")).first()
    if hosts <= broadcast_hosts and texts <= BROADCAST_TEXTS:
        met = placed.join(F.broadcast(templates), F.expr("_host = _site"), "left")
    else:
        salted = placed.selectExpr("*", f"pmod(xxhash64(url, html), {SALTS}) _salt")
        wanted = salted.selectExpr("_host _site", "_salt _part").distinct()
        met = salted.join(wanted.join(templates, "_site"),
                          F.expr("_host = _site and _salt = _part"), "left").drop("_salt", "_part")
    kept = own.columns
    needed = [*kept, "_texts", "_content"]
    if largest > host_texts:
        large = _own_texts(met.filter("_texts is null"), tokens).select(needed)
        met = met.filter("_texts is not null").select(needed).unionByName(large)
    else:
        met = met.select(needed)
    schema = T.StructType([*own.schema.fields, T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article_text(html or "", set(texts or ()), content) for html, texts, content in zip(
                *(batch.column(c).to_pylist() for c in ("html", "_texts", "_content")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(found, pa.string()),
                                                   pa.array([len(t) for t in found], pa.int64())],
                [*kept, "text", "n_chars"])

    return met.mapInArrow(run, schema)


@query("op9_html_extraction")
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return extract_articles(pages).select("page_id", "url", "text", "n_chars")
