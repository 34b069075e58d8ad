"""Reading one HTML page: its elements, their roles and the text below them."""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

# Elements without content, with raw content, inside a line, and those that end others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark
    q s samp small span strike strong sub sup time tt u var""".split())
ENDS_PARAGRAPH = frozenset("""address article aside blockquote details dialog dd div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table
    ul""".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("table ul ol dl article section div body html main aside nav footer header td th".split())

# Elements, roles, and class and id tokens that mark what is not the article.  A token marks when
# all of its parts are such words ('cookie-notice', not 'has-sidebar').
BOILERPLATE_TAGS = frozenset("""head nav aside footer form script style noscript template iframe button
    select textarea dialog menu svg math title""".split())
BOILERPLATE_ROLES = frozenset("""navigation banner complementary contentinfo search form dialog
    alert alertdialog menu menubar toolbar""".split())
BOILERPLATE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox sponsor sponsored
    promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe signup sidebar sidenav menu menus nav navbar navigation topnav breadcrumb breadcrumbs
    footer masthead topbar comment comments commentlist respond reply replies disqus share sharing social
    related recommended widget widgets toolbar pagination pager login search""".split())
# Of these, words whose articles are not the page's own; below the others a layout may hold the article.
OTHERS_WORDS = frozenset("""ad ads advert adverts advertisement advertising adbox sponsor sponsored promo
    promotion comment comments commentlist respond reply replies disqus related recommended""".split())
# Elements that may hold the article, and those of them that tell nothing by their tag.
CONTAINERS = frozenset("html body main article section div center td table tbody tr".split())
NEUTRAL = frozenset("section div center td".split())
HEADER_WORDS = frozenset(["header", "siteheader", "pageheader"])

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""",
                        re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "role", "parent", "boilerplate", "certain", "words", "others", "header", "content",
                 "depth", "label")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        found = {}
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), unescape(a or b or c).lower())
        label = " ".join(sorted(found.get("class", "").split())) + "#" + found.get("id", "")
        self.label = f"{tag}.{_DIGITS.sub('', label)}"
        self.depth = parent.depth + 1 if parent else 0
        self.role = f"{parent.role if parent else ''}/{tag}.{label}"
        tokens = [_WORD.findall(t) for t in f"{found.get('class', '')} {found.get('id', '')}".split()]
        self.content = 3 if tag == "article" else 2 if tag == "main" or found.get("role") == "main" \
            else 1 if found.get("itemprop") == "articlebody" else 0
        named = [] if tag in ("html", "body") else [t for t in tokens if t and BOILERPLATE_WORDS.issuperset(t)]
        # marked by an element or role; number of elements from the root that words mark
        self.certain = (tag in BOILERPLATE_TAGS or found.get("role") in BOILERPLATE_ROLES
                        or bool(parent and parent.certain))
        self.words = (parent.words if parent else 0) + bool(named)
        self.others = any(not OTHERS_WORDS.isdisjoint(t) for t in named) or bool(parent and parent.others)
        self.boilerplate = self.certain or self.words > 0
        self.header = tag == "header" or any("".join(t) in HEADER_WORDS for t in tokens) or bool(
            parent and parent.header and not self.content)


def blocks(html: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """(element, text) runs in page order, and all elements.

    A run is the text between two block boundaries, markup inside a line removed, references decoded,
    white space turned into single spaces and trimmed; its element is the innermost block element.
    Unclosed and misnested elements end where browsers end them, as far as blocks are concerned.
    """
    root = Element("", "", None)
    stack, seen, out, line = [root], [], [], []

    def flush() -> None:
        if line:
            text = _SPACE.sub(" ", unescape("".join(line))).strip()
            line.clear()
            if text:
                owner = next(e for e in reversed(stack) if e.tag not in INLINE)
                marked = next((e for e in reversed(stack) if e.boilerplate), None)
                out.append((stack[-1] if marked is not None and not owner.boilerplate else owner, text))

    def pop_to(tags: set[str] | frozenset[str], bounds: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            line.append(html[at:])
            break
        line.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                inner = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag not in INLINE
                              or stack[k].tag == tag), 0)
                if stack[inner].tag == tag:
                    if stack[inner].boilerplate != stack[inner - 1].boilerplate:
                        flush()
                    del stack[inner:]
            elif tag == "br":
                line.append(" ")
            else:
                flush()
                pop_to({tag})
            continue
        if tag == "br":
            line.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag not in ("wbr", "img", "input"):
                line.append("")
            continue
        if tag in ENDS_PARAGRAPH:
            flush()
            pop_to({"p"}, BOUNDS)
        if tag in SIBLINGS:
            pop_to(SIBLINGS[tag], BOUNDS - {"td", "th"} if tag == "tr" else BOUNDS - SIBLINGS[tag])
        element = Element(tag, m[3], stack[-1])
        if tag not in INLINE:
            flush()
        elif element.boilerplate and not stack[-1].boilerplate:
            flush()
        seen.append(element)
        if tag in RAW:  # content is not markup; what it holds is never article text
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(element)
    flush()
    return out, seen


def places(elements: list[Element]) -> dict[Element, tuple[str, bool]]:
    """Containers to their place: the way from the root, with number and count among like siblings.

    Like siblings agree in tag, class and id without digits and, where the tag tells nothing, in the tag of their
    first block.  A place that all pages of a host share is thus one of a fixed number: lists whose length varies
    share none.  The second value says whether all elements on the way are the only ones of their kind.
    """
    first: dict[Element, str] = {}
    for e in elements:
        if e.tag not in INLINE:
            first.setdefault(e.parent, e.tag)
    kinds: dict[tuple, list[Element]] = {}
    for e in elements:
        if e.tag in CONTAINERS:
            shape = first.get(e, "") if e.tag in NEUTRAL else ""
            kinds.setdefault((e.parent, e.label, shape), []).append(e)
    number = {e: (f"{label}>{shape}[{i}/{len(like)}]", len(like) == 1)
              for (_, label, shape), like in kinds.items() for i, e in enumerate(like)}
    out: dict[Element, tuple[str, bool]] = {}
    for e in elements:  # parents come first
        if e not in number:
            continue
        if e.parent.parent is None:
            above, alone = "", True
        elif e.parent in out:
            above, alone = out[e.parent]
        else:
            continue
        here, only = number[e]
        out[e] = blake2b(f"{above}/{here}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest(), alone and only
    return out
