"""Main text of web pages: flat text blocks judged by a small decision tree.

A page becomes a flat list of blocks. A block's features are its own and its neighbours' word counts and link densities, and where it
stands: in an element or a container named as boilerplate, in the page's article, as a heading, among form controls. No feature decides by
itself: the tree (Gini, exact splits) is grown on the blocks of ``LABELLED``, a few small pages labelled block by block, and is the same in
every worker. Tags and attributes are read as browsers read them.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

#: Of a block: in an aside element; in a container with a name of boilerplate (1: an ambiguous one); outside of the page's article, on a page
#: without one, or inside (0, 1, 2); share of words in form controls; says whose rights it is; heading; words and link density, also of neighbours.
FEATURES = ("aside", "named", "place", "controls", "rights", "density", "words", "heading", "density_before", "density_after", "words_before", "words_after")

#: Pages by hand, each block labelled: [1] is main text, [0] isn't; {n} stands for n words.
LABELLED = (
    # articles between menus, with and without anything after them
    "<nav><ul><li>[0]<a>{1}</a><li>[0]<a>{2}</a></ul></nav><div class='ad'>[0]{9}</div><article><h1>[1]{6}</h1><p>[1]{40}</p><p>[1]{3}</p><p>[1]{80}</p></article><footer>[0]{5}</footer>",
    "<header>[0]<a>{2}</a></header><article><h1>[1]{9}</h1><p>[1]{33}</p><p>[1]{2}</p></article>",
    "<article>[1]{12}</article>",
    "<article><p>[1]{1}</p></article><footer>[0]<a>{2}</a> {4}</footer>",
    "<article><h2>[1]{2}</h2></article><aside><h3>[0]{2}</h3><p>[0]{45}</p></aside>",
    "<div>[0]{14}</div><article><p>[1]<a>{6}</a></p><ul><li>[1]<a>{3}</a><li>[1]{2}<li>[1]<a>{8}</a> {2}</ul><p>[1]{150}</p></article><div>[0]{7}</div>",
    "<p>[0]{30}</p><main><p>[1]{9}</p><p>[1]<a>{4}</a> {1}</p><div class='sidebar'>[0]{70}</div></main><p>[0]<a>{3}</a></p><p>[0]{24}</p>",
    "<div>[0]{3}</div><article><p>[1]{20}</p><blockquote>[1]{15}</blockquote><pre>[1]{60}</pre><p>[1]{11}</p></article><div>[0]{2}</div>",
    # headers of articles, ambiguous names inside of them, boilerplate inside of them
    "<div class='header'>[0]{5}</div><article><header><h1>[1]{7}</h1><p>[1]{4}</p></header><p>[1]{60}</p><div class='share'>[0]{2}</div><p>[1]{50}</p><aside>[0]{18}</aside></article>",
    "<article><div class='header'><h1>[1]{8}</h1></div><section class='notice'><p>[0]{12}</p></section><p>[1]{44}</p><div class='alert'>[0]{6}</div></article><section class='comments'><h2>[0]{1}</h2><p>[0]{35}</p><p>[0]{8}</p></section>",
    "<article><p>[1]{70}</p><form><p>[0]{4}</p></form><nav>[0]<a>{9}</a></nav><p>[1]{5}</p><div class='newsletter'>[0]{13}</div><p>[1]{31}</p><footer>[0]{16}</footer></article>",
    "<article><p>[1]{25}</p><button>[0]{1}</button><p>[1]{6} <button>{1}</button> {5}</p><p>[1]{14}</p><p><button>[0]{3}</button></p></article>",
    "<article><h1>[1]{5}</h1><div class='ads'>[0]{120}</div><p>[1]{2}</p><div class='related'>[0]<a>{7}</a></div><div class='comment'>[0]{90}</div></article>",
    # pages without an article
    "<ul><li>[0]<a>{1}</a><li>[0]<a>{3}</a><li>[0]<a>{2}</a></ul><h1>[1]{7}</h1><div>[1]{64}</div><div>[1]{71} <a>{3}</a></div><p>[1]{18}</p><p>[1]{4}</p>",
    "<div>[0]<a>{2}</a> <a>{1}</a></div><div>[1]{30}</div><div>[1]{45}</div><div>[1]{38}</div>",
    "<p>[1]{12}</p>", "<h1>[1]{3}</h1>", "<div>[1]{1}</div>", "<p>[1]{90}</p><p>[1]{6}</p><p>[1]{9}</p><p>[1]{5}</p>",
    "<div>[0]<a>{1}</a></div><h2>[1]{2}</h2><p>[1]{22}</p><ul><li>[1]{3}<li>[1]{5}<li>[1]{2}</ul><p>[1]{16} <a>{2}</a></p><div class='footer'>[0]{5}</div>",
    "<h1>[1]{5}</h1><p>[1]{2}</p><p>[1]{48}</p><div>[0]&copy; {4}</div>", "<p>[1]{55}</p><p>[0]Copyright {6}</p><p>[0]<a>{2}</a> {1} <a>{3}</a></p>",
    "<div class='menu'><h3>[0]{1}</h3><p>[0]{3}</p></div><div class='header'>[0]{4}</div><p>[1]{39}</p><div class='legal'>[0]{20}</div><div class='cookie'>[0]{28}</div>",
    "<div>[0]<a>{5}</a></div><div>[0]<a>{6}</a> {1}</div><div>[1]{26}</div><div>[1]{9} <a>{4}</a></div><div>[0]<a>{4}</a></div>",
    "<article><p>[1]{29}</p><p>[1]Copyright {3}</p><p>[1]All rights reserved</p></article><p>[0]All rights reserved</p>", "<article><p>[1]&copy; {8}</p><ul><li>[1]<a>{2}</a></ul></article><div>[0]&copy; {2}</div>",
    # told by their neighbours: headings and labels of link lists, links between paragraphs
    "<p>[1]{60}</p><p>[1]{42}</p><h3>[0]{2}</h3><ul><li>[0]<a>{4}</a><li>[0]<a>{5}</a></ul>", "<p>[1]{50}</p><p>[1]<a>{3}</a></p><p>[1]{40}</p><h2>[1]{3}</h2><p>[1]{35}</p>",
    "<div>[0]{1}</div><div>[0]<a>{1}</a></div><div>[0]{2}</div><div>[0]<a>{2}</a></div><p>[1]{70}</p><p>[1]{28}</p>", "<h2>[0]{1}</h2><div>[0]<a>{2}</a></div><div>[0]<a>{1}</a></div><h1>[1]{4}</h1><p>[1]{33}</p>",
    "<article><h2>[1]{2}</h2><ul><li>[1]<a>{3}</a><li>[1]<a>{1}</a></ul><p>[1]{1}</p><ul><li>[1]<a>{2}</a></ul></article>",
    "<div class='search'>[0]{2}</div><table><tr><td>[1]{2}<td>[1]{1}<tr><td>[1]{3}<td>[1]{1}</table><p>[1]{13}</p><label>[0]{2}</label>",
)

#: Elements whose text no page shows, those that hold raw text, and those that stand beside an article.
HIDDEN = frozenset("script style noscript template svg iframe object canvas head title datalist noembed noframes audio video".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTROLS = frozenset("button select option optgroup textarea label".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption section article main header footer nav aside form fieldset blockquote pre figure figcaption address body html hr details summary dialog menu center legend".split())
#: Elements that end an open one of their own group, up to the element that holds them.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table thead tbody tfoot".split())
#: Parts of class names and ids. CLEAR ones name boilerplate wherever they stand; UNSURE ones only beside words of PLAIN.
CLEAR = re.compile(r"ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|submenu|breadcrumbs?|sidebars?|footers?|masthead|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|sharebar|social|related|recommend\w*|comments?|commentlist|disqus\w*|replies|respond|widgets?|pagination|pager|toolbar|paywall")
UNSURE = re.compile(r"header|banner|side|aside|notices?|alerts?|search\w*|login|legal|copyright|disclaimer|tags|skip|reply|form")
PLAIN = re.compile(r"site|page|main|global|web|top|bottom|left|right|box|bar|block|area|wrap|wrapper|container|inner|outer|row|col|list|item|items|link|links|section|content|text|message|info|the|my|\d*")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
#: An attribute: a name and perhaps a value, which is quoted or ends at white space.
ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+"""
ATTRIBUTES = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+""")
#: A comment, a declaration or another thing that browsers skip, or a tag, which the page's end ends too.
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:[^a-zA-Z>][^>]*+)?(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)(?:>|\Z)", re.S)


class Block(NamedTuple):
    text: str
    words: int
    density: float
    controls: float
    aside: int
    named: int
    inside: int
    heading: int


class Place(NamedTuple):
    """What an open element makes of the text in it; inside: 2 in an article, 1 in the main element."""

    name: str = ""
    hidden: int = 0
    aside: int = 0
    named: int = 0
    inside: int = 0
    heading: int = 0


def naming(value: str) -> int:
    """2 if a class name or id names boilerplate, 1 if it may."""
    found = 0
    for token in value.split():
        parts = [p.lower() for p in re.split(r"[-_:]+|(?<=[a-z])(?=[A-Z])", token) if p]
        if any(map(CLEAR.fullmatch, parts)):
            return 2
        if any(map(UNSURE.fullmatch, parts)) and all(UNSURE.fullmatch(p) or PLAIN.fullmatch(p) for p in parts):
            found = 1
    return found


def opened(name: str, attributes: str, above: Place) -> Place:
    hidden, aside, named, inside = above.hidden or int(name in HIDDEN), above.aside, above.named, above.inside
    if name in ASIDE and not (name == "header" and inside and not aside):
        aside = 1
    if name in ("article", "main"):
        inside = max(inside, 2 if name == "article" else 1)
    if attributes and name not in ("body", "html"):
        for key, *values in ATTRIBUTES.findall(attributes):
            key, value = key.lower(), unescape("".join(values))
            if key == "hidden":
                hidden = 1
            elif key == "role":
                named = max(named, 2 * (value.lower() in ROLES))
                inside = max(inside, {"article": 2, "main": 1}.get(value.lower(), 0))
            elif key in ("class", "id") and name not in ("article", "main"):
                named = max(named, naming(value))
            elif key == "itemprop" and value == "articleBody":
                inside = 2
    return Place(name, hidden, aside, named, inside, above.heading or int(len(name) == 2 and name[0] == "h" and name[1].isdigit()))


def blocks(page: str) -> list[Block]:
    """The blocks that have text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    pressed: list[str] = []
    stack = [Place()]
    state, at = stack[0], 0

    def flush() -> None:
        if parts:
            words = unescape("".join(parts)).split()
            if words:
                n = len(words)
                count = lambda some: min(1.0, len(unescape(" ".join(some)).split()) / n)
                out.append(Block(" ".join(words), n, count(linked), count(pressed), state.aside, state.named, state.inside, state.heading))
            parts.clear()
            linked.clear()
            pressed.clear()

    def text(x: str) -> None:
        if x and not state.hidden:
            parts.append(x)
            if in_link:
                linked.append(x)
            if in_control:
                pressed.append(x)

    def closed(k: int) -> None:
        """Closes the elements from the k-th on; the same block goes on unless that ends blocks or changes where it stands."""
        if any(x.name in BLOCK for x in stack[k:]) or stack[-1][2:5] != stack[k - 1][2:5]:
            flush()
        del stack[k:]

    in_link = in_control = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in ("br", "wbr"):
            text(" " if name == "br" else "")
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
        if name in BLOCK:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    closed(k)
                    break
                if name not in BLOCK and stack[k].name in BLOCK:
                    break  # a stray inline end doesn't close blocks
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if name not in HIDDEN:
                stack.append(opened(name, m[3], stack[-1]))
                state, in_control = stack[-1], in_control or name in CONTROLS
                text(body)
                stack.pop()
        elif name not in VOID:
            if name in BLOCK:
                for k in range(len(stack) - 1, 0, -1):  # what ends an open paragraph, or its own kind, even where the page forgot to
                    if stack[k].name == "p":
                        closed(k)
                        break
                    if stack[k].name in BLOCK:
                        break
            for k in range(len(stack) - 1, 0, -1) if name in ENDS else ():
                if stack[k].name in HOLDS and not (name == "tr" and stack[k].name == "tr"):
                    break
                if stack[k].name in ENDS[name]:
                    closed(k)
                    if name != "tr":
                        break
            place = opened(name, m[3], stack[-1])
            if place[2:5] != stack[-1][2:5]:
                flush()
            stack.append(place)
        state = stack[-1]
        in_control = any(x.name in CONTROLS for x in stack)
    text(page[at:])
    flush()
    return out


def features(found: list[Block]) -> list[tuple]:
    """In the order of FEATURES."""
    most = max((b.inside for b in found if not b.aside and b.named < 2), default=0)
    rows = []
    for k, b in enumerate(found):
        before = found[k - 1] if k else None
        after = found[k + 1] if k + 1 < len(found) else None
        near = [x for d in ("density", "words") for x in (getattr(before, d, 0), getattr(after, d, 0))]
        rows.append((b.aside, b.named, 1 if not most else 2 if b.inside >= most else 0, b.controls, int(RIGHTS.match(b.text) is not None), b.density, b.words, b.heading, *near))
    return rows


def labelled() -> list[tuple]:
    """The features of the blocks of LABELLED, each with its label."""
    rows = []
    for page in LABELLED:
        found = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), page))
        assert all(b.text[:3] in ("[0]", "[1]") for b in found)
        rest = [b._replace(text=b.text[3:]) for b in found]
        rows += [(*row, int(b.text[1])) for row, b in zip(features(rest), found)]
    return rows


def _grow(rows: list[tuple], depth: int) -> tuple | int:
    """A leaf (0 or 1) or (feature, threshold, tree at most, tree above); ties: the first feature, the lowest threshold."""
    good, n = sum(r[-1] for r in rows), len(rows)
    if not depth or good in (0, n):
        return int(2 * good > n)

    def gini(part: list[tuple]) -> float:
        ones = sum(r[-1] for r in part)
        return len(part) - (ones * ones + (len(part) - ones) ** 2) / len(part)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            cost = gini([r for r in rows if r[f] <= cut]) + gini([r for r in rows if r[f] > cut])
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, cut
    if best is None:
        return int(2 * good > n)
    _, f, cut = best
    return f, cut, _grow([r for r in rows if r[f] <= cut], depth - 1), _grow([r for r in rows if r[f] > cut], depth - 1)


@lru_cache(1)
def tree() -> tuple | int:
    return _grow(labelled(), 10)


def main_text(page: str) -> str:
    found = blocks(page)
    kept = []
    for block, row in zip(found, features(found)):
        node = tree()
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(block[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text. Rows are judged one by one, so repeated rows, null ids and
    urls and extra columns change nothing. A narrow map: no shuffle.
    """

    def make():
        def work(part: pa.RecordBatch):
            texts = [main_text(x or "") for x in part.column(2).to_pylist()]
            yield {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": list(map(len, texts))}

        return work

    return batches(pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")), "page_id long, url string, text string, n_chars long", make)
