"""Main text of pages of many shapes, by hand, and of all pages of a table by an independent reading of their markup."""

from __future__ import annotations

import re
from html import unescape

import pytest

from chunkloom.llm import html

LONG = "Some sentence of the article that is long enough to be read as such by anyone who sees it here, with twenty words."
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"

#: Markup, and the blocks of its main text.
SHAPES = {
    "no footer, last block": (f"{NAV}<article><h1>Title</h1><p>Some body text of the article goes on.</p></article>", ["Title", "Some body text of the article goes on."]),
    "lone paragraph": ("<article><p>Some body text of the article goes on.</p></article>", ["Some body text of the article goes on."]),
    "paragraphs in a div": (f"<div><p>{LONG}</p><p>{LONG}</p><p>{LONG} {LONG} {LONG} {LONG}</p></div>", [LONG, LONG, f"{LONG} {LONG} {LONG} {LONG}"]),
    "header class in an article": (f"<article><div class=\"article-header\"><h1>The title</h1></div><p>{LONG}</p></article><footer>End</footer>", ["The title", LONG]),
    "title with a header class": (f"<article><h1 class=\"post-header\">The title</h1><p>{LONG}</p></article>", ["The title", LONG]),
    "legal news": (f"<article><section class=\"legal-news\"><p>{LONG}</p></section></article><footer>x</footer>", [LONG]),
    "math": (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be true.</p></article>", ["Let x=2 be true."]),
    "button in a sentence": ("<article><p>Press <button>OK</button> to go on with it.</p></article>", ["Press OK to go on with it."]),
    "select in a form": (f"<article><p>{LONG}</p><form><select><option>One<option>Two</select></form></article>", [LONG]),
    "stray quote in a value": (f"<article><p title=it's>{LONG}</p><p title='a > b' data-x=\"<p>\">Second one.</p></article>", [LONG, "Second one."]),
    "stray quote as a name": (f"<article><p \"x>{LONG}</p></article>", [LONG]),
    "unquoted value with a slash": (f"<article><p>{LONG} <a href=/x/>More</a> of it.</p></article>", [f"{LONG} More of it."]),
    "comments and declarations": (f"<!DOCTYPE html><!-- a > b <p>no</p> --><article><!--> --><p>{LONG}</p><?php echo 1 ?></article><!-- open", ["-->", LONG]),
    "script with markup in it": (f"<article><script>var t='<p>no</p>';</script><p>{LONG}</p><style>p > a {{}}</style></article>", [LONG]),
    "script without an end": (f"<article><p>{LONG}</p></article><script>var t='<p>no</p>'", [LONG]),
    "entities": ("<article><p>Fish &amp; chips &lt;b&gt; &#233;&#x20ac;&nbsp;x &copy 1 &notit; &unknown;</p></article>", ["Fish & chips <b> é€ x © 1 ¬it; &unknown;"]),
    "white space": ("<article><p>\n  One\t two \r\n  three  </p>\n<p> \n </p><p>four</p></article>", ["One two three", "four"]),
    "line break": ("<article><p>One<br>two<br/>three<wbr>fold</p></article>", ["One two threefold"]),
    "unclosed paragraphs": (f"<article><p><b>{LONG}<br><p>Second.</p><p>Third.</article><footer>End", [LONG, "Second.", "Third."]),
    "inline elements": ("<article><p>O<b>n</b>e <i>two</i><span> three</span></p></article>", ["One two three"]),
    "stray end tags": (f"<article></b></div><p>{LONG}</i></p></p>tail</article>", [LONG, "tail"]),
    "lists": ("<article><ul><li>One<li>Two <a href=x>link</a></ul><dl><dt>T<dd>D</dl></article>", ["One", "Two link", "T", "D"]),
    "tables": ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", ["a", "b", "c"]),
    "header of an article": (f"<header>Site name</header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>Filed</footer></article>", ["Title", LONG]),
    "sidebar, advert, notice, form, comments": (
        f"<div class=cookie-notice>We use cookies.</div><article><p>{LONG}</p><div class='ad'>{LONG}</div><aside>{LONG}</aside><p>Then more.</p><form>Name: <input></form></article>"
        f"<section id=comments><h3>Comments</h3><article class=comment><p>{LONG}</p></article></section>",
        [LONG, "Then more."],
    ),
    "class with a quote and an entity": (f"<article><div class='x&quot;y'><p>{LONG}</p></div></article>", [LONG]),
    "main element": (f"<main><p>{LONG}</p><nav>Skip</nav><p>Short.</p></main><p>Outside.</p>", [LONG, "Short."]),
    "body of an article by property": (f"<div><p>Teaser.</p><div itemprop=articleBody><p>{LONG}</p><p>End.</p></div></div>", [LONG, "End."]),
    "hidden things": (f"<article><p hidden>no</p><template><p>no</p></template><noscript>no</noscript><svg><text>no</text></svg><p>{LONG}</p></article>", [LONG]),
    "no article, menu of links": (f"<ul><li><a>Home</a><li><a>About us</a></ul><h1>The title</h1><p>{LONG}</p><p>{LONG}</p><p>The end.</p>", ["The title", LONG, LONG, "The end."]),
    "no article, rights": (f"<h1>The title</h1><p>{LONG}</p><div>© 2020 The company</div>", ["The title", LONG]),
    "links in the article": (f"<article><p><a href=x>All of it is a link</a></p><p>{LONG}</p></article>", ["All of it is a link", LONG]),
    "cut off in a tag": (f"<article><p>{LONG}</p><p class=\"x", [LONG]),
    "lesser and greater": ("<article><p>1 < 2 and 3 > 2, a<3</p></article>", ["1 < 2 and 3 > 2, a<3"]),
    "bogus end tags": (f"<article><p>{LONG}</></3></p></article>", [LONG]),
    "upper case": (f"<ARTICLE><P CLASS=lead>{LONG}</P></ARTICLE><FOOTER>End</FOOTER>", [LONG]),
    "class names that only look alike": (f"<article><p class='adapt readers sharepoint commentary navy'>{LONG}</p></article>", [LONG]),
    "nothing": ("", []),
    "text alone": ("Just a line of text.", ["Just a line of text."]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(name):
    page, want = SHAPES[name]
    assert html.main_text(page) == "\n\n".join(want)


def test_labelled_blocks_are_judged_as_labelled():
    rows = html.labelled()
    assert len(rows) > 100 and len({tuple(r[:-1]) for r in rows if r[-1]} & {tuple(r[:-1]) for r in rows if not r[-1]}) == 0


def test_all_pages_of_the_table(spark, sf_dir):
    """The generated pages have one article of h1 and p; read here with nothing but their tags."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
        texts = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
        want[r["page_id"], r["url"]] = "\n\n".join(t for t in texts if t)
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()} and sum(map(bool, want.values())) >= 50


def test_extract_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, None, "<p>" + "word " * 50_000 + "</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.extract(pages).collect()), key=repr)
    assert [(g[0], g[1], g[3]) for g in got] == [(1, "u", 0), (1, "u", 0), (2, None, 249_999), (None, None, 0)]
    assert html.extract(pages.limit(0)).count() == 0
