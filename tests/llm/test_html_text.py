"""Main texts: pages of the table against a plain reading of their articles, hand-made pages, and strange markup."""

import random
import re
import time
from html import unescape

import pytest

from textloom.llm import html_text as h

from ..conftest import SF

SENTENCE = "The river that runs by the old town was for a long time the only way to bring goods from the coast to the hills of the north."
WORDLESS = "Kolme vanhaa venettä seisoo rannalla odottamassa kevään tuloa, mutta kukaan tästä kylästä lähtenyt enää kalastamaan merelle saakka."


def article(html):
    """What stands between the tags of the article, by the shape that the tables' pages have."""
    inner = re.search(r"<article>(.*?)(</article>|$)", html, re.DOTALL)[1]
    found = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in found if x)


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r["page_id"]: r for r in h.query(spark, SF).collect()}
    assert len(found) == len(rows) > 0
    for r in rows:
        out = found[r["page_id"]]
        assert out["text"] == article(r["html"]) and out["n_chars"] == len(out["text"]) and out["url"] == r["url"]


PAGES = {
    "<p>One &amp; two&nbsp;&eacute;&#x41;\n  three": "One & two éA three",
    f"<nav>a</nav><article><h1>T</h1><p>{SENTENCE}<p>Short.<div class='ad'>{SENTENCE}</div><p>End.</article><p>{SENTENCE}</p>": f"T\n\n{SENTENCE}\n\nShort.\n\nEnd.",
    f"<div class=content><h2>Head</h2><p>{SENTENCE}</p><p>So.</p></div><div><a href=x>one link after</a> <a href=y>another</a></div><p>Legal.</p>": f"Head\n\n{SENTENCE}\n\nSo.",
    f"<div id='cookie-consent'><p>{SENTENCE}</p></div><p>{SENTENCE}</p><section class='userComments'><p>{SENTENCE}</p></section>": SENTENCE,
    f"<article class=post><header><h1>Name</h1><p>{SENTENCE}</p></header><p>{WORDLESS}</p><form>{SENTENCE}</form><aside>{SENTENCE}</aside><footer>x</footer></article>": f"Name\n\n{WORDLESS}",
    f"<article>A</article><article class='comment'><p>{SENTENCE}</p></article>": "A",
    f"<div class='no-sidebar'><p>{SENTENCE} <span class='ad'>buy</span><button>Go</button>and <b>so</b> on.</p></div>": f"{SENTENCE} and so on.",
    f"<main><script>var a='</p><p>{SENTENCE}';</script><style>p>a{{}}</style><!-- <p>{SENTENCE} --><p title='a>b' data-x=\"class=ad\">Body</p><textarea>{SENTENCE}</textarea></main>": "Body",
    f"<p>{WORDLESS}</p>": "",
    f"<p>{SENTENCE}</p><p>{WORDLESS}</p><p>{SENTENCE}</p>": f"{SENTENCE}\n\n{SENTENCE}",
    f"<article><p>{SENTENCE}</p><h2>Read on</h2><ul><li><a href=1>First link</a><li><a href=2>Second link</a></ul></article>": SENTENCE,
    f"<article><noscript><p>{SENTENCE}</p></noscript><p hidden>{SENTENCE}</p><p style='display: none'>{SENTENCE}</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>": "one\n\ntwo\n\nc1\n\nc2\n\nc3",
    "<article>a < b and c <d unclosed": "a < b and c",
    "<article><p>x<script>never closed <p>y</article>": "x",
    "<article><p>a<!-- never closed <p>y</article>": "a",
    "<article><p>1<!-->2<!--->3<!doctype x><?php 4 ?></ 5>6</article>": "1236",
    "<title>T</title><article><template><p>t</p></template><p>cr\x1ca b\x0bc</p></article>": "cr a b c",
    "": "",
}


@pytest.mark.parametrize("html", PAGES)
def test_page(html):
    expect = PAGES[html]
    if html.startswith("<p>One"):  # a page without an article whose only block can't be decided
        assert h.blocks(html)[0].text == expect
    else:
        assert h.main_text(html) == expect


def test_rules_of_both_passes():
    found = h.classified(f"<p>Alone</p><p>{SENTENCE}</p><p>{WORDLESS}</p><p>Near</p><p>Short</p><h3>Title</h3><p>{SENTENCE}</p><p><a>{SENTENCE}</a></p><p>Tie</p>")
    assert [b.label for b in found] == ["good", "good", "bad", "bad", "bad", "good", "good", "bad", "bad"]


def test_odd_rows(spark):
    rows = [(1, None, None, "a", 1), (None, "", "u", None, 2), (3, f"<article>{SENTENCE * 3000}</article>", "v", "b", None), (3, f"<article>{SENTENCE * 3000}</article>", "v", "b", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string, n_chars int")
    out = h.extract(df)
    assert out.columns == ["page_id", "html", "url", "text", "n_chars", "text_", "n_chars_"]
    assert sorted((r["page_id"] or 0, r["text"] or "", r["text_"][:9], r["n_chars_"]) for r in out.collect()) == [(0, "", "", 0), (1, "a", "", 0), (3, "b", SENTENCE[:9], len(SENTENCE) * 3000), (3, "b", SENTENCE[:9], len(SENTENCE) * 3000)]
    assert h.extract(df.limit(0)).count() == 0
    assert {(r["page_id"], r["tag"], r["label"]) for r in h.page_blocks(df).collect()} == {(3, "article", "good")}


@pytest.mark.parametrize("part", ["<div>", "<div></section>", "<a <b", "<p>x", "<b class='", "<!--", "</", "<li>", "<a href=\"", "<script>", "&amp", "<td>", "<span class=ad>", "<article>"])
def test_linear_on_any_markup(part):
    start = time.time()
    h.main_text(part * 100_000)
    assert time.time() - start < 6


def test_random_markup_never_fails():
    r = random.Random(5)
    parts = ["<p>", "</p>", "<article>", "</article>", "<div class=ad>", "</div>", "<a>", "</a>", "text ", SENTENCE, "<", ">", "\"", "<li>", "<header>", "<h1>", "</h1>", "<span class=menu>", "</span>", "&lt;", "<br>", "<td>", "<tr>", "<!--", "-->", "<script>", "</script>"]
    for _ in range(2000):
        assert isinstance(h.main_text("".join(r.choices(parts, k=40))), str)
