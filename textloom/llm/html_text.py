"""Main text of web pages by two-pass block rules.

A page is cut into blocks: runs of text between block-level tags. First pass, each block by itself: in a boilerplate container
(menus, headers (but for the headings in an article's own), footers, asides, forms, scripts, hidden parts, or a class, id or role that names such a part, an advert, a
notice or reader comments) it is none of the article; else link density, length and the share of stop words (of the
page's language) decide between good and bad, and leave the rest open: short blocks, headings, and those that lie between
the two bounds. In a page with an article or main element, what lies outside of it is bad, and what lies in it is bad by link
density alone, as an article's sentences may be short or strange. Second pass: an open block takes the label of the nearest
decided block, of two equally near ones that in the same parent element, else the
good one within an article and the bad one elsewhere; a heading takes that of the next
decided block, if there is any. Boilerplate in the midst of an article decides nothing for its neighbours. Where nothing is
decided, blocks in an article are good, others bad.

The text is that of the good blocks in page order with two \\n between: character references decoded, white space inside a
block made one space, trimmed. Nothing is dropped for its length.

Tags are read as browsers do: quoted attributes may hold `>`, scripts and styles end at their own end tag, comments at
`-->`, what is never closed ends with the page; p, li, cells and the like close one another.

Defined cases: a null or empty page gives an empty text; a null page_id or url stays null; rows that repeat are extracted alike;
an empty table gives an empty result; other columns pass through `extract` whatever their names (its own two columns are
named anew if they clash) and are left out by the query.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh_names, map_rows

LONG = 70  # characters from which a block can be decided by its words
GOOD = 0.25  # share of stop words from which a long block is good
BAD = 0.1  # share of stop words below which a long block outside an article is bad
LINKED = 0.35  # share of characters in links from which a block is bad

# Frequent function words of languages that share the Latin script, and the names that pages give to their parts.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you",
    "de": "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind und von war werden wie wir zu zum zur",
    "fr": "à au aux avec ce ces cette d dans de des du elle en est et il ils je l la le les leur lui mais n ne nous on ou par pas plus pour qu que qui s sa se ses son sont sur un une vous",
    "es": "a al como con de del el ella en entre era es esta este ha la las lo los más me mi no nos o para pero por que se ser si sin sobre son su sus también un una y ya yo",
}
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style xmp iframe noembed noframes textarea title".split()
BOILERPLATE = "head nav header footer aside form button select option label fieldset legend datalist noscript template object canvas svg math audio video map menu dialog".split()
BLOCKS = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
CONTENT = "article main".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
CLOSED_BY_BLOCKS = ["p"]
SIBLINGS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["td", "th", "tr"], "option": ["option"]}
ENDS_SEARCH = "ul ol dl table article section div main body".split()  # an open sibling beyond such an element stays open
NAMES = (
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation navigations menu menus breadcrumb breadcrumbs masthead "
    "header footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments reply replies respond disqus pagination pager toolbar copyright disclaimer hidden form search skip"
).split()
WITHOUT = "has with no not without".split()  # such a class tells of a part that lies elsewhere
COMMENTS = "comment comments reply replies respond disqus".split()
ROLES = "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split()

_stops = {name: frozenset(words.split()) for name, words in STOP_WORDS.items()}
_void, _raw, _boilerplate, _blocks, _content, _headings = map(frozenset, (VOID, RAW, BOILERPLATE, BLOCKS, CONTENT, HEADINGS))
_names, _comments, _without, _roles, _ends = map(frozenset, (NAMES, COMMENTS, WITHOUT, ROLES, ENDS_SEARCH))
_token = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[!?/][^>]*+>?|[a-zA-Z].*\Z)", re.DOTALL)
_attribute = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_words = re.compile(r"[^\W\d_]+")
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_unseen = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Block:
    """A run of text: its words, its share of links, and where it lies."""

    __slots__ = ("text", "linked", "tag", "boilerplate", "content", "parent", "label")

    def __init__(self, text: str, linked: int, tag: str, boilerplate: bool, content: bool, parent: int):
        self.text, self.linked, self.tag, self.boilerplate, self.content, self.parent, self.label = text, linked, tag, boilerplate, content, parent, ""


def _named(tag: str, rest: str) -> bool:
    """Whether an element's attributes name it as boilerplate. The frame of the article is judged by comments alone, that of the page not at all."""
    if not rest or rest.isspace() or tag in ("html", "body"):
        return False
    for found in _attribute.finditer(rest):
        name, value = found[1].lower(), (found[2] or "").strip("\"'")
        if name == "hidden":
            return True
        if name == "role" and value.lower() in _roles or name == "style" and _unseen.search(value):
            return True
        if name in ("class", "id") and tag not in _headings:
            for word in unescape(value).split():
                parts = {p.lower() for p in _name_parts.findall(word)}
                if not parts.isdisjoint(_comments if tag in _content else _names) and parts.isdisjoint(_without):
                    return True
    return False


OUTSIDE, HEADED = 1, 2  # in boilerplate; in an article's own header, whose headings stay


class _Page:
    """The open elements that count, and the blocks so far."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool, bool, int]] = []  # name, 0 or OUTSIDE or HEADED, in content, whether it is inline boilerplate, number of the innermost element that holds paragraphs
        self.names: Counter = Counter()
        self.count = 0
        self.parts: list[str] = []
        self.linked, self.link, self.tag, self.muted = 0, False, "", 0

    def say(self, text: str) -> None:
        if self.muted:
            return
        if "&" in text:
            text = unescape(text)
        self.parts.append(text)
        if self.link:
            self.linked += len("".join(text.split()))

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            _, outside, content, _, parent = next((x for x in reversed(self.open) if not x[3]), ("", 0, False, False, 0))
            self.blocks.append(Block(text, self.linked, self.tag, bool(outside), content, parent))
        self.parts.clear()
        self.linked = 0

    def push(self, name: str, rest: str, inline: bool = False) -> None:
        _, outside, content, _, parent = self.open[-1] if self.open else ("", 0, False, False, 0)
        if not inline and name != "p" and name not in _headings:
            self.count += 1
            parent = self.count
        if outside != OUTSIDE:
            if name in _headings:
                outside = 0
            if name == "header" and content:
                outside = HEADED
            elif inline or name in _boilerplate or _named(name, rest):
                outside = OUTSIDE
        self.open.append((name, outside, content or name in _content, inline, parent))
        self.names[name] += 1
        self.muted += inline

    def close(self, names, ends=frozenset()) -> None:
        """Closes the innermost open element of these names, and all in it, if none of `ends` lies between."""
        if not any(self.names[n] for n in names):
            return
        if ends:
            for name, *_ in reversed(self.open):
                if name in names:
                    break
                if name in ends:
                    return
        while True:
            name, _, _, inline, _ = self.open.pop()
            self.names[name] -= 1
            self.muted -= inline
            if name in names:
                return

    def start(self, name: str, rest: str) -> None:
        if name in _blocks:
            self.flush()
            self.close(CLOSED_BY_BLOCKS, _ends)
            if name in SIBLINGS:
                self.close(SIBLINGS[name], _ends - {"tr"} if name == "tr" else _ends)
            if name != "hr":
                self.push(name, rest)
                self.tag = name
        elif name == "br":
            self.say(" ")
        elif name not in _void:
            self.link |= name == "a"
            if name in _boilerplate or _named(name, rest):  # other inline elements change nothing
                self.push(name, rest, True)

    def end(self, name: str) -> None:
        if name in _blocks:
            self.flush()
            self.close((name,))
            self.tag = self.open[-1][0] if self.open else ""
        else:
            self.close((name,))
        if name == "a" or name in _blocks:
            self.link = False


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in order, without labels."""
    page, at = _Page(), 0
    while at < len(html):
        found = _token.search(html, at)
        page.say(html[at : found.start() if found else len(html)])
        if found is None:
            break
        at, name = found.end(), (found["name"] or "").lower()
        if found["end"]:
            page.end(name)
        elif name in _raw:
            end = _raw_end[name].search(html, at)
            at = end.start() if end else len(html)
        elif name:
            page.start(name, found["rest"])
    page.flush()
    return page.blocks


def language(found: list[Block]) -> frozenset[str]:
    """The stop words that cover most of the page's words."""
    words = Counter(w for b in found if not b.boilerplate for w in _words.findall(b.text.lower()))
    return max(_stops.values(), key=lambda stops: sum(n for w, n in words.items() if w in stops))


def first_pass(found: list[Block]) -> None:
    """Labels by the block alone: "good", "bad", "open", or "out" for boilerplate."""
    stops, framed = language(found), any(b.content and not b.boilerplate for b in found)
    for b in found:
        size = len(b.text)
        if b.boilerplate:
            b.label = "out"
        elif framed and not b.content or b.linked > LINKED * (size - b.text.count(" ")):
            b.label = "bad"
        elif size < LONG or b.tag in _headings:
            b.label = "open"
        else:
            words = _words.findall(b.text.lower())
            share = sum(w in stops for w in words) / max(1, len(words))
            b.label = "good" if share >= GOOD else "bad" if share < BAD and not framed else "open"


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of a neighbour."""
    framed = any(b.content and not b.boilerplate for b in found)
    live = [b for b in found if not b.boilerplate and (b.content or not framed)]
    decided = lambda b: b.label in ("good", "bad")
    after: list[tuple[int, Block | None]] = [(0, None)] * len(live)  # distance of the next decided block, and the block
    far, near = 0, None
    for at in range(len(live) - 1, -1, -1):
        far += 1
        after[at] = (far, near)
        if decided(live[at]):
            far, near = 0, live[at]
    far, near = 0, None
    labels = []
    for b, (ahead, following) in zip(live, after, strict=True):
        far += 1
        if decided(b):
            far, near = 0, b
            labels.append(b.label)
        elif not following or not near:
            labels.append(next((x.label for x in (following, near) if x), "good" if b.content else "bad"))
        elif b.tag in _headings or ahead < far or ahead == far and following.parent == b.parent != near.parent:
            labels.append(following.label)
        elif far < ahead or near.label == following.label or near.parent == b.parent != following.parent:
            labels.append(near.label)
        else:
            labels.append("good" if b.content else "bad")
    for b, label in zip(live, labels, strict=True):
        b.label = label


def classified(html: str | None) -> list[Block]:
    """The blocks of a page with their labels."""
    found = blocks(html or "")
    first_pass(found)
    second_pass(found)
    return found


def main_text(html: str | None) -> str:
    return "\n\n".join(b.text for b in classified(html) if b.label == "good")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    text, n = fresh_names(pages, "text", "n_chars")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [main_text(h) for h in batch.column(html).to_pylist()]
            own = [pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, text, n])

        return each

    return map_rows(pages, make, StructType([*pages.schema.fields, StructField(text, StringType()), StructField(n, LongType())]))


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, block (from 0), tag, label ("good", "bad", or "out" for boilerplate), link share and text of every block."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, k, b.tag, b.label, b.linked / max(1, len(b.text) - b.text.count(" ")), b.text) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, b in enumerate(classified(h))]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["page_id", "block", "tag", "label", "linked", "text"])

        return each

    return map_rows(pages.select(F.col("page_id").cast("long"), F.col(html).cast("string")), make, "page_id long, block int, tag string, label string, linked double, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("html").cast("string").alias("html"))
    return extract(pages).drop("html")
