"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by itself:
markup that names its purpose (menus, page headers and footers, sidebars, notices, adverts,
forms, comments) and a high share of linked text make it bad; in or around the article, names
that may also be a part of it (header, widget) and links (a linked headline) leave it open, but
for short or linked blocks named after sharing and related pages; enough length with enough stop
words and few links make it good; everything else, short blocks above all, stays open. The
second pass gives an open block the label of its nearest decided neighbours in the same
region of the page (inside or outside the article element). Where they differ, or none is
decided, the block follows its region: inside an article it stays, outside it goes.

Each page is handled alone, without a shuffle. Defined cases: null and empty html have no
text; unclosed, nested and truncated markup is read as far as it goes; repeated rows are
extracted alike; very long pages are read whole, in time linear in their length; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 60  # characters from which a block can be good by itself
STOP_DENSITY = 0.1
LINK_GOOD, LINK_BAD = 0.2, 0.5

STOP_WORDS = frozenset(
    """a an and are as at be by for from has he her his i in is it its not of on or she that the
    their they this to was we were will with you
    al como con de del el en es la las lo los no para pero por que se su un una y
    au avec ce dans des du elle est et il je le les mais ne nous ou par pas pour qui sa sur une
    aber als auch auf aus bei das dem den der des die ein eine er für ich im ist mit nicht sich sie
    und von wie wir zu""".split()
)
_BOILERPLATE_TAGS = frozenset(
    """nav footer aside form select button menu dialog noscript template iframe svg object canvas
    head fieldset label""".split()
)
_RAW_TAGS = frozenset("script style textarea title noscript template xmp".split())
_MAIN_TAGS = frozenset(("article", "main"))
_VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_INLINE_TAGS = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s
    samp small span strike strong sub sup time tt u var wbr br""".split()
)
# Purposes that class, id and role names tell.
_PURPOSE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment\w*|consent|"
    r"cookies?|cookie\w*|disclaimer|disqus|footer|header|login|masthead|menu|modal|nav\w*|newsletter|"
    r"notice|pager|pagination|popup|promo\w*|recommended|related|replies|respond|search|share|sharing|"
    r"sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo)"
    r"(?=$|[\s_-])",
    re.IGNORECASE,
)
# Words among them that site builders also use in names of the article or its parts.
_DOUBTFUL = re.compile(r"banner|comment(?!s?$)\w*|header|nav\w*|notice|related|share|widget", re.IGNORECASE)
# Words of them that name a part which is no text of the article unless it is long.
_ASIDE = re.compile(r"related|share", re.IGNORECASE)
_PARTS = re.compile(r"[\s_-]+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=)|display\s*:\s*none", re.IGNORECASE)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    purpose: bool  # markup says it is not the article
    article: bool  # inside an article or main element
    doubtful: bool = False  # in or around the article, a name that may mean either
    aside: bool = False  # one of these names tells of sharing or related pages


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    found: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    # tag, and so far: purpose, article, doubtful, aside
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    open_tags: dict[str, int] = {}
    links = 0
    nothing = ("", False, False, False, False)
    at, size = 0, len(html)

    def close() -> None:
        text = " ".join("".join(unescape(p) for p, _ in pieces).split())
        if text:
            linked = sum(len(" ".join(unescape(p).split())) for p, inside in pieces if inside)
            _, purpose, article, doubtful, aside = stack[-1] if stack else nothing
            named = purpose or (doubtful and not article)
            found.append(Block(text, linked, named, article, doubtful and article, aside))
        pieces.clear()

    def pop() -> None:
        open_tags[stack.pop()[0]] -= 1

    while at < size:
        token = _TOKEN.search(html, at)
        if token is None:
            pieces.append((html[at:], links > 0))
            break
        if token.start() > at:
            pieces.append((html[at : token.start()], links > 0))
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if tag == "a":
                links = 0
            elif tag not in _INLINE_TAGS or open_tags.get(tag):
                close()
                if open_tags.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                    links = 0
            continue
        if tag in _RAW_TAGS:
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "br" or tag == "wbr":
            pieces.append((" " if tag == "br" else "", links > 0))
            continue
        attrs = token["attrs"]
        named = unsure = apart = False
        if attrs and tag not in ("html", "body", "article", "main"):
            names = " ".join(" ".join(filter(None, m)) for m in _NAMES.findall(attrs))
            told = [part for part in _PARTS.split(names) if _PURPOSE.search(part)]
            unsure = any(map(_DOUBTFUL.fullmatch, told))
            apart = any(map(_ASIDE.fullmatch, told))
            named = not all(map(_DOUBTFUL.fullmatch, told)) or bool(_HIDDEN.search(attrs))
        if tag == "a":
            links = 1
            continue
        if tag in _INLINE_TAGS and not (named or unsure):
            continue
        close()
        if tag in _VOID_TAGS:
            continue
        if tag == "p":  # a paragraph ends the one before it
            while stack and stack[-1][0] == "p":
                pop()
            links = 0
        _, purpose, article, doubtful, aside = stack[-1] if stack else nothing
        purpose = purpose or named or tag in _BOILERPLATE_TAGS or (tag == "header" and not article)
        stack.append(
            (tag, purpose, article or tag in _MAIN_TAGS, doubtful or unsure, aside or apart)
        )
        open_tags[tag] = open_tags.get(tag, 0) + 1
    close()
    return found


def decide(block: Block) -> bool | None:
    """First pass: good, bad, or open."""
    linked = block.linked > LINK_BAD * len(block.text)
    if block.purpose or (linked and not block.article):
        return False
    if block.aside and (linked or len(block.text) < LONG):
        return False
    if block.doubtful or len(block.text) < LONG or block.linked > LINK_GOOD * len(block.text):
        return None
    words = block.text.lower().split()
    stops = sum(word.strip(".,;:!?()\"'") in STOP_WORDS for word in words)
    return True if stops >= STOP_DENSITY * len(words) else None


def label(page: list[Block]) -> list[bool]:
    """Both passes: which blocks are main text."""
    first = [decide(b) for b in page]
    if not any(b.article for b in page) and not any(first):
        # nothing tells where the text is: keep what is not known to be something else
        return [mark is None for mark in first]
    before: list[tuple[int, bool] | None] = [None] * len(page)
    after: list[tuple[int, bool] | None] = [None] * len(page)
    for order, nearest in ((range(len(page)), before), (range(len(page) - 1, -1, -1), after)):
        last: dict[bool, tuple[int, bool]] = {}
        for i in order:
            region = page[i].article
            nearest[i] = last.get(region)
            # what markup names lies between blocks by layout and says nothing of them
            if first[i] is not None and not page[i].purpose:
                last[region] = (i, first[i])
    final = []
    for i, block in enumerate(page):
        if first[i] is not None:
            final.append(first[i])
            continue
        sides = [side for side in (before[i], after[i]) if side is not None]
        labels = {mark for _, mark in sides}
        if len(labels) == 1 and (block.doubtful or not (block.article and labels == {False})):
            final.append(labels.pop())
        else:
            final.append(block.article)
    return final


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    return "\n\n".join(b.text for b, keep in zip(page, label(page)) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
