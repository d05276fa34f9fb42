"""Main text of HTML pages from the text-to-tag ratio of their lines.

The standard library's parser streams its events once. Text is gathered into blocks (the lines): a block ends
at every tag that starts or ends one. Each block has a ratio, its characters outside links per tag that
occurs in it. The ratios are smoothed by a Gaussian over neighbouring blocks, and two clusters of them
(one-dimensional 2-means from the smallest and largest value) give the threshold above which a block is content.

The content blocks point out the region: the innermost article or main element with more than half of their
text, or else the innermost element with nearly all of it. All of its blocks that do not stand in an element of another purpose (menus, headers, footers, asides, notices,
adverts, forms, scripts, styles, comments of readers) are the main text, so short paragraphs between long ones
stay.

Tags tell such an element for certain. Forms and names only suggest one, since layouts have names like these too: the mark
counts unless the content blocks, found with certain elements left out, say that the element holds the page's text. That is so
if little content is left outside of marked elements, or an article in it holds most of the page's content, and if it has the
shape of a text (an article, a heading or several content blocks). Elements named as adverts, comments or consent keep their
mark unless nothing else on the page is content.

Null and empty pages, and pages without text, give an empty text. Character references are decoded, white space
in a block becomes one blank. Repeated rows are treated alike; `main_texts` keeps the named columns only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import ship_package

#: Fixed values of HTML.
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "canvas", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "iframe", "legend", "li", "main", "menu", "nav", "noscript",
    "ol", "option", "optgroup", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "textarea",
    "tfoot", "th", "thead", "title", "tr", "ul", "button",
}
SILENT = {
    "script", "style", "head", "title", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio",
    "video", "select", "textarea", "button",
}
ASIDE = {
    "nav", "header", "footer", "aside", "menu", "dialog",
}
FORMS = {"form", "fieldset"}
ENDS_P = BLOCK - {
    "body", "html", "button", "caption", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr",
    "title", "iframe", "canvas", "noscript", "select", "textarea",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"},
          "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"},
         "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Names that tell an element's purpose, matched against the words of its class, id and role.
PURPOSE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "adbox", "adslot", "advertising", "sponsor",
    "sponsored", "sponsors", "promo", "promos", "promotion", "promotions", "banner", "sidebar", "side", "aside",
    "rail", "widget", "widgets", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "toc", "header", "masthead", "topbar", "footer", "bottombar", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "alerts", "disclaimer", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "searchbox", "form", "comment",
    "comments", "commentlist", "replies", "reply", "respond", "disqus", "discussion", "responses", "social", "share",
    "sharing", "related", "recommended", "recommendations", "trending", "popular", "complementary", "contentinfo",
    "dialog", "hidden", "skip", "copyright", "legal",
}
#: Those of them that hardly ever name a layout.
STRICT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "adbox", "adslot", "advertising", "sponsor",
    "sponsored", "sponsors", "promo", "promos", "promotion", "promotions", "cookie", "cookies", "consent", "gdpr",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "comment", "comments",
    "commentlist", "replies", "reply", "respond", "disqus", "discussion", "responses", "hidden",
}
ABOUT = {"has", "with", "no", "without"}
NAMED = {"article", "main"}
REGIONS = {"section", "div", "td", "center", "body", "html", ""}
KEPT_TAGS = {"html", "body", "article", "main"}
_SPACE = re.compile(r"\s+")
SIGMA = 1.0
NONE, LIKELY, NEARLY, CERTAIN = range(4)
LEFT = 0.25  # of an element's content, that much outside of marked elements keeps its mark
TITLES = {"h1", "h2"}
SEVERAL = 3
PLENTY = 80.0


def purpose(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Does the element serve something else than the main text, and how sure is that?"""
    if tag in ASIDE:
        return CERTAIN
    sure = LIKELY if tag in FORMS else NONE
    for name, value in attrs:
        if name in ("hidden",) or (name == "aria-hidden" and value == "true"):
            return CERTAIN
        if name == "style" and value and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return CERTAIN if tag not in KEPT_TAGS else sure
        if name in ("class", "id", "role") and value and tag not in KEPT_TAGS:
            words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", value) if w]
            # "has-sidebar" speaks of something else than the element itself.
            for k, word in enumerate(words):
                if word in PURPOSE and not (k and words[k - 1] in ABOUT):
                    sure = max(sure, NEARLY if word in STRICT else LIKELY)
    return sure


@dataclass
class Block:
    text: str
    linked: int
    tags: int
    element: int
    aside: bool = False


@dataclass
class Element:
    number: int
    tag: str
    silent: bool


class BlockReader(HTMLParser):
    """Turns parser events into blocks, with the open elements of each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[Element] = []
        self.names, self.parents, self.marks = [""], [0], [NONE]  # by number of the element; 0 is the page
        self.standing: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.tags = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            inside = self.open[-1] if self.open else None
            self.blocks.append(Block(text, self.linked, max(1, self.tags), inside.number if inside else 0))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self, at: int) -> None:
        if any(e.tag in BLOCK for e in self.open[at:]):
            self._flush()
        for e in self.open[at:]:
            self.standing[e.tag] -= 1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br" or tag == "wbr":
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at].tag == "p":
                    self._pop(at)
                    break
                if self.open[at].tag in BLOCK:
                    break
        if tag in CLOSES:
            at, low = len(self.open), None
            while at > 0 and self.open[at - 1].tag not in SCOPE[tag]:
                at -= 1
                if self.open[at].tag in CLOSES[tag]:
                    low = at
            if low is not None and at > 0:
                self._pop(low)
        inside = self.open[-1] if self.open else None
        self.names.append(tag)
        self.parents.append(inside.number if inside else 0)
        self.standing[tag] = self.standing.get(tag, 0) + 1
        self.marks.append(purpose(tag, attrs))
        self.open.append(Element(len(self.names) - 1, tag, bool(inside and inside.silent) or tag in SILENT))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag and tag not in ("p", "div", "article"):
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self._flush()
        for at in range(len(self.open) - 1, -1, -1) if self.standing.get(tag) else ():
            if self.open[at].tag == tag:
                self._pop(at)
                return
            # An inline end tag does not close blocks around it.
            if tag not in BLOCK and self.open[at].tag in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].silent:
            return
        self.parts.append(data)
        if self.standing.get("a"):
            self.linked += len(data)

    def finish(self) -> list[Block]:
        self.close()
        self._flush()
        self.set_asides(CERTAIN)
        return self.blocks

    def set_asides(self, least: int) -> None:
        """Blocks in elements with a mark of at least `least` are asides."""
        aside = [False]
        for number in range(1, len(self.names)):
            # The main element is never part of something around it that serves another purpose.
            inherited = aside[self.parents[number]] and self.names[number] != "main"
            aside.append(inherited or self.marks[number] >= least)
        for block in self.blocks:
            block.aside = aside[block.element]

    def sums(self, amounts: list[float]) -> list[float]:
        """Sums of what the elements hold, with all in them."""
        total = list(amounts)
        for number in range(len(total) - 1, 0, -1):
            total[self.parents[number]] += total[number]
        return total

    def drop_marks(self) -> None:
        """Takes uncertain marks from elements that hold the page's text; the less certain and larger ones are looked at first."""
        # A cut ratio, so that one very long block does not make others look like menus.
        ratios = text_to_tag(self.blocks, most=PLENTY)
        content = (ratios.content | (ratios.raw >= max(ratios.threshold, 1.0))).tolist()
        chars, count = [0.0] * len(self.names), [0.0] * len(self.names)
        for block, good in zip(self.blocks, content, strict=True):
            chars[block.element] += len(block.text) * good
            count[block.element] += good
        held, counted = self.sums(chars), self.sums(count)
        articles = [float(name in NAMED and held[k] > 0.5 * held[0]) for k, name in enumerate(self.names)]
        shaped = self.sums([float(name in NAMED and held[k] > 0) for k, name in enumerate(self.names)])
        titled = self.sums([float(name in TITLES and held[k] > 0) for k, name in enumerate(self.names)])
        articles = self.sums(articles)
        # What stands under each uncertain mark and no further one.
        nearest = [0] * len(self.names)
        own = [0.0] * len(self.names)
        for number in range(len(self.names)):
            parent = 0 if self.names[number] == "main" else nearest[self.parents[number]]
            nearest[number] = number if self.marks[number] else parent
            own[nearest[number]] += chars[number]
        free, kept = own[0], set()
        for number in sorted((k for k, mark in enumerate(self.marks) if LIKELY <= mark <= NEARLY), key=lambda k: (self.marks[k], -held[k], k)):
            around = 0 if self.names[number] == "main" else nearest[self.parents[number]]
            # It stays marked if an element around it does.
            if not held[number] or self.marks[around] or (around and around in kept):
                kept.add(number)
                continue
            if self.marks[number] == NEARLY:
                holds = free == 0 and shaped[number] + titled[number] > 0
            else:
                holds = (free < LEFT * held[number] or articles[number] > 0) and (
                    shaped[number] + titled[number] > 0 or counted[number] >= SEVERAL)
            if holds:
                self.marks[number] = NONE
                free += own[number]
            else:
                kept.add(number)


@dataclass
class Ratios:
    raw: np.ndarray
    smooth: np.ndarray
    threshold: float
    content: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def text_to_tag(blocks: list[Block], sigma: float = SIGMA, most: float = np.inf) -> Ratios:
    """Ratio of each block, at most `most`, smoothed over its neighbours, and the threshold between the two clusters."""
    raw = np.array([0.0 if b.aside else max(0, len(b.text) - b.linked) / b.tags for b in blocks]).clip(max=most)
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    smooth = np.convolve(np.pad(raw, reach, mode="edge"), kernel, mode="valid")
    low, high = float(smooth.min()), float(smooth.max())
    for _ in range(50):
        upper = smooth > (low + high) / 2
        if not upper.any() or upper.all():
            break
        new = float(smooth[~upper].mean()), float(smooth[upper].mean())
        if new == (low, high):
            break
        low, high = new
    threshold = (low + high) / 2
    content = (smooth >= threshold) & (raw > 0) if high > low else raw > 0
    return Ratios(raw, smooth, threshold, content)


def main_text(html: str) -> str:
    reader = BlockReader()
    reader.feed(html)
    blocks = reader.finish()
    if not blocks:
        return ""
    reader.drop_marks()
    reader.set_asides(LIKELY)
    content = text_to_tag(blocks).content
    # Text of content blocks by element; the innermost element with most of it is the region.
    weight = [0] * len(reader.names)
    for block, good in zip(blocks, content.tolist(), strict=True):
        weight[block.element] += len(block.text) * good
    weight = reader.sums(weight)
    # An article may be named as such; otherwise its element holds nearly all content.
    named = [n for n, w in enumerate(weight) if reader.names[n] in NAMED and w > 0.5 * weight[0]]
    wide = [n for n, w in enumerate(weight) if reader.names[n] in REGIONS and w > 0.9 * weight[0]]
    region = max(named or wide, default=0)
    inside = [False] * len(weight)
    for number in range(len(weight)):
        inside[number] = number == region or (number > 0 and inside[reader.parents[number]])
    return "\n\n".join(b.text for b in blocks if not b.aside and inside[b.element])


def main_texts(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in `keep`, text and n_chars (code points) of every row of pages; no shuffle."""
    ship_package(pages.sparkSession)
    source = pages.select(*keep, F.col(html_column).cast("string").alias("_html"))
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = arrays.column(batch, "_html")
            texts = [main_text(html[k].as_py() or "") for k in range(len(html))]
            yield pa.RecordBatch.from_arrays(
                [*(arrays.column(batch, c) for c in keep), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)
