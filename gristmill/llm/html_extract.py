"""Main text of a web page by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = 1.0
THRESHOLD = 0.15

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKS = re.compile(r"[.,;:!?。，、；：！？…]")
NAME_TOKENS = re.compile(r"\S+")
NAME_PARTS = re.compile(r"[a-z]+")
# A tag whose attributes have an odd quotation mark ends at the next angle bracket.
PLAIN_TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>[^>]*)>|<[!?][^>]*>")
BROKEN_TAGS = 100
COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|latest) )?(?:comments?|repl(?:y|ies)|responses?)(?: \(?\d+\)?)?:?", re.I)
OWNED = re.compile(r"(?:copyright\b|\(c\) |©)|\ball rights reserved\b", re.I)

# Elements of HTML, by what they do to the text around them.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "math"}
BLOCKS = {
    "html", "head", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6",
    "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th",
    "blockquote", "pre", "figure", "figcaption", "address", "nav", "header", "footer", "aside", "form",
    "fieldset", "legend", "details", "summary", "dialog", "menu", "center", "select", "option", "button",
}
BREAKS = {"hr"}
# An element that starts closes an open one of these, up to the nearest of the scopes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Elements, roles and words of class or id that name what is not the article.
ASIDE = {"nav", "footer", "aside", "form", "fieldset", "dialog", "menu", "select", "option", "button", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "form", "menu", "alert"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments",
    "reply", "replies", "disqus", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter",
    "subscribe", "share", "social", "related", "recommended", "widget", "pagination", "pager", "login", "masthead",
}
# Words that stand beside those in compound names such as "comment-list".
LAYOUT_NAMES = {
    "wrap", "wrapper", "container", "box", "list", "lists", "item", "items", "inner", "outer", "area", "bar", "block",
    "section", "panel", "left", "right", "top", "bottom", "slot", "unit", "link", "links", "button", "buttons", "icon",
    "icons", "post", "posts", "article", "articles", "story", "stories", "content", "contents", "site", "page", "user",
    "reader", "global", "main", "primary", "secondary", "header", "head", "body", "text", "form", "media", "row", "col",
    "column", "grid", "card", "group", "thread", "overlay", "message", "sticky", "fixed", "mobile", "desktop", "module",
}
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "col", "embed", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass(frozen=True)
class Block:
    """A run of text in one innermost block element, both known by numbers in page order.

    ``path`` numbers the tags and classes from the root to the element, ``article`` is the path
    of the outermost article or main around it, and ``within`` the element's own article.
    """

    path: int
    text: str
    linked: int
    aside: bool
    named: bool
    element: int
    article: int | None
    within: int | None


@dataclass
class _Element:
    """An open element: what its text inherits. ``named`` ones are aside by class or id only."""

    tag: str
    number: int
    path: int = 0
    aside: bool = False
    named: bool = False
    article: int | None = None
    within: int | None = None


def _is_aside_name(name: str) -> bool:
    """Whether a class or id names what is not the article.

    All parts of a compound must be such names or words of layout: "cookie-banner" and
    "comment-list" are, "notice-period", "social-science" and "has-sidebar" are not.
    """
    parts = set(NAME_PARTS.findall(name))
    return bool(parts & ASIDE_NAMES) and parts <= ASIDE_NAMES | LAYOUT_NAMES


def _judged(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """The label of an element in a path (tag and class), if it is aside, and if by its name."""
    found = {}
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        found.setdefault(name.lower(), html.unescape(next(filter(None, values), "")).lower())
    aside = (
        tag in ASIDE
        or (tag == "header" and not in_article)
        or found.get("role") in ASIDE_ROLES
        or "hidden" in found
        or found.get("aria-hidden") == "true"
        or "display:none" in found.get("style", "").replace(" ", "")
    )
    # The id of a heading repeats its words.
    names = found.get("class", "") if tag in HEADINGS else f"{found.get('class', '')} {found.get('id', '')}"
    named = tag not in ("html", "body") and any(map(_is_aside_name, NAME_TOKENS.findall(names)))
    return f"{tag}.{found['class']}" if found.get("class") else tag, aside, named


class _Parser:
    """Blocks of a page in one scan, with open and stray tags put up with.

    What a block inherits is carried down in its element, so depth costs nothing: no step looks
    at more open elements than it closes.
    """

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.root = _Element("", 0)
        self.stack: list[_Element] = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = [0]
        self.lasts: list[int] = [0]
        self.tags: list[str] = [""]
        self.pieces: list[str] = []
        self.links = self.linked = 0
        # An inline element that is aside: its tag, how often it is open, and the depth around it.
        self.skipped: tuple[str, int, int] | None = None

    def text(self, text: str) -> None:
        if self.skipped is None:
            self.pieces.append(text)
            self.linked += len(text) if self.links else 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            e = self.stack[-1]
            self.blocks.append(Block(e.path, text, self.linked, e.aside, e.named, e.number, e.article, e.within))
        self.pieces.clear()
        self.linked = 0

    def close_from(self, place: int) -> None:
        while len(self.stack) > place:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            self.lasts[gone.number] = len(self.parents) - 1
        if self.skipped and len(self.stack) < self.skipped[2]:
            self.skipped = None

    def nearest(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: set[str], scopes: set[str]) -> None:
        place = self.nearest(tags)
        if place and place > self.nearest(scopes):
            self.close_from(place)

    def open(self, tag: str, attributes: str) -> None:
        if self.stack[-1].tag == "p":
            self.close_from(len(self.stack) - 1)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        around = self.stack[-1]
        label, aside, named = _judged(tag, attributes, around.article is not None)
        path = self.paths.setdefault((around.path, label), len(self.paths) + 1)
        number = len(self.parents)
        # An article within an article is about it, such as a reader's comment.
        nested = tag == "article" and around.within is not None and self.tags[around.within] == "article"
        self.stack.append(
            _Element(
                tag, number, path,
                around.aside or aside or nested or self.skipped is not None,
                around.named or named,
                path if around.article is None and tag in ARTICLE else around.article,
                number if tag in ARTICLE else around.within,
            )
        )
        self.parents.append(around.number)
        self.lasts.append(number)
        self.tags.append(tag)
        self.places[tag].append(len(self.stack) - 1)

    def inline(self, tag: str, end: bool, attributes: str) -> None:
        if self.skipped:
            inner, times, depth = self.skipped
            if tag == inner:
                times += -1 if end else 1
                self.skipped = (inner, times, depth) if times else None
        elif not end and attributes.strip() and tag not in VOID and not attributes.endswith("/"):
            _, aside, named = _judged(tag, attributes, True)
            if aside or named:
                self.skipped = (tag, 1, len(self.stack))

    def tag(self, tag: str, end: bool, attributes: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1) if end else self.links + 1
        if tag == "br":
            self.text(" ")
        elif tag in BREAKS:
            self.flush()
        elif tag not in BLOCKS:
            self.inline(tag, end, attributes)
        else:
            self.flush()
            self.links = 0
            if end:
                self.close({tag}, set() if tag != "p" else {"article", "section", "div", "body", "td", "li"})
            else:
                self.open(tag, attributes)

    def parse(self, page: str) -> None:
        at, broken = 0, 0
        while at < len(page):
            found = TOKEN.match(page, at)
            if found.group() == "<" and at + 1 < len(page) and (page[at + 1].isalpha() or page[at + 1] in "/!?"):
                broken += 1
            if broken > BROKEN_TAGS:
                break
            at = self.token(page, found)
        # Past so many tags without an end, quotation marks no longer hide one.
        while at < len(page):
            if page.find(">", at) < 0:
                self.text(html.unescape(page[at:]))
                break
            found = PLAIN_TAG.match(page, at)
            if found:
                at = self.token(page, found)
            else:
                stop = page.find("<", at + 1)
                stop = stop if stop > 0 else len(page)
                self.text(html.unescape(page[at:stop]))
                at = stop
        self.flush()
        self.close_from(1)
        self.lasts[0] = len(self.parents) - 1

    def token(self, page: str, found: re.Match) -> int:
        """Take one piece of the page and say where the next one begins."""
        at, tag = found.end(), found["tag"]
        if tag is None:
            token = found.group()
            if token[0] != "<" or token == "<":
                self.text(html.unescape(token))
            return at
        tag = tag.lower()
        if tag not in RAW:
            self.tag(tag, bool(found["end"]), found["attributes"])
        elif not found["end"] and not found["attributes"].rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
        return at

    def innermost(self, first: int, last: int) -> int:
        """The innermost element around two elements."""
        while first != last:
            if first > last:
                first = self.parents[first]
            else:
                last = self.parents[last]
        return first

    def holds(self, element: int, block: Block) -> bool:
        return element <= block.element <= self.lasts[element]

    def commented(self) -> set[int]:
        """Places of blocks that a heading such as "3 comments" marks as articles of readers."""
        gone = set()
        heads = [
            i for i, b in enumerate(self.blocks)
            if self.tags[b.element] in HEADINGS and b.article is not None and COMMENTS.fullmatch(b.text)
        ]
        for i, after in zip(heads, [*heads, len(self.blocks)][1:], strict=True):
            around = self.parents[self.blocks[i].element]
            replies = {
                j for j in range(i + 1, after)
                if self.holds(around, self.blocks[j])
                and self.tags[self.blocks[j].within or 0] == "article"
                and self.blocks[j].within != self.blocks[i].within
            }
            gone |= {i, *replies} if replies else set()
        return gone


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Fused ratios per tag path: text per node times punctuation per node, less linked text."""
    size, marks, links, nodes = (defaultdict(float) for _ in range(4))
    for b in blocks:
        size[b.path] += len(b.text)
        marks[b.path] += len(MARKS.findall(b.text))
        links[b.path] += min(b.linked, len(b.text))
        nodes[b.path] += 1
    return {
        p: math.sqrt((size[p] / nodes[p]) * (1 + marks[p] / nodes[p])) * (1 - links[p] / size[p]) for p in size
    }


def smoothed(values: list[float], width: float = SMOOTHING) -> list[float]:
    """Gaussian smoothing along the page, so that short blocks amid long ones count with them."""
    reach = max(1, round(2 * width))
    kernel = [math.exp(-(d * d) / (2 * width * width)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[j], kernel[j - i + reach]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(v * k for v, k in near) / sum(k for _, k in near))
    return out


def _beside_text(block: Block) -> bool:
    """Links or a copyright line, as stand before and after an article."""
    return 2 * block.linked >= len(block.text) or bool(OWNED.search(block.text))


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The article of a page: blocks in order, joined by an empty line.

    What names itself as menu, header, footer, sidebar, notice, advert, form or comment is out,
    be it a block or inline; so are articles within an article. If nothing else is left, the
    names of classes and ids do not count. Of the other blocks, text length and punctuation are
    summed per root-to-leaf tag path, the ratios fused and smoothed along the page, and paths
    whose mean reaches ``threshold`` times the best one are content. If content lies in an
    article or main element, its other blocks, such as headings and lists, belong to it as
    well, and what lies outside does not. Otherwise the innermost element that holds all
    content counts as the article, with all it holds but for links and copyright lines before
    and after the content; there, short paths do not count as content by their neighbours.
    """
    parser = _Parser()
    parser.parse(page or "")
    commented = parser.commented()
    blocks = [b for i, b in enumerate(parser.blocks) if not b.aside and i not in commented]
    blocks = [b for b in blocks if not b.named] or blocks
    if not blocks:
        return ""
    scores = path_scores(blocks)
    along = smoothed([scores[b.path] for b in blocks])
    sums, counts = defaultdict(float), defaultdict(int)
    for b, value in zip(blocks, along, strict=True):
        sums[b.path] += value
        counts[b.path] += 1
    means = {p: sums[p] / counts[p] for p in sums}
    best = max(means.values())
    content = {p for p, value in means.items() if value >= threshold * best}
    held = {b.article for b in blocks if b.path in content and b.article is not None}
    if held:
        return "\n\n".join(b.text for b in blocks if b.article in held)
    highest = max(scores.values())
    core = [b for b in blocks if b.path in content and scores[b.path] >= threshold * highest]
    core = core or [b for b in blocks if b.path in content]
    core = [b for b in core if not _beside_text(b)] or core
    inner = parser.innermost(core[0].element, core[-1].element)
    # A single block's own element holds only itself; its lists and headings are around it.
    if core[0].element == core[-1].element == inner:
        inner = parser.parents[inner]
    around = [b for b in blocks if parser.holds(inner, b)]
    first, last = around.index(core[0]), len(around) - 1 - around[::-1].index(core[-1])

    chosen = [b for i, b in enumerate(around) if first <= i <= last or not _beside_text(b)]
    return "\n\n".join(b.text for b in chosen)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``, from its whole html.

    A null or empty page has an empty text. Repeated rows stay; other columns are not read.
    Each page is parsed in one scan within its task, linear in its length however deep its
    elements nest; nothing is shuffled.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pages_.map(lambda page: main_text(page, threshold))

    found = pages.select("page_id", "url", texts(F.coalesce("html", F.lit(""))).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
