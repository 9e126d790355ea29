"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one per block element. Lines of page furniture (menus, page headers and footers, sidebars,
notices, adverts, forms, comments, scripts, styles) and lines that are mostly links weigh nothing. The text lengths of the
others are summed over a sliding window of ``WINDOW`` lines: where the sum rises over the surge level the main text
begins, where it falls to nothing it ends. The level is a part of the page's highest window, so short pages have one too,
but never more than ``LEVEL``, so that one very long line does not hide the others.

What lies between a surge and the next dive is main text. Its edges are then set by structure. Where ``article`` and
``main`` elements hold more than half of the page's weight, the page is read without the rest, and every such element with
a surge belongs to the main text as a whole. Where they hold less they are teasers beside it and left out. Headings and
paragraphs that adjoin a surge belong to it. Nothing else is dropped or cut.

Time and memory are linear in the page: tags are read once, and the walk keeps counters and places per element name
in place of searches through its open elements.

Defined cases: null, empty or text-free html gives an empty text; markup may be unclosed or wrongly nested: an end tag
without a start is skipped, a ``<`` that no ``>`` follows is text, and page furniture that is never closed ends where an
article, a main element or its parent's end begins; in a page whose quotes fail to close again and again, tags end at the
next ``>``; repeated rows are extracted one by one; ids and urls come back as they are; other columns take no part.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import pieces, table

WINDOW = 3
#: part of the page's highest window from which on a line is in a surge, and the characters that are enough on any page
SURGE, LEVEL = 0.1, 200
#: part of the page's weight over which article and main elements hold the main text
HOME_SHARE = 0.5
#: a paragraph of more words inside an article is text under names that may mean page furniture or not
PROSE_WORDS = 5
LINK_SHARE = 0.6

_START = re.compile(r"<(?:(?P<skip>!--|!\[CDATA\[)|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
#: failed searches for closing quotes may cost so many times the page
_PATIENCE = 8
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: decimal references beyond any code point; int() takes no text of thousands of digits
_HUGE = re.compile(r"&#0*+[1-9][0-9]{7,}+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their content is not text
_RAW = frozenset("script style template noscript svg math iframe object title head textarea".split())
_FURNITURE = frozenset("nav footer aside form menu dialog select button label fieldset".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
_TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption caption".split())
_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment "
    "commentform commentlist comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation "
    "newsletter notice notices pagination pager popup promo promoted related respond share sharing sidebar sidenav signup "
    "skip social sponsor sponsored subnav subscribe subscription toolbar topbar topnav widget".split()
)
#: of these, the ones that an article's own parts may carry too
_UNSURE = frozenset("alert banner promoted respond share sharing skip social toolbar widget".split())
_SURE = _WORDS - _UNSURE
#: a header of these is the article's own
_OWN_HEADER = frozenset("article content entry page post story".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
_NEVER = frozenset("html body main article".split())
#: an element of the first kind closes an open one of the second
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"},
           "dt": {"dd", "dt"}, "option": {"option"}}
_SCOPES = frozenset("ul ol table tr dl select article main section nav aside div body form footer header".split())


@dataclass
class Line:
    text: str
    linked: int
    kind: str
    home: int  # number of the article or main element it lies in, 0 for none
    furniture: bool


@dataclass
class _Open:
    name: str
    furniture: int  # 0 none, 1 by an unsure name, 2 certain
    home: int
    block: int  # place of the nearest element that is not inline, itself included, -1 for none
    scope: int  # place of the nearest of _SCOPES, itself included, -1 for none
    gone: bool = False  # an inline element that was closed below others


@dataclass
class _Pages:
    """State of one page's walk."""

    lines: list[Line] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)  # of the open elements of a name, ascending
    loose: deque[int] = field(default_factory=deque)  # of furniture without an end tag, ascending
    within: list[int] = field(default_factory=lambda: [0, 0, 0])  # open elements by kind of furniture
    text: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    homes: int = 0

    @property
    def furniture(self) -> bool:
        return self.within[1] + self.within[2] > 0

    @property
    def home(self) -> int:
        return self.stack[-1].home if self.stack else 0

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, element: _Open, closed: bool) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places.setdefault(element.name, []).append(at)
        self.within[element.furniture] += 1
        if element.furniture and not closed:
            self.loose.append(at)

    def leave(self, at: int) -> None:
        """Count the newest open element of its name as closed."""
        element = self.stack[at]
        element.gone = True
        self.places[element.name].pop()
        self.within[element.furniture] -= 1

    def cut(self, size: int) -> None:
        """Close all but the lowest ``size`` elements, and the closed ones on top of those."""
        while self.stack and (len(self.stack) > size or self.stack[-1].gone):
            if not self.stack[-1].gone:
                self.leave(len(self.stack) - 1)
            self.stack.pop()
        while self.loose and self.loose[-1] >= len(self.stack):
            self.loose.pop()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            block = self.stack[-1].block if self.stack else -1
            line = Line(text, self.linked, self.stack[block].name if block >= 0 else "body", self.home, False)
            unsure = self.within[1] > 0 and not (self.home and _is_prose(line))
            line.furniture = self.within[2] > 0 or unsure
            self.lines.append(line)
        self.text, self.linked = [], 0


def _is_prose(line: Line) -> bool:
    return line.kind in ("p", "blockquote", "pre") and len(line.text.split()) > PROSE_WORDS and not _mostly_links(line)


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if not rest.strip(" /"):
        return out
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out


def _furniture_of(name: str, own: dict[str, str], in_home: bool) -> int:
    if name in _FURNITURE or (name == "header" and not in_home):
        return 2
    if name in _NEVER or not own:
        return 0
    words = set(_SPLIT.split(f"{own.get('class', '')} {own.get('id', '')}".lower()))
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
    if hidden or own.get("role", "").lower() in _ROLES or words & _SURE:
        return 2
    if "header" in words and not in_home and _OWN_HEADER.isdisjoint(words):
        return 2
    return 0 if _UNSURE.isdisjoint(words) else 1 if in_home else 2


def _matched(tags: list[tuple[int, int, bool, str, str]]) -> set[int]:
    """Places of start tags that have an end tag of their own."""
    waiting: dict[str, list[int]] = {}
    out = set()
    for at, _, ends, name, _ in tags:
        if not ends:
            waiting.setdefault(name, []).append(at)
        elif waiting.get(name):
            out.add(waiting[name].pop())
    return out


def _tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, is an end tag, name, attributes) of the page's tags; comments and raw content are passed over."""
    out: list[tuple[int, int, bool, str, str]] = []
    at, last, patience = 0, page.rfind(">"), _PATIENCE * len(page)
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    while (m := _START.search(page, at)) is not None:
        start = m.start()
        if m["skip"]:
            end = "-->" if m["skip"] == "!--" else "]]>"
            close = page.find(end, m.end())
            at = close + len(end) if close >= 0 else len(page)
            out.append((start, at, False, "", ""))
            continue
        if start > last:  # only a comment can come now
            at = m.end()
            continue
        tag = _NAME.match(page, start)
        if tag is None:
            at = page.find(">", start) + 1
            out.append((start, at, False, "", ""))
            continue
        quoted = _QUOTED.match(page, tag.end()) if patience > 0 else None
        if quoted is None:
            patience -= len(page) - start
        at = quoted.end() if quoted else page.find(">", tag.end()) + 1
        ends, name, rest = bool(tag[1]), tag[2].lower(), page[tag.end() : at - 1]
        if name in _RAW and not ends and not rest.endswith("/"):
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            if close is None:
                unclosed.add(name)
            if close is None and name in ("head", "template", "noscript", "object"):
                out.append((start, at, False, "", ""))
                continue
            at = close.end() if close else len(page)
            out.append((start, at, False, "", ""))
            continue
        out.append((start, at, ends, name, rest))
    return out


def _plain(chunk: str) -> str:
    return html.unescape(_HUGE.sub("&#99999999", chunk))


def lines_of(page: str) -> list[Line]:
    tags = _tags(page)
    matched = _matched(tags)
    walk, at = _Pages(), 0
    for start, end, ends, name, rest in tags:
        chunk = page[at:start]
        at = end
        if chunk:
            text = _plain(chunk)
            walk.text.append(text)
            if walk.links:
                walk.linked += len("".join(text.split()))
        if not name:
            continue
        if name == "a":
            walk.links = max(0, walk.links + (-1 if ends else 1))
        if name == "br" or name == "hr":
            walk.text.append(" ")
        if name in _VOID:
            continue
        if name not in _INLINE:
            walk.flush()
        if ends:
            _close(walk, name)
        elif not rest.endswith("/") or name in ("p", "div", "a"):
            _open(walk, name, rest, start in matched)
    tail = page[at:]
    if tail:
        walk.text.append(_plain(tail))
    walk.flush()
    return walk.lines


def _open(walk: _Pages, name: str, rest: str, closed: bool) -> None:
    if name in ("article", "main"):  # furniture that nobody closes ends here
        while walk.loose and walk.stack[walk.loose[0]].gone:
            walk.loose.popleft()
        if walk.loose:
            walk.cut(walk.loose[0])
    if name in _CLOSES:
        at = max(walk.last(x) for x in _CLOSES[name])
        if at >= 0 and at >= walk.stack[-1].scope:
            walk.cut(at)
    own = _attributes(rest)
    furniture = _furniture_of(name, own, walk.home > 0)
    home, at = walk.home, len(walk.stack)
    is_home = name in ("article", "main") or "articlebody" in rest.lower() or own.get("role", "").lower() == "main"
    if is_home and name not in _INLINE and not walk.furniture:
        walk.homes += 1
        home = home or walk.homes
    block = at if name not in _INLINE else walk.stack[-1].block if walk.stack else -1
    scope = at if name in _SCOPES else walk.stack[-1].scope if walk.stack else -1
    walk.push(_Open(name, furniture, home, block, scope), closed)


def _close(walk: _Pages, name: str) -> None:
    at = walk.last(name)
    if at < 0:
        return
    if name not in _INLINE:
        walk.cut(at)
    elif at > walk.stack[-1].block:
        walk.leave(at)
        walk.cut(len(walk.stack))


def weight(line: Line) -> int:
    size = len("".join(line.text.split()))
    return 0 if line.furniture or line.linked > LINK_SHARE * size else size


def surges(weights: list[int]) -> list[tuple[int, int]]:
    """[first, end) of every stretch between a surge point and its dive point."""
    total, sums = 0, []
    for i, w in enumerate(weights):
        total += w - (weights[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
    # window sums ending at i reach ahead; take the highest window that covers the line
    cover = [max(sums[i : i + WINDOW]) for i in range(len(sums))]
    level = min(max(cover, default=0) * SURGE, LEVEL)
    out, first = [], None
    for i, w in enumerate(weights):
        if first is None and w and cover[i] >= level:
            first = i
        elif first is not None and not any(weights[i : i + WINDOW]):
            out.append((first, i))
            first = None
    if first is not None:
        out.append((first, len(weights)))
    return out


def main_text(page: str) -> str:
    free = [x for x in lines_of(page) if not x.furniture]
    at_home = sum(weight(x) for x in free if x.home)
    if at_home:
        inside = at_home > HOME_SHARE * sum(map(weight, free))
        free = [x for x in free if bool(x.home) == inside]
    chosen = [False] * len(free)
    for first, end in surges([weight(x) for x in free]):
        chosen[first:end] = [True] * (end - first)
    # headings and paragraphs that adjoin, first those behind a surge, then those before
    joins = [x.kind in _TEXT_BLOCKS and not _mostly_links(x) for x in free]
    for i in range(1, len(free)):
        chosen[i] = chosen[i] or (joins[i] and chosen[i - 1])
    for i in range(len(free) - 2, -1, -1):
        chosen[i] = chosen[i] or (joins[i] and chosen[i + 1])
    homes = {x.home for x, c in zip(free, chosen) if c} - {0}
    return " ".join(x.text for x, c in zip(free, chosen) if (c and not _mostly_links(x)) or x.home in homes)


def _mostly_links(line: Line) -> bool:
    return line.linked > LINK_SHARE * len("".join(line.text.split()))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and its code points for every row of ``pages``."""
    rows = pages.select(pages[f"`{id_col}`"].alias("id"), pages[f"`{url_col}`"].alias("url"), pages[f"`{html_col}`"].alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    return rows.mapInArrow(_extract, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", "n_chars")
