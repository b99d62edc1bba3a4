"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block tags by one forward scan. Pass one decides each block by link density, length and stop-word
density: good, bad, near good, or short (too short to tell). What stands in a part that is no article by its tag or name (menus,
footers, forms, adverts, comments and the like) is bad. <article> and <main> are one feature more: where they hold at least half of
the page's dense text, blocks outside are bad, and fewer stop words make a block inside good; but a block inside that has few words
or stop words is as open as any other. Pass two lets open blocks inherit the label of their nearest decided neighbours, of those in
the same element before others; headings count with what follows them, and where nothing is decided open blocks stay.

Defined cases: null or empty html gives an empty text; unclosed tags end with the page or, for <p> and <li>, with the next block; a
"<" without a ">" after it is text; a quote in a tag that nothing closes shields nothing, from there to the end of the page; bytes
that are no markup are text; character references beyond Unicode are U+FFFD; repeated pages give a row each; null ids stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import common as C
from tidelog.llm.quality_rules import STOP_WORDS

MAX_LINK_DENSITY, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.35, 40, 140, 0.08, 0.15

# Tags whose content is no text, tags inside a line, tags of parts that are no article, tags without an end, headings,
# tags that end at the next one of their kind.
_RAW = frozenset("script style noscript template svg math iframe object textarea title".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_OUT = frozenset("nav footer aside form header menu button select head dialog".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SIBLINGS = frozenset("p li td tr dt dd option".split())
# Words in a class, id or role that name a part that is no article; the last of them don't where a word of the third row stands beside them.
_BAD = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice popup "
    "promo related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_BAD_ALONE = frozenset(["header"])
_OF_ARTICLE = frozenset("article content entry main post story".split())
_FRAME = frozenset(["article", "main"])

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _RAW}
_STOPS = frozenset(STOP_WORDS)
_SPACES = re.compile(r"\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LONG_NUMBER = re.compile(r"&#([0-9]{9,})")


class Block(NamedTuple):
    text: str
    #: Share of its characters in links.
    links: float
    heading: bool
    #: Inside a part that is no article.
    out: bool
    #: Inside <article> or <main>.
    article: bool
    #: Number of the element around it.
    element: int


def _named_out(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    for name in " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower().split():
        words = set(re.split("[_-]", name))
        if words & _BAD or words & _BAD_ALONE and not words & _OF_ARTICLE:
            return True
    return False


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    if "&#" in text:  # numbers of thousands of digits are more than int() takes
        text = _LONG_NUMBER.sub(lambda m: "&#" + (n if len(n := m[1].lstrip("0")) < 9 else "99999999"), text)
    return unescape(text)


class _Scanner:
    """Tags of a page in order; no character is looked at more than a few times, whatever the page holds."""

    def __init__(self, html: str):
        self.html, self.last, self.quotes = html, html.rfind(">"), True

    def _end(self, at: int) -> int:
        """Place of the > that ends the tag at this place."""
        first = self.html.find(">", at)
        if not self.quotes:
            return first
        m = _STOP.search(self.html, at)
        while m[0] != ">":
            close = self.html.find(m[0], m.end())
            m = _STOP.search(self.html, close + 1) if close >= 0 else None
            if m is None:
                self.quotes = False
                return first
        return m.start()

    def __iter__(self) -> Iterator[tuple[int, int, str | None, str]]:
        """(start, end, tag with / if it closes, attributes); tag is None where markup is only left out."""
        html, at = self.html, 0
        while True:
            at = html.find("<", at)
            if at < 0 or at > self.last and not html.startswith("<!--", at):
                return
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = len(html) if end < 0 else end + 3
                yield at, end, None, ""
            elif html.startswith(("<!", "<?"), at):
                end = html.find(">", at) + 1
                yield at, end, None, ""
            elif m := _NAME.match(html, at + 1):
                tag, close = m[0].lower(), self._end(m.end())
                end, attributes = close + 1, html[m.end() : close]
                if tag in _RAW and not attributes.endswith("/"):
                    stop = _RAW_END[tag].search(html, end)
                    end = stop.end() if stop else len(html)
                    yield at, end, None, ""
                else:
                    yield at, end, tag, attributes
            else:
                end = at + 1
            at = end


def blocks(html: str) -> list[Block]:
    """The blocks in page order."""
    found, parts = [], []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, no article, frame, number
    open_: dict[str, int] = {}
    outs = frames = linked = elements = 0
    in_link = heading = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", _decoded("".join(parts))).strip()
            if text:
                found.append(Block(text, min(1.0, linked / len(text)), heading, outs > 0, frames > 0, stack[-1][3] if stack else 0))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(_decoded(piece).strip())

    def pop() -> str:
        nonlocal outs, frames
        tag, out, frame, _ = stack.pop()
        open_[tag] -= 1
        outs -= out
        frames -= frame
        return tag

    at = 0
    for start, end, tag, attributes in _Scanner(html):
        if start > at:
            add(html[at:start])
        at = end
        if tag is None:
            continue
        closes, tag = tag[0] == "/", tag.removeprefix("/")
        named = not closes and _named_out(attributes)
        if tag in _INLINE and not (named and tag in ("span", "label")) and not (closes and open_.get(tag)):
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = not closes
            continue
        flush()
        if tag in _HEADINGS:
            heading = not closes
        if closes:
            if open_.get(tag):
                while pop() != tag:
                    pass
        elif tag not in _VOID and not attributes.rstrip().endswith("/"):
            heading = heading and tag in _HEADINGS
            if tag in _SIBLINGS and stack and stack[-1][0] == tag:
                pop()
            # A header inside an article belongs to it.
            out = tag in _OUT and not (tag == "header" and frames) or named and tag not in ("html", "body") and tag not in _FRAME
            elements += 1
            stack.append((tag, out, tag in _FRAME, (stack[-1][3] if stack else 0) if tag in _SIBLINGS or tag in _HEADINGS else elements))
            open_[tag] = open_.get(tag, 0) + 1
            outs += out
            frames += tag in _FRAME
    add(html[at:])
    flush()
    return found


def stop_density(text: str) -> float:
    """Share of stop words among the words that hold letters; signs around them don't count."""
    words = _LETTERS.findall(text.lower())
    return sum(w in _STOPS for w in words) / len(words) if words else 0.0


def _nearest(kinds: list[str], places: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each of these places the nearest decided one before and after it, itself left out."""
    before, after = {}, {}
    for order, into in ((places, before), (places[::-1], after)):
        last = None
        for i in order:
            if last is not None:
                into[i] = last
            last = i if kinds[i] in ("good", "bad") else last
    return before, after


def labels(found: list[Block]) -> list[bool]:
    """Which blocks belong to the main text."""
    stops = [stop_density(b.text) for b in found]
    dense = [0 if b.out or b.links > MAX_LINK_DENSITY or s < STOP_LOW else len(b.text) for b, s in zip(found, stops, strict=True)]
    inside = sum(n for n, b in zip(dense, found, strict=True) if b.article)
    framed = any(b.article and not b.out for b in found) and 2 * inside >= sum(dense)
    kinds = []
    for b, s in zip(found, stops, strict=True):
        if b.out or b.links > MAX_LINK_DENSITY or framed and not b.article:
            kinds.append("bad")
        elif b.heading or len(b.text) < SHORT:
            kinds.append("short")
        elif s >= (STOP_LOW if framed else STOP_HIGH) and (framed or len(b.text) >= LONG):
            kinds.append("good")
        elif s >= STOP_LOW:
            kinds.append("near")
        else:
            kinds.append("short" if framed or len(b.text) < LONG else "bad")
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        groups.setdefault(b.element, []).append(i)
    beside = [_nearest(kinds, places) for places in groups.values()]
    whole = _nearest(kinds, list(range(len(found))))
    near = [{k: v for sides in beside for k, v in sides[at].items()} for at in (0, 1)]
    follows = _nearest(kinds, [i for i, b in enumerate(found) if not b.out])[1]
    out = []
    for i, kind in enumerate(kinds):
        if kind in ("good", "bad"):
            out.append(kind == "good")
            continue
        own = i in near[0] or i in near[1]
        b, a = (near[0].get(i), near[1].get(i)) if own else (whole[0].get(i), whole[1].get(i))
        if framed and not own:  # in the article, with nothing decided in its element: only the article's other blocks speak
            sides = [kinds[k] for k in (b, a) if k is not None and found[k].article]
            out.append(not sides or "good" in sides)
        elif found[i].heading and i in follows:
            out.append(kinds[follows[i]] == "good")
        elif b is None or a is None:
            k = a if b is None else b
            out.append(k is None or kinds[k] == "good")
        elif kinds[b] == kinds[a]:
            out.append(kinds[b] == "good")
        else:
            out.append(kind == "near" or kinds[b if i - b < a - i else a] == "good")
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return " ".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html); n_chars in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b["page_id"], "url": b["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return C.mapped(pages.selectExpr("cast(page_id AS long) AS page_id", "cast(url AS string) AS url", "cast(html AS string) AS html"), run, "page_id long, url string, text string, n_chars long")
