"""Main text of web pages from flat text blocks (after Kohlschuetter, Fankhauser, Nejdl 2010).

A page becomes a flat list of text blocks: the text between block-level tags, with its number of words
and the share of them inside links. A decision tree looks at a block and at its two neighbours, and at
what the enclosing tags say (main region, page furniture, heading), and keeps or drops the block. The
tree is grown here from the small table of labelled blocks below.

Tags like ``nav`` and hidden elements are page furniture for certain. A class name or a ``form`` is a hint
only: where a page has no article outside the element, the hint is wrong (``has-sidebar`` on the wrapper of
an article, a form around a whole page) and ignored. Reader comments are never taken for the article as long
as there is any text outside them, however much longer they are, and do not count as a main region.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags by what they mean for the text.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas select textarea button audio video head title".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of class, id and role that mark page furniture.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination paywall popup promo promoted promotion recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)

#: Those of them that name reader comments.
COMMENTS = frozenset("comment comments disqus replies reply".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    main: bool
    heading: bool


#: What an element's tag and attributes make of it.
PLAIN, HINTED, COMMENT, CERTAIN = 0, 1, 2, 3
#: Words that a block of an article has at least, and the share of them inside links that it has at most, where hints are weighed.
ARTICLE_WORDS, ARTICLE_LINKS = 10, 0.5


@lru_cache(maxsize=4096)
def _furnishes(tag: str, attributes: str) -> int:
    """Whether an element is page furniture by its attributes."""
    if tag in ("html", "body"):
        return PLAIN
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|$)", _ATTRIBUTE.sub(" ", attributes)):
        return CERTAIN
    parts = {p.lower() for name in ("class", "id", "role") for p in _PARTS.findall(found.get(name, ""))}
    return COMMENT if parts & COMMENTS else HINTED if parts & HINTS else PLAIN


@dataclass(frozen=True)
class _Place:
    """What the open elements around a place say: the innermost one's tag, furniture for certain, the hints' numbers, main region, heading."""

    tag: str = ""
    certain: bool = False
    hints: tuple[int, ...] = ()
    main: bool = False
    heading: bool = False


def _settle(found: list[Block], places: list[_Place], hints: list[tuple[int, tuple[int, ...]]]) -> None:
    """Sets which blocks are furniture, once it is known which hints are wrong; each hint has its kind and the hints around it.

    Only blocks that may be an article's count. A hint is wrong if there are none outside its element, nor
    in a larger element that another hint names beside it; or if its element holds all of the main region
    and this has no fewer words than what is outside. Blocks in comments count for neither, and a hint at
    comments is wrong only if nothing outside them is left.
    """
    if not hints:
        for b, p in zip(found, places, strict=True):
            b.furniture = p.certain
        return
    spoken = {h for h, (kind, _) in enumerate(hints) if kind == COMMENT}
    counted = [(b.words, p) for b, p in zip(found, places, strict=True) if not p.certain and b.words >= ARTICLE_WORDS and b.linked < ARTICLE_LINKS * b.words]
    own = [(w, p) for w, p in counted if not spoken & set(p.hints)]
    main_total = sum(w for w, p in own if p.main)
    inside = [(sum(w for w, p in own if h in p.hints and p.main), sum(w for w, p in own if h in p.hints)) for h in range(len(hints))]
    wrong = []
    for h, (kind, around) in enumerate(hints):
        if kind == COMMENT:
            wrong.append(not any(w for w, p in counted if h not in p.hints and not (spoken - set(around)) & set(p.hints)))
            continue
        outside = sum(w for w, p in own if set(p.hints) <= set(around))
        beside = [inside[g] for g, (_, of) in enumerate(hints) if g not in spoken and g != h and g not in around and h not in of]
        holds_main = 0 < main_total == inside[h][0] and main_total >= outside
        wrong.append(holds_main or (not outside and inside[h] >= max(beside, default=(0, 0))))
    for b, p in zip(found, places, strict=True):
        b.furniture = p.certain or any(not wrong[h] for h in p.hints)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; comments and silent elements leave none."""
    found: list[Block] = []
    places: list[_Place] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[_Place] = []  # open elements, the innermost last
    hinted: list[tuple[int, tuple[int, ...]]] = []
    state, at, n = _Place(), 0, len(page)
    links = -1  # how many elements were open when a link began, -1 outside one

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            found.append(Block(words, len(words.split(" ")), len(html.unescape("".join(linked)).split()), False, state.main, state.heading))
            places.append(state)
        linked.clear()

    def close(tag: str) -> None:
        nonlocal state, links
        if any(s.tag == tag for s in stack):
            while stack.pop().tag != tag:
                pass
            state = stack[-1] if stack else _Place()
            if len(stack) < links:  # an element around the link has ended, so the link was left open
                links = -1

    while at < n:
        m = _TOKEN.search(page, at)
        rest = page[at : m.start() if m else n]
        if rest:
            text.append(rest)
            if links >= 0:
                linked.append(rest)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] if m[2] else m[4], (m[3] if m[2] else m[6]) or ""
        if tag in SILENT:
            if tag in BLOCK:
                flush()
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)" if tag != "head" else r"</head\b[^>]*(?:>|\Z)|(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else (n if tag != "head" else at)
            continue
        if tag == "a":  # without an address it is a place to link to
            links = len(stack) if not closing and re.search(r"\bhref\b", attributes, re.I) else -1
        elif tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                text.append(" ")
                if links >= 0:
                    linked.append(" ")
            continue
        if tag not in BLOCK and (tag == "a" or closing or not attributes or not _furnishes(tag, attributes)):
            if tag != "a" and closing and any(s.tag == tag for s in stack):  # an inline element that was furniture
                flush()
                close(tag)
            continue
        flush()
        if closing:
            close(tag)
            continue
        if tag in ("p", "li", "dd", "dt", "tr", "td", "th", "option") and stack and stack[-1].tag == tag:
            close(tag)  # closed by the next of its kind
        if stack and stack[-1].tag == "p":  # no block stands inside a paragraph
            close("p")
        kind = _furnishes(tag, attributes) if attributes else PLAIN
        # A header within the main region belongs to the article.
        certain = state.certain or kind == CERTAIN or (tag in FURNITURE and not (tag == "header" and state.main))
        hints = state.hints
        if not certain and (kind in (HINTED, COMMENT) or tag == "form"):
            hinted.append((kind or HINTED, hints))
            hints = (*hints, len(hinted) - 1)
        main = state.main or (tag in MAIN and kind != COMMENT) or ("main" in attributes.lower() and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I) is not None)
        state = _Place(tag, certain, hints, main, tag in HEADINGS)
        stack.append(state)
    flush()
    _settle(found, places, hinted)
    return found


# Labelled blocks: words, link density, the same of the block before and of the one after, region
# (1 in the main region, -1 outside the one that the page has, 0 where it has none), furniture, heading; content.
LABELLED = (
    (120, 0.00, 60, 0.00, 80, 0.00, 1, 0, 0, 1),
    (60, 0.05, 8, 0.00, 45, 0.00, 1, 0, 0, 1),
    (3, 0.00, 90, 0.00, 70, 0.02, 1, 0, 0, 1),
    (1, 0.00, 0, 0.00, 30, 0.00, 1, 0, 0, 1),
    (1, 0.00, 5, 0.00, 0, 0.00, 1, 0, 0, 1),
    (9, 0.00, 0, 0.00, 60, 0.00, 1, 0, 1, 1),
    (2, 0.00, 3, 1.00, 4, 0.00, 1, 0, 1, 1),
    (14, 0.40, 50, 0.00, 60, 0.10, 1, 0, 0, 1),
    (25, 0.80, 50, 0.10, 20, 0.00, 1, 0, 0, 1),
    (4, 1.00, 60, 0.00, 40, 0.00, 1, 0, 0, 1),
    (2, 0.00, 1, 1.00, 1, 1.00, 1, 0, 0, 1),
    (400, 0.01, 9, 0.00, 3, 1.00, 1, 0, 0, 1),
    (6, 1.00, 4, 1.00, 3, 1.00, 1, 1, 0, 0),
    (30, 0.00, 50, 0.00, 2, 1.00, 1, 1, 0, 0),
    (12, 0.10, 70, 0.00, 60, 0.00, 1, 1, 0, 0),
    (5, 0.00, 200, 0.00, 0, 0.00, 1, 1, 1, 0),
    (90, 0.02, 20, 0.00, 60, 0.00, 1, 1, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, -1, 1, 0, 0),
    (14, 0.00, 1, 1.00, 9, 0.00, -1, 1, 0, 0),
    (40, 0.00, 100, 0.00, 0, 0.00, -1, 1, 0, 0),
    (9, 0.00, 100, 0.00, 0, 0.00, -1, 0, 0, 0),
    (60, 0.00, 70, 0.00, 60, 0.00, -1, 0, 0, 0),
    (3, 0.00, 1, 1.00, 20, 0.00, -1, 0, 1, 0),
    (2, 1.00, 2, 1.00, 2, 1.00, -1, 0, 0, 0),
    (25, 0.10, 2, 1.00, 14, 0.00, -1, 0, 0, 0),
    (80, 0.00, 40, 0.00, 60, 0.00, 0, 0, 0, 1),
    (35, 0.10, 6, 0.00, 90, 0.00, 0, 0, 0, 1),
    (20, 0.00, 2, 1.00, 30, 0.00, 0, 0, 0, 1),
    (16, 0.20, 40, 0.00, 3, 1.00, 0, 0, 0, 1),
    (6, 0.00, 40, 0.00, 50, 0.00, 0, 0, 0, 1),
    (5, 0.00, 60, 0.00, 30, 0.05, 0, 0, 0, 1),
    (4, 0.00, 1, 1.00, 45, 0.00, 0, 0, 1, 1),
    (8, 0.00, 0, 0.00, 25, 0.00, 0, 0, 1, 1),
    (3, 0.00, 30, 0.00, 60, 0.00, 0, 0, 1, 1),
    (12, 0.00, 45, 0.00, 0, 0.00, 0, 0, 0, 1),
    (150, 0.25, 3, 1.00, 2, 1.00, 0, 0, 0, 1),
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0),
    (12, 0.90, 8, 1.00, 10, 0.95, 0, 0, 0, 0),
    (30, 0.70, 5, 1.00, 9, 0.80, 0, 0, 0, 0),
    (18, 0.60, 40, 0.00, 3, 1.00, 0, 0, 0, 0),
    (4, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0),
    (5, 0.00, 2, 1.00, 4, 0.00, 0, 0, 0, 0),
    (2, 0.00, 4, 0.00, 3, 0.50, 0, 0, 1, 0),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 1, 0),
    (7, 0.40, 3, 1.00, 0, 0.00, 0, 0, 0, 0),
    (60, 0.00, 40, 0.00, 60, 0.00, 0, 1, 0, 0),
    (6, 0.00, 50, 0.00, 2, 1.00, 0, 1, 0, 0),
    (20, 0.05, 1, 1.00, 30, 0.00, 0, 1, 0, 0),
    (4, 0.00, 0, 0.00, 40, 0.00, 0, 1, 1, 0),
    (110, 0.30, 90, 0.05, 90, 0.05, 0, 0, 0, 1),
    (18, 0.00, 20, 0.90, 90, 0.05, 0, 0, 0, 1),
    (14, 0.00, 90, 0.05, 6, 0.00, 0, 0, 0, 1),
    (14, 0.00, 20, 0.90, 0, 0.00, 0, 0, 0, 1),
    (60, 0.20, 4, 1.00, 0, 0.00, 0, 0, 0, 1),
    (12, 0.00, 0, 0.00, 3, 0.00, 0, 0, 0, 1),
    (18, 0.30, 0, 0.00, 90, 0.05, 0, 0, 0, 1),
    (40, 0.20, 3, 0.00, 20, 0.90, 0, 0, 0, 1),
    (18, 0.05, 90, 0.05, 0, 0.00, 0, 0, 0, 1),
    (12, 0.20, 6, 0.00, 40, 0.00, 0, 0, 0, 1),
    (12, 0.05, 15, 0.00, 3, 0.00, 0, 0, 0, 1),
    (25, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 1),
    (60, 0.00, 6, 0.00, 40, 0.00, 0, 0, 0, 1),
    (18, 0.00, 90, 0.05, 40, 0.00, 0, 0, 0, 1),
    (60, 0.20, 2, 1.00, 3, 0.00, 0, 0, 0, 1),
    (25, 0.05, 2, 1.00, 6, 0.00, 0, 0, 0, 1),
    (40, 0.00, 40, 0.00, 2, 1.00, 0, 0, 0, 1),
    (14, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 1),
    (11, 0.20, 90, 0.05, 4, 1.00, 0, 0, 0, 1),
    (18, 0.20, 20, 0.90, 3, 0.00, 0, 0, 0, 1),
    (14, 0.20, 40, 0.00, 2, 1.00, 0, 0, 0, 1),
    (60, 0.20, 3, 0.00, 0, 0.00, 0, 0, 0, 1),
    (25, 0.30, 6, 0.00, 0, 0.00, 0, 0, 0, 1),
    (18, 0.00, 40, 0.00, 2, 1.00, 0, 0, 0, 1),
    (11, 0.00, 3, 0.00, 90, 0.05, 0, 0, 0, 1),
    (25, 0.00, 15, 0.00, 6, 0.00, 0, 0, 0, 1),
    (60, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 1),
    (18, 0.30, 3, 0.00, 0, 0.00, 0, 0, 0, 1),
    (40, 0.05, 90, 0.05, 4, 1.00, 0, 0, 0, 1),
    (110, 0.30, 4, 1.00, 40, 0.00, 0, 0, 0, 1),
    (14, 0.00, 6, 0.00, 3, 0.00, 0, 0, 0, 1),
    (18, 0.00, 4, 1.00, 20, 0.90, 0, 0, 0, 1),
    (18, 0.20, 90, 0.05, 2, 1.00, 0, 0, 0, 1),
    (11, 0.30, 6, 0.00, 3, 0.00, 0, 0, 0, 1),
    (60, 0.05, 40, 0.00, 90, 0.05, 0, 0, 0, 1),
    (25, 0.30, 4, 1.00, 2, 1.00, 0, 0, 0, 1),
    (2, 0.60, 20, 0.90, 2, 1.00, 0, 0, 1, 0),
    (4, 0.60, 0, 0.00, 2, 1.00, 0, 0, 0, 0),
    (4, 1.00, 3, 0.00, 0, 0.00, 0, 0, 1, 0),
    (1, 0.60, 15, 0.00, 20, 0.90, 0, 0, 0, 0),
    (12, 0.60, 15, 0.00, 4, 1.00, 0, 0, 0, 0),
    (8, 0.80, 0, 0.00, 0, 0.00, 0, 0, 0, 0),
    (12, 0.50, 2, 1.00, 6, 0.00, 0, 0, 1, 0),
    (4, 0.60, 2, 1.00, 90, 0.05, 0, 0, 0, 0),
    (12, 0.80, 4, 1.00, 15, 0.00, 0, 0, 0, 0),
    (4, 0.50, 2, 1.00, 40, 0.00, 0, 0, 1, 0),
    (45, 0.50, 0, 0.00, 40, 0.00, 0, 0, 1, 0),
    (8, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (1, 0.50, 40, 0.00, 15, 0.00, 0, 0, 0, 0),
    (8, 1.00, 90, 0.05, 90, 0.05, 0, 0, 1, 0),
    (45, 1.00, 20, 0.90, 20, 0.90, 0, 0, 0, 0),
    (1, 0.80, 90, 0.05, 0, 0.00, 0, 0, 0, 0),
    (2, 0.50, 90, 0.05, 6, 0.00, 0, 0, 1, 0),
    (1, 0.80, 4, 1.00, 3, 0.00, 0, 0, 0, 0),
    (12, 0.60, 90, 0.05, 90, 0.05, 0, 0, 0, 0),
    (2, 0.80, 6, 0.00, 3, 0.00, 0, 0, 1, 0),
    (20, 1.00, 3, 0.00, 40, 0.00, 0, 0, 0, 0),
    (2, 0.00, 3, 0.00, 4, 1.00, 0, 0, 1, 0),
    (2, 0.00, 15, 0.00, 0, 0.00, 0, 0, 1, 1),
    (9, 0.00, 6, 0.00, 4, 1.00, 0, 0, 0, 0),
    (1, 0.00, 90, 0.05, 6, 0.00, 0, 0, 1, 1),
    (2, 0.00, 40, 0.00, 20, 0.90, 0, 0, 1, 1),
    (5, 0.00, 90, 0.05, 15, 0.00, 0, 0, 1, 1),
    (1, 0.00, 6, 0.00, 0, 0.00, 0, 0, 0, 0),
    (9, 0.00, 15, 0.00, 6, 0.00, 0, 0, 1, 1),
    (9, 0.00, 4, 1.00, 40, 0.00, 0, 0, 0, 1),
    (5, 0.00, 0, 0.00, 6, 0.00, 0, 0, 0, 0),
    (2, 0.00, 0, 0.00, 2, 1.00, 0, 0, 0, 0),
    (5, 0.00, 20, 0.90, 15, 0.00, 0, 0, 0, 1),
    (1, 0.00, 3, 0.00, 90, 0.05, 0, 0, 0, 1),
    (3, 0.00, 0, 0.00, 90, 0.05, 0, 0, 0, 1),
    (7, 0.00, 4, 1.00, 3, 0.00, 0, 0, 0, 0),
    (3, 0.00, 20, 0.90, 20, 0.90, 0, 0, 1, 0),
    (7, 0.00, 40, 0.00, 3, 0.00, 0, 0, 0, 1),
    (1, 0.00, 40, 0.00, 4, 1.00, 0, 0, 1, 1),
    (5, 0.00, 3, 0.00, 0, 0.00, 0, 0, 1, 0),
    (9, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (2, 0.00, 40, 0.00, 2, 1.00, 0, 0, 0, 1),
    (3, 0.00, 6, 0.00, 0, 0.00, 0, 0, 1, 0),
    (3, 0.00, 6, 0.00, 90, 0.05, 0, 0, 1, 1),
    (1, 0.00, 2, 1.00, 40, 0.00, 0, 0, 0, 1),
    (1, 0.00, 20, 0.90, 15, 0.00, 0, 0, 0, 1),
    (9, 0.00, 90, 0.05, 4, 1.00, 0, 0, 0, 1),
    (7, 0.00, 90, 0.05, 2, 1.00, 0, 0, 1, 1),
    (2, 0.00, 20, 0.90, 20, 0.90, 0, 0, 1, 0),
    (3, 0.00, 20, 0.90, 20, 0.90, 0, 0, 0, 0),
    (7, 0.00, 6, 0.00, 40, 0.00, 0, 0, 1, 1),
    (7, 0.00, 6, 0.00, 4, 1.00, 0, 0, 0, 0),
    (7, 0.00, 90, 0.05, 3, 0.00, 0, 0, 1, 1),
    (5, 0.00, 20, 0.90, 0, 0.00, 0, 0, 0, 0),
    (7, 0.00, 0, 0.00, 20, 0.90, 0, 0, 1, 0),
    (1, 0.00, 20, 0.90, 2, 1.00, 0, 0, 1, 0),
    (5, 0.00, 4, 1.00, 2, 1.00, 0, 0, 0, 0),
    (7, 0.00, 40, 0.00, 40, 0.00, 0, 0, 1, 1),
    (3, 0.00, 90, 0.05, 90, 0.05, 0, 0, 0, 1),
    (2, 0.00, 40, 0.00, 90, 0.05, 0, 0, 1, 1),
    (7, 0.00, 2, 1.00, 3, 0.00, 0, 0, 1, 0),
    (5, 0.00, 6, 0.00, 4, 1.00, 0, 0, 0, 0),
    (9, 0.00, 0, 0.00, 3, 0.00, 0, 0, 0, 0),
    (2, 0.00, 0, 0.00, 6, 0.00, 0, 0, 0, 0),
    (3, 0.00, 3, 0.00, 90, 0.05, 0, 0, 1, 1),
    (1, 0.00, 6, 0.00, 3, 0.00, 0, 1, 1, 0),
    (70, 0.00, 40, 0.00, 20, 0.90, 0, 1, 0, 0),
    (70, 0.00, 20, 0.90, 3, 0.00, 0, 1, 1, 0),
    (70, 0.00, 15, 0.00, 4, 1.00, 0, 1, 0, 0),
    (6, 1.00, 3, 0.00, 3, 0.00, 1, 1, 0, 0),
    (1, 0.00, 2, 1.00, 6, 0.00, 0, 1, 0, 0),
    (20, 0.00, 20, 0.90, 4, 1.00, 1, 1, 0, 0),
    (3, 0.00, 3, 0.00, 15, 0.00, 0, 1, 0, 0),
    (6, 0.00, 3, 0.00, 2, 1.00, 1, 1, 1, 0),
    (20, 0.00, 20, 0.90, 20, 0.90, 0, 1, 0, 0),
    (70, 0.00, 4, 1.00, 2, 1.00, 0, 1, 0, 0),
    (3, 0.00, 2, 1.00, 0, 0.00, 0, 1, 0, 0),
    (3, 1.00, 2, 1.00, 15, 0.00, 1, 1, 0, 0),
    (20, 0.00, 15, 0.00, 40, 0.00, 1, 1, 1, 0),
    (2, 0.30, 0, 0.00, 3, 0.00, 1, 0, 0, 1),
    (2, 1.00, 15, 0.00, 15, 0.00, 1, 0, 0, 1),
    (9, 0.00, 4, 1.00, 2, 1.00, 1, 0, 1, 1),
    (30, 0.00, 2, 1.00, 40, 0.00, 1, 0, 0, 1),
    (30, 0.00, 15, 0.00, 6, 0.00, 1, 0, 1, 1),
    (5, 0.00, 4, 1.00, 40, 0.00, 1, 0, 1, 1),
    (2, 0.30, 15, 0.00, 40, 0.00, 1, 0, 1, 1),
    (2, 1.00, 4, 1.00, 2, 1.00, 1, 0, 0, 0),
    (3, 1.00, 2, 1.00, 4, 1.00, 1, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 0),
    (2, 1.00, 6, 0.00, 2, 1.00, 1, 0, 0, 0),
    (1, 1.00, 2, 1.00, 60, 0.00, 1, 0, 0, 0),
    (2, 1.00, 60, 0.00, 2, 1.00, 1, 0, 0, 0),
    (2, 1.00, 2, 1.00, 0, 0.00, 1, 0, 0, 0),
    (6, 1.00, 5, 1.00, 6, 1.00, 1, 0, 0, 0),
    (2, 0.00, 0, 0.00, 20, 0.00, 0, 0, 1, 1),
    (5, 0.00, 0, 0.00, 14, 0.00, 0, 0, 1, 1),
    (2, 0.00, 3, 1.00, 20, 0.00, 0, 0, 1, 1),
    (5, 0.00, 2, 1.00, 14, 0.00, 0, 0, 1, 1),
    (30, 1.00, 5, 1.00, 40, 0.00, 1, 0, 0, 0),
    (5, 0.30, 2, 1.00, 0, 0.00, 1, 0, 0, 1),
    (5, 0.00, 6, 0.00, 6, 0.00, 1, 0, 0, 1),
    (5, 0.00, 40, 0.00, 4, 1.00, 1, 0, 1, 1),
    (30, 0.00, 20, 0.90, 90, 0.05, 1, 0, 0, 1),
    (5, 1.00, 40, 0.00, 0, 0.00, -1, 0, 0, 0),
    (1, 1.00, 3, 0.00, 6, 0.00, -1, 0, 0, 0),
    (70, 0.00, 0, 0.00, 3, 0.00, -1, 0, 1, 0),
    (70, 0.00, 6, 0.00, 6, 0.00, -1, 0, 0, 0),
    (12, 0.00, 20, 0.90, 20, 0.90, -1, 0, 1, 0),
    (70, 1.00, 2, 1.00, 90, 0.05, -1, 0, 1, 0),
    (1, 1.00, 0, 0.00, 40, 0.00, -1, 0, 1, 0),
    (5, 0.00, 4, 1.00, 90, 0.05, -1, 0, 0, 0),
)


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple | int:
    """A tree of (feature, threshold, low side, high side) by Gini impurity; a leaf is the majority."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < t
            impurity = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (low, ~low))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, float(t))
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, t = best
    low = x[:, f] < t
    return f, t, _grow(x[low], y[low], depth - 1), _grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | int:
    table = np.array(LABELLED, dtype=np.float64)
    return _grow(table[:, :-1], table[:, -1], 10)


def keeps(features: tuple[float, ...], node: tuple | int) -> bool:
    while not isinstance(node, int):
        node = node[2] if features[node[0]] < node[1] else node[3]
    return bool(node)


def main_text(page: str) -> str:
    """The kept blocks of a page, joined by line ends."""
    found = blocks(page)
    has_main = any(b.main and not b.furniture for b in found)
    size = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    grown = tree()
    return "\n".join(b.text for i, b in enumerate(found) if keeps((*size[i + 1], *size[i], *size[i + 2], (1 if b.main else -1) if has_main else 0, b.furniture, b.heading), grown))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) if p else "" for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (kept blocks joined by line ends, empty if none) and n_chars.

    Character references are decoded and white space inside a block becomes one space; a ``br`` counts
    as white space. Null or empty html has an empty text. Markup that ends in the middle of a tag or
    comment is read as if it were closed there. Rows are judged one by one. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
