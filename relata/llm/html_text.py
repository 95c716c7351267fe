"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their root-to-leaf tag path.  A path's
length ratio is its characters per node, its punctuation ratio its punctuation
marks per node, its link share the part of its characters inside links.  The
two ratios, taken along the page in node order, are smoothed with a Gaussian,
fused as a product and cut by links; nodes at or above ``CUT`` times the mean
are content nodes.  Elements that say what they are (navigation, footers,
adverts, comments ...) do not take part; what only a class, id or role says
(or <form>, <header>) does not hold for an element with most of the page's
score.  The content nodes, and no others,
vote for the element that holds the article; <article> and <main> are one vote
among these (``VOTE``).  All of that element's own text is returned, so that
short paragraphs and headings between content nodes stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUT = 0.5
#: An element holds the article if its content nodes have this part of the votes.
HOLDS = 0.8
#: What <article> and <main> are worth: this part of all votes, on top of those of their content nodes.
VOTE = 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>|<(?=[a-z/!?])[^>]*\Z", re.S | re.I)
#: Elements whose whole content goes, if they end: one that is closed in itself or never goes alone.
_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
                      r"|<(/?)(svg|math|object|select|button|noscript|template)(?=[\s/>])"
                      r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_SKIPS = frozenset("svg math object select button noscript template".split())
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟]")
_NAME = re.compile(r"[a-z]+")

# Elements of HTML and the words that name page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr br img".split())
_FURNITURE = frozenset("head nav footer aside dialog menu".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
                   "navigation menu menubar breadcrumb breadcrumbs footer sidebar aside complementary contentinfo widget "
                   "related recommended share sharing social cookie cookies consent gdpr notice notices alert popup modal "
                   "overlay newsletter subscribe signup login search comment comments discussion disqus replies respond "
                   "toolbar pagination pager skip copyright".split())
#: Words that a name of furniture may have beside those (``site-nav``, ``ad-2-box``, ``post-comments``).
_BESIDE = frozenset("site page main global top bottom left right box block bar area section item items list link links button "
                    "buttons icon icons wrap wrapper container inner outer post posts article articles entry story mobile "
                    "desktop".split())
_HEADER_NAMES = frozenset("header masthead topbar".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
           "option": ("option",)}
_LISTS = frozenset("ul ol dl table select".split())
_LEAVES = frozenset("p li td th tr blockquote pre".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class _Element:
    tag: str
    number: int
    furniture: bool
    root: int  # number of the outermost <article> (or <main>) it belongs to, 0 for none
    named: tuple[tuple[int, frozenset], ...] = ()  # number and names of the elements it is in that are named as furniture


@dataclass
class _Node:
    path: tuple[str, ...]
    holders: tuple[int, ...]
    block: int
    text: str
    link: bool
    root: int
    named: tuple[tuple[int, frozenset], ...]


@lru_cache(1 << 14)
def _furniture_name(name: str) -> bool:
    words = _NAME.findall(name)
    return any(w in _NAMES for w in words) and all(w in _NAMES or w in _BESIDE or len(w) == 1 for w in words)


def _names(attributes: str) -> tuple[frozenset, str, bool]:
    """The class names, ids and roles that name furniture (or a header), the role, and whether the element is hidden."""
    words, role, hidden = [], "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words += value.split()
        elif name in ("role", "itemprop"):
            role = role or value
            words += value.split()
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return frozenset(w for w in words if w in _HEADER_NAMES or _furniture_name(w)), role, hidden


def _skipped(page: str) -> dict[int, int]:
    """Where the elements start, and end, whose whole content goes."""
    opened: dict[str, list[int]] = defaultdict(list)
    ends: dict[int, int] = {}
    for m in _SKIPPED.finditer(page):
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if not m[2]:
            if not (tag in ("svg", "math") and m[4].endswith("/")):
                opened[tag].append(m.start())
        elif opened[tag]:
            ends[opened[tag].pop()] = m.end()
    return ends


def text_nodes(page: str) -> list[_Node]:
    """The page's text nodes, in order, but for those in elements that are furniture whatever they hold."""
    ends = _skipped(page)
    stack: list[_Element] = []
    nodes: list[_Node] = []
    block, number, link, at = 0, 0, False, 0

    def text(raw: str) -> None:
        if raw and not (stack and stack[-1].furniture):
            nodes.append(_Node(tuple(e.tag for e in stack), tuple(e.number for e in stack), block,
                               entities.unescape(raw), link, stack[-1].root if stack else 0, stack[-1].named if stack else ()))

    while m := _TOKEN.search(page, at):
        text(page[at:m.start()])
        at = ends.get(m.start(), m.end())
        close, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            if m[1] and m[1].lower() in ("textarea", "iframe"):
                text(" ")
            continue
        tag = tag.lower()
        if tag in _SKIPS:
            if tag in ("button", "select", "object"):
                text(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                link = not close
            elif tag in ("br", "img"):
                text(" ")
            if tag not in ("span", "label") or close or not attributes:
                continue
            words, _, hidden = _names(attributes)
            words -= _HEADER_NAMES
            if not (hidden or words):
                continue
            number += 1
            above = stack[-1] if stack else _Element("", 0, False, 0)
            stack.append(_Element(tag, number, hidden or above.furniture, above.root, above.named + ((number, words),) if words else above.named))
            continue
        block += 1
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        while stack and stack[-1].tag in ("span", "label"):
            stack.pop()
        if stack and stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, -1, -1):
            if tag not in _CLOSES or stack[i].tag in _LISTS:
                break
            if stack[i].tag in _CLOSES[tag]:
                del stack[i:]
                break
        if attributes.rstrip().endswith("/"):
            attributes = attributes.rstrip()[:-1]
        number += 1
        words, role, hidden = _names(attributes) if attributes.strip() else (frozenset(), "", False)
        above = stack[-1] if stack else _Element("", 0, False, 0)
        root, furniture, named = above.root, above.furniture or hidden or tag in _FURNITURE, above.named
        if tag == "article":
            words &= {"comment", "comments"}
        elif tag in ("html", "body", "main"):
            words = frozenset()
        elif root:
            words -= _HEADER_NAMES
        if tag == "form" or (tag == "header" and not root):
            words |= {tag}
        if words:
            named += ((number, words),)
        if not furniture and not root and ((tag in ("article", "main") and not words) or role in ("main", "article", "articlebody")):
            root = number
        stack.append(_Element(tag, number, furniture, root, named))
        if tag in ("p", "div", "li", "td"):
            link = False
    text(page[at:])
    return nodes


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "same")
    return np.convolve(x, kernel, "same")[:len(x)] / weight[:len(x)] if len(x) >= 5 else x


def path_scores(nodes: list[_Node]) -> np.ndarray:
    """Smoothed and fused tag-path ratios of every node (0 for blank nodes)."""
    sums: dict[tuple, np.ndarray] = defaultdict(lambda: np.zeros(4))
    sizes = [len(" ".join(n.text.split())) for n in nodes]
    for n, size in zip(nodes, sizes):
        if size:
            sums[n.path] += (1, size, len(_PUNCTUATION.findall(n.text)), size * n.link)
    length = np.array([sums[n.path][1] / sums[n.path][0] if s else 0.0 for n, s in zip(nodes, sizes)])
    marks = np.array([sums[n.path][2] / sums[n.path][0] if s else 0.0 for n, s in zip(nodes, sizes)])
    links = np.array([sums[n.path][3] / sums[n.path][1] if s else 1.0 for n, s in zip(nodes, sizes)])
    real = np.array([s > 0 for s in sizes], bool)
    out = np.zeros(len(nodes))
    if real.any():
        out[real] = _smooth(length[real]) * (1 + _smooth(marks[real])) * (1 - links[real])
    return out


def _without_furniture(nodes: list[_Node]) -> list[_Node]:
    """The nodes but for those in elements named as furniture.

    An element with ``HOLDS`` of the page's score stays in spite of its name,
    and so do elements that have so much together by one name.  If a part of
    the page is marked as its article, they need so much of that part, and
    ``VOTE`` less of the page.
    """
    if not any(n.named for n in nodes):
        return nodes
    scores = path_scores(nodes)
    total, marked = float(scores.sum()), float(sum(s for n, s in zip(nodes, scores) if n.root))

    def holding(keys_of) -> set:
        sums: dict = defaultdict(lambda: [0.0, 0.0])
        for n, s in zip(nodes, scores):
            for k in keys_of(n):
                sums[k][0] += s
                sums[k][1] += s * (n.root > 0)
        return {k for k, (s, m) in sums.items() if total and (
            m >= HOLDS * marked and s >= (HOLDS - VOTE) * total if marked else s >= HOLDS * total)}

    free = holding(lambda n: {e for e, _ in n.named})
    names = holding(lambda n: {w for e, ws in n.named if e not in free for w in ws})
    kept = [n for n in nodes if all(e in free or ws <= names for e, ws in n.named)]
    return kept if any(n.text.strip() for n in kept) else nodes


def _elected(nodes: list[_Node], scores: np.ndarray, content: np.ndarray) -> list[bool]:
    """The nodes of the element that the content nodes vote for.

    All <article> and <main> elements with content nodes count as one element,
    which has ``VOTE`` of all votes on top.  If it does not win, the deepest
    element that holds ``HOLDS`` of the votes does.
    """
    total = float(scores[content].sum())
    marked = np.array([n.root > 0 for n in nodes])
    if not total:  # nothing but links: the mark is the only vote
        return [bool(m) for m in marked]
    if float(scores[content & marked].sum()) + VOTE * total >= HOLDS * total:
        roots = {n.root for n, ok in zip(nodes, content) if ok and n.root}
        return [n.root in roots for n in nodes]
    votes: dict[int, float] = defaultdict(float)
    depth: dict[int, int] = {}
    tags: dict[int, str] = {}
    for n, s, ok in zip(nodes, scores, content):
        for d, h in enumerate(n.holders):
            if ok and n.path[d] not in _LEAVES and n.path[d] not in _HEADINGS:
                depth[h], tags[h] = d, n.path[d]
                votes[h] += s
    best = max((h for h in votes if votes[h] >= HOLDS * total), key=lambda h: depth[h], default=None)
    if best is not None and tags[best] not in ("html", "body"):
        return [best in n.holders for n in nodes]
    # no element but the page itself: the content paths, headings, and what lies between content nodes and is no link
    chosen = {n.path for n, ok in zip(nodes, content) if ok}
    at = np.flatnonzero(content)
    return [n.path in chosen or (i <= at[-1] and (bool(_HEADINGS & set(n.path)) or (i >= at[0] and scores[i] > 0)))
            for i, n in enumerate(nodes)]


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty if there is none."""
    nodes = _without_furniture(text_nodes(page)) if page else []
    real = np.array([bool(n.text.strip()) for n in nodes], bool)
    if not real.any():
        return ""
    scores = path_scores(nodes)
    keep = _elected(nodes, scores, real & (scores > 0) & (scores >= CUT * scores[real].mean()))
    blocks: dict[int, list[str]] = {}
    for n, k in zip(nodes, keep):
        if k:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: ``page_id, url, text, n_chars``.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are
    ignored.  A null or empty page, and one without main text, has an empty
    text.  Repeated rows come back as often as they occur; null ids and urls
    stay null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                texts = [main_text(x) for x in c.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), c.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
