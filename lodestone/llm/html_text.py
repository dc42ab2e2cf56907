"""Main text of HTML pages by minimum-cut labelling of text blocks.

A page is cut into blocks at block-level tags. A linear classifier over a block's ancestors, link share, length and
punctuation gives a signed cost, which becomes the block's capacity to the source (content) or to the sink
(boilerplate). Neighbours in page order and neighbours under the same parent are joined by smoothness edges. The
minimum cut - found by blocking flows - labels the blocks; content blocks are joined in page order.

Markup is read in linear time: attribute values are quoted only after an equals sign; scripts, styles, titles and text
areas run to their end tag or the end of the page; other elements without readable text (drawings, menus, media) are
skipped when they have an end tag, else only their start tag is. A tag that never ends, or a quote that is never
closed, makes the reader go on without quotes: each later tag ends at its first ``>``.

Null or empty html gives the empty text; broken markup (open tags, missing ends) is read as far as it goes; rows are
independent, so repeated rows and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches, spread

#: A start or end tag with HTML's rules for quotes; no part is ever read twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))*+)>""")
BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Elements whose content is no markup, and elements whose content is no text of the page.
RAW = frozenset("script style title textarea".split())
SKIPPED = frozenset("svg iframe object select canvas audio video noscript template".split())
STOP_MARK = re.compile(r"[.!?](?:\s|$)")
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INLINE = frozenset("a abbr acronym annotation b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext q semantics s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new element of the same kind closes.
SIBLINGS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
#: Boilerplate elements and roles; words in class and id that mark boilerplate or content.
AWAY = frozenset("nav aside footer form menu dialog button head fieldset".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist discussion disqus replies reply respond sidebar rail nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead toolbar topbar "
    "share sharing social follow newsletter subscribe subscription signup login related recommended recommendations trending widget widgets pagination pager skip search banner tags copyright legal disclaimer".split()
)
SOFT_WORDS = frozenset("alert header sidebar widget notice tags banner search".split())
HOME_WORDS = frozenset("article content main body post entry story text prose maintext".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Weights of the block classifier.
BIAS, IN_ARTICLE, HOME, TEXT_TAG, PER_TEN_WORDS, STOP, LINKS, AWAY_COST, HEADER_COST = -1.0, 3.0, 1.5, 1.0, 1.0, 0.5, -5.0, -16.0, -8.0
#: Smoothness between blocks that follow each other, and that do so under one parent.
NEXT, SAME_PARENT = 0.6, 1.2


@dataclass
class Element:
    tag: str
    cost: float
    article: bool
    number: int


@dataclass
class Block:
    text: str
    score: float
    parent: int


def element_cost(tag: str, attributes: str, in_article: bool) -> float:
    cost = 0.0
    if tag in AWAY:
        cost += AWAY_COST
    elif tag == "header":
        cost += HEADER_COST / 8 if in_article else AWAY_COST
    if attributes and attributes.strip(" /"):
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                words = set(re.split(r"[^a-z]+", value))
                away, home = words & AWAY_WORDS, words & HOME_WORDS
                if away - SOFT_WORDS or (away and not home):
                    cost += AWAY_COST if not (in_article and away <= {"header", "tags"}) else HEADER_COST / 8
                elif home:
                    cost += HOME
            elif name == "role":
                cost += AWAY_COST if value in AWAY_ROLES else HOME if value in ("main", "article") else 0.0
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                cost += AWAY_COST
    return cost


def spans_of(page: str, tag: str) -> dict[int, int]:
    """Where each element of this name that has an end tag starts, and where it ends."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*+>", page, re.I):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def tokens(page: str) -> Iterator[tuple[str, tuple[str, str, str] | str | None]]:
    """The text before each token, and the token: (slash, name, attributes) of a tag, a blank for a raw element, or nothing."""
    at = start = 0  # what is read; what is handed out
    tag_of = TAG
    known: dict[str, dict[int, int]] = {}
    while (at := page.find("<", at)) >= 0:
        follows = page[at + 1 : at + 3]
        if follows[:1] in ("!", "?"):
            comment = page.startswith("<!--", at)
            end = page.find("-->" if comment else ">", at + (4 if comment else 2))
            yield page[start:at], None
            at = start = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        if not (follows[:1].isascii() and follows[:1].isalpha()) and not (follows[:1] == "/" and follows[1:].isascii() and follows[1:].isalpha()):
            at += 1
            continue
        m = tag_of.match(page, at)
        if m is None and tag_of is TAG:
            tag_of = BARE_TAG
            m = tag_of.match(page, at)
        if m is None:  # a tag that the page's end cuts off
            yield page[start:at], None
            start = len(page)
            break
        yield page[start:at], None
        tag, end = m[2].lower(), m.end()
        if tag in RAW and not m[1]:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, end)
            yield "", " "
            at = start = close.end() if close else len(page)
            continue
        if tag in SKIPPED:
            if tag not in known:
                known[tag] = spans_of(page, tag)
            at = start = known[tag].get(at, end)
            continue
        yield "", (m[1], tag, m[3])
        at = start = end
    yield page[start:], None


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, each with its classifier score and parent element."""
    stack: list[Element] = [Element("", 0.0, False, 0)]
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    links = 0  # open <a> elements
    made = 0
    opened: Counter[str] = Counter()

    def pop() -> Element:
        opened[stack[-1].tag] -= 1
        return stack.pop()

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, score(text, min(1.0, linked / max(1, len(text)))), stack[-1].number))
            parts.clear()
        linked = 0

    def score(text: str, link_share: float) -> float:
        top = stack[-1]
        words = text.count(" ") + 1
        s = BIAS + top.cost + min(words, 60) / 10 * PER_TEN_WORDS * (1 - link_share) + LINKS * link_share
        s += STOP * sum(1 for _ in islice(STOP_MARK.finditer(text), 3))
        if top.tag == "p" or top.tag in HEADINGS or top.tag in ("blockquote", "pre"):
            s += TEXT_TAG
        return s + (IN_ARTICLE if top.article else 0.0)

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    for text, m in tokens(page):
        add(text)
        if m is None:
            continue
        if m == " ":
            parts.append(" ")
            continue
        ending, tag, attributes = m
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if ending else 1))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        close()
        if ending:
            if opened[tag]:
                links = 0
                while pop().tag != tag:
                    pass
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            pop()
        if stack[-1].tag in SIBLINGS.get(tag, ()):
            pop()
        top = stack[-1]
        article = top.article or tag in ("article", "main")
        made += 1
        opened[tag] += 1
        stack.append(Element(tag, top.cost + element_cost(tag, attributes, top.article), article, made if tag not in ("p", "li") and tag not in HEADINGS else top.number))
    close()
    return out


def source_side(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: node i pays |gain[i]| on the side that its sign speaks against, an edge its weight when cut.

    Blocking flows (Dinic) over the residual network; flow from a node's own source to its own sink is implied.
    """
    n = len(gain)
    if all(g > 0 for g in gain) or all(g <= 0 for g in gain):
        return [g > 0 for g in gain]
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]
    s, t = n, n + 1

    def edge(a: int, b: int, forward: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(s, i, g, 0.0)
        elif g < 0:
            edge(i, t, -g, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            for e in out[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        place = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while place[v] < len(out[v]):
                e = out[v][place[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                place[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                place[v] += 1
                continue
            path.append(e)
            v = to[e]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    edges = [(i, i + 1, NEXT) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    content = source_side([b.score for b in blocks], edges)
    return " ".join(b.text for b, keep in zip(blocks, content) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(spread(source), one, "page_id long, url string, text string, n_chars long")
