"""Main text of web pages by minimum cut.

A page becomes a list of text blocks. A small classifier gives each block a cost for being called
content and one for being called boilerplate (terminal capacities); neighbouring blocks and blocks that
are close in the element tree are tied together (smoothness edges). The minimum cut of that graph
is the cheapest labelling; the blocks on the source side are the text. Pages are independent: no shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

_HREF = re.compile(r"(?<![\w-])href(?![\w-])", re.IGNORECASE)

#: Kinds of elements, and words in class, id and role that tell what one holds.
RAW = frozenset("script style noscript template textarea title iframe object svg annotation select option button canvas audio video head datalist".split())
#: Of these, elements that take the rest of a page if they have no end tag, and controls that can't be nested.
SWALLOW = frozenset("script style template textarea title iframe".split())
CONTROLS = frozenset("button option select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an end tag inside them can't see beyond.
SCOPES = frozenset("article aside body div footer form header main nav section table td th".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog search fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disclaimer "
    "discussion disqus footer header legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion recommended recommendations related replies reply respond search share sharing sidebar signup sitemap skip social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets alert complementary contentinfo gdpr".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post posttext story text".split())


#: Words that make a class name speak of a state or an absence ("no-comments", "with-sidebar"), not of what an element holds.
STATE_WORDS = frozenset("with without no not has is hide hidden show open closed enabled disabled on off".split())
COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Last words of a class name that make it speak of the whole page ("tags-page", "sidebar-layout").
PAGE_WORDS = frozenset("page template layout theme site".split())
#: Elements that may wrap a whole page, and what such a wrapper holds.
WRAPPERS = frozenset("form fieldset".split())
FURNITURE = frozenset("header nav footer aside main article h1".split())
#: What an element says of its contents. STRICT and GONE hold for all that is inside, LOOSE unless the element is a wrapper (see Tree.hints).
CONTENT, NOTHING, LOOSE, STRICT, GONE = 2, 0, -1, -2, -3


class Block(NamedTuple):
    text: str
    tag: str
    node: int  # its element, -1 for none
    hint: int  # 1 inside an article, -1 inside boilerplate, else 0
    linked: int  # characters inside links


class Tree:
    """The block elements of a page, numbered in order of their start tags, so that parents come first."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.tag: list[str] = []
        self.says: list[int] = []

    def add(self, tag: str, attrs: str, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 1)
        self.tag.append(tag)
        self.says.append(element_says(tag, attrs))
        return len(self.parent) - 1

    def hints(self, own: list[int]) -> list[int]:
        """1, 0 or -1 for each element, from what it and those around it say; `own`: characters of its own blocks.

        An element that is boilerplate by its name or kind is a wrapper, and says nothing, if it holds the page's content elements, all of
        them; or if it is a form around page furniture; or if it holds all text that is not in other boilerplate. Its length does not matter.
        """
        n = len(self.parent)
        shut, inside = [False] * n, [False] * n  # within sure boilerplate; within content
        for k, says in enumerate(self.says):
            up = self.parent[k]
            inside[k] = says == CONTENT or (up >= 0 and inside[up])
            shut[k] = says in (STRICT, GONE) or (up >= 0 and shut[up]) or (self.tag[k] == "header" and not inside[k])
        free = [0 if shut[k] else own[k] for k in range(n)]
        content = [int(says == CONTENT and not shut[k]) for k, says in enumerate(self.says)]
        furnished = [False] * n
        all_free, all_content = sum(free), sum(content)
        for k in range(n - 1, 0, -1):
            if (up := self.parent[k]) >= 0:
                free[up] += free[k]
                content[up] += content[k]
                furnished[up] = furnished[up] or furnished[k] or self.tag[k] in FURNITURE
        out: list[int] = []
        for k, says in enumerate(self.says):
            around = out[self.parent[k]] if self.parent[k] >= 0 else 0
            wraps = 0 < content[k] == all_content or 0 < free[k] == all_free or (self.tag[k] in WRAPPERS and furnished[k])
            if around < 0 or says in (STRICT, GONE) or (says == LOOSE and not wraps):
                around = -1
            elif self.tag[k] == "header" and around == 0:
                around = -1
            elif says == CONTENT:
                around = 1
            out.append(around)
        return out

    def distance(self, a: int, b: int, most: int = 64) -> int:
        """Steps between two elements, `most` if there are more."""
        steps = 0
        while a != b and steps < most:
            if b < 0 or (a >= 0 and self.depth[a] >= self.depth[b]):
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def element_says(tag: str, attrs: str) -> int:
    """What an element's tag and attributes say of its contents."""
    if tag in BOILER_TAGS and tag not in WRAPPERS:
        return STRICT
    tokens: set[str] = set()
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                return GONE
            if name in ("class", "id", "role"):
                tokens |= set(value.split())
    plain = {t.rstrip("0123456789") for t in tokens}
    words = {w for t in tokens for parts in [re.split(r"[^a-z0-9]+", t)] if not STATE_WORDS & set(parts) and parts[-1] not in PAGE_WORDS for p in parts for w in (p, p.rstrip("0123456789"))}
    if words & COMMENT_WORDS and not (plain & CONTENT_WORDS and not plain & COMMENT_WORDS):
        return GONE
    if tag == "article":
        return STRICT if words & {"related", "promo"} else CONTENT
    if tag == "main":
        return CONTENT
    if words & BOILER_WORDS and not (plain & CONTENT_WORDS and not plain & BOILER_WORDS):
        return LOOSE
    if words & CONTENT_WORDS:
        return CONTENT
    return LOOSE if tag in WRAPPERS else NOTHING


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; forgiving about missing and stray end tags."""
    return page_blocks(page)[0]


def page_blocks(page: str) -> tuple[list[Block], Tree]:
    """The blocks and the elements that they are in."""
    out: list[Block] = []
    tree = Tree()
    stack: list[int] = []
    opened: Counter[str] = Counter()  # tags on the stack
    pending: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(page)
    unclosed: set[str] = set()  # raw elements without any end tag from here on

    def close(k: int) -> None:
        opened.subtract(tree.tag[n] for n in stack[k:])
        del stack[k:]

    def end_block() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                out.append(Block(text, tree.tag[stack[-1]] if stack else "", stack[-1] if stack else -1, 0, linked))
            pending.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            pending.append(piece)
            if in_link:
                linked += len(piece)

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|<{tag}(?=[\s/>])" if tag in CONTROLS else rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                if end and page[end.start() + 1] == "/":
                    at = end.end()
                elif tag in SWALLOW:
                    at = size
                elif not end:
                    unclosed.add(tag)
        elif tag == "a":
            in_link = not closing and _HREF.search(attrs) is not None
        elif tag == "br":
            pending.append(" ")
        elif tag in BLOCK:
            end_block()
            if closing:
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    open_tag = tree.tag[stack[k]]
                    if open_tag == tag:
                        close(k)
                        in_link = False
                        break
                    if open_tag in SCOPES and tag not in SCOPES:
                        break
            elif tag not in VOID:
                in_link = False
                if stack and tree.tag[stack[-1]] == "p":
                    close(len(stack) - 1)
                for k in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ENDS.get(tag, ())) else ():
                    open_tag = tree.tag[stack[k]]
                    if open_tag in ENDS[tag]:
                        close(k)
                        break
                    if open_tag in ("ul", "ol", "dl", "table"):
                        break
                stack.append(tree.add(tag, attrs, stack[-1] if stack else -1))
                opened[tag] += 1
    end_block()
    own = [0] * len(tree.parent)
    for b in out:
        if b.node >= 0:
            own[b.node] += len(b.text)
    hints = tree.hints(own)
    return [b._replace(hint=hints[b.node]) if b.node >= 0 else b for b in out], tree


#: Weights of the block classifier (log-odds of content).
HINT, LENGTH, SHORT, LINKS, SENTENCE, HEADING, ITEM = 5.0, 0.7, -1.4, -5.0, 0.8, 1.2, -0.4
#: Words from which a block is as long as any.
FULL = 50
#: Smoothness: between neighbours, by their distance in the tree; between one parent's blocks further apart.
NEAR, SIBLING = 2.0, 1.0


def log_odds(b: Block) -> float:
    words = min(b.text.count(" ") + 1, FULL)  # so that no length outweighs what the elements say
    return (
        HINT * b.hint + SHORT + LENGTH * math.log(words) + LINKS * min(b.linked / len(b.text), 1.0)
        + SENTENCE * (b.text[-1] in ".!?…”\"") + HEADING * (b.tag in ("h1", "h2", "h3")) + ITEM * (b.tag == "li")
    )


def smoothness(blocks: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEAR / (1 + tree.distance(blocks[i - 1].node, b.node))))
        parent = tree.parent[b.node] if b.node >= 0 else -1
        j = last.get(parent, i)
        if j < i - 1:
            edges.append((j, i, SIBLING))
        last[parent] = i
    return edges


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut: True on the source side. Terminal capacities are the positive and negative odds.

    Augmenting paths from one node with supply at a time. Nodes that it reaches without meeting any
    demand can never drain, whatever follows, so they are on the source side for good.
    """
    n = len(odds)
    left = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    source = [False] * n
    for s in range(n):
        while left[s] > 1e-12 and not source[s]:
            back, queue, goal = {s: s}, deque([s]), -1
            while queue and goal < 0:
                u = queue.popleft()
                for v, room in near[u].items():
                    if room > 1e-12 and v not in back and not source[v]:
                        back[v] = u
                        if left[v] < -1e-12:
                            goal = v
                            break
                        queue.append(v)
            if goal < 0:
                for v in back:
                    source[v] = True
                break
            flow, v = min(left[s], -left[goal]), goal
            while v != s:
                flow, v = min(flow, near[back[v]][v]), back[v]
            left[s] -= flow
            left[goal] += flow
            v = goal
            while v != s:
                u = back[v]
                near[u][v] -= flow
                near[v][u] += flow
                v = u
    return source


def main_text(page: str | None) -> str:
    """Content blocks joined by line feeds; empty for null, empty or contentless pages."""
    blocks, tree = page_blocks(page) if page else ([], None)
    if not blocks:
        return ""
    keep = min_cut([log_odds(b) for b in blocks], smoothness(blocks, tree))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The input's columns plus _text (which replaces an input column of that name), the main text of each row.

    It is empty for null, empty and contentless pages. Repeated rows each give a row, an empty table stays empty, and
    time and memory are in proportion to a page's length however deep its elements are nested.
    """
    bound_batches(pages.sparkSession)
    whole = pages.select(F.struct("*").alias("row"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], names=["row", "text"])

    found = whole.mapInArrow(run, whole.select("row", F.lit("").alias("text")).schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c != "_text"], F.col("text").alias("_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
