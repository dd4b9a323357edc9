"""HTML extraction: flat text blocks classified by a decision tree.

A page is flattened into text blocks: block-level tags end a block, inline tags don't. Each block has
its number of words, its link density (share of words inside links), both for its neighbours, whether it is a heading, and
hints of its ancestors: a container that is never article text (nav, footer,
aside, form ... or a class or id word such as sidebar, cookie, advert, comments), or one that is
(article, main, or a class or id word such as content, post-body). A decision tree, grown by Gini impurity from the
labelled blocks below, decides for each block. Every labelled page counts twice, with its hints and without any, so words and link
density decide on pages without containers, and inside an article they tell lists of links from text.

Defined results
  null or empty html, no block   empty text, 0 characters
  null page_id or url  carried as they are
  repeated rows, ties  each row by itself
  empty table          empty result
  extra columns        ignored
  very long pages      whole; unclosed tags and comments end with the page
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslab.llm.shared import arrow_stage

# Tags and class words.
BLOCK_TAGS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template svg math iframe object embed applet canvas audio video map textarea select datalist head title".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_ENDING = frozenset("p li td th tr dt dd option".split())
OUTER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
INNER_TAGS = frozenset("article main".split())
OUTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu topmenu breadcrumb breadcrumbs sidebar side rail aside widget"
    " footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register"
    " comment comments reply replies respond disqus discussion share sharing social related recommended recommendations more-links tags pagination pager copyright legal disclaimer form search skip".split()
)
INNER_WORDS = frozenset("article articlebody article-body content entry entry-content post post-body post-content story storytext main main-content body-text text".split())
#: Words that may stand beside an outer word in a class or id: cookie-bar is a notice, share-price is not.
COMPANIONS = frozenset(
    "area bar block body bottom box button buttons col column container content desktop fixed global group head icon icons id inner item items layer left line link links list main mobile"
    " module nav outer overlay page panel primary right row secondary section site slot sticky tabs text thread title tool tools top unit wrap wrapper zone".split()
)
OUTER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outer", "inner", "heading", "seen_inner")

#: The labelled table. Fixed values, made for this module: one page a line, its blocks in order as container, words, share of words
#: in links, and h for headings; blocks in capitals are article text. Containers: n, m (menus, other boilerplate), a (article), d (none).
PAGES = """
n1/1 n1/1 n2/1 n1/1 m6 A9h A60 A45/.1 A3 A80 m9/.2
n1/1 n1/1 n1/1 A7h A30 A12h A55 A1 A24/.5 A40 m12 m2/1
m4h n2/1 n3/1 n1/1 m5 A8h A140 A90/.05 A6/.6 A70 n4/1 n5/1 n4/1 m16
n1/1 n2/1 A5h A16 A14 A18/.2 A2/1 A33 n6/1 n7/1 n5/1 m3h m30 m25 m40
n1/1 n1/1 m20 A10h A2 A4 A3 A5 A2 m8
n3/1 n2/1 n4/1 n3/1 A6h A35 A5/1 A28 A50 a4/1 a5/1 a3/1 a6/1 m14 m2/1 m3/1
n1/1 n1/1 A11h A25 A70 A8 A12 A60 a2/1 a3/.9 a2/1 m10/.1 m5
m12 n1/1 n2/1 n1/1 m7 A60 A45 A30/.3 m11 m18/.6
n2/1 n1/1 m8/.8 m3 A4h A22 A9 A31 A7h A26 A44 m4h m3/1 m5/1 m4/1 m6/.4
n1/1 A3h A120 A2h A95 A2h A150 m6/1
n1/1 n1/1 n1/1 n1/1 m9 m4 A8h A200 m13/.1
m2/1 m2/1 m5h A7h A18/.4 A65/.1 A10 A15 A52 m20/.1 m35 m28
n1/1 n1/1 n1/1 m7 A9h A300 A280 m8/.25
n1/1 n2/1 n1/1 m10 A6h A1 A1 A40 m9
n5/1 n6/1 n4/1 d9 d5/.8 A8h A48 A39 A66/.05 d6 d3/1 d12/.4
d1/1 d2/1 d1/1 d6 A9h A42 A70 A11 A64 d8 d2/1
m6/.1 A12h A26 A8/.2 A9 A30 m9 m12 m30
n1/1 n2/1 n1/1 A60 A45/.1 m8
n2/1 n3/1 A70 A33 A3/1 A48 m4/1
n1/1 n1/1 n4/1 A90 A42 A57 n2/1 n1/1
A7h A90 A60 A75
A50
A2h A3
"""


def labelled(pages: str = PAGES) -> list[tuple]:
    """The features of each block, then 1 for article text; each page with its hints and without."""
    out = []
    for line in pages.split("\n"):
        blocks = [re.fullmatch(r"([a-zA-Z])([0-9]+)(?:/([0-9.]+))?(h?)", x).groups() for x in line.split()]
        for hints in (True, False):
            made = [Block("", int(w), float(x or 0), int(hints and c in "nm"), int(hints and c in "aA"), int(bool(h))) for c, w, x, h in blocks]
            out += [(*x, int(c == "A")) for x, (c, *_) in zip(features(made), blocks, strict=True)]
    return out


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: int = 0

    def decide(self, x: tuple) -> int:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.limit else node.high
        return node.label


def grow(rows: list[tuple], depth: int = 8, least: int = 1) -> Node:
    """A binary tree: at each node the cut that lowers the Gini impurity most (ties: first feature, lowest limit)."""
    ones = sum(r[-1] for r in rows)
    leaf = Node(label=int(2 * ones >= len(rows)))
    if ones in (0, len(rows)) or depth == 0:
        return leaf
    gini = lambda k, n: 2 * k * (n - k) / n  # noqa: E731  weighted by size
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            low = [r for r in rows if r[f] <= (a + b) / 2]
            if min(len(low), len(rows) - len(low)) < least:
                continue
            k = sum(r[-1] for r in low)
            cost = gini(k, len(low)) + gini(ones - k, len(rows) - len(low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, (a + b) / 2)
    if best is None or best[0] >= gini(ones, len(rows)) - 1e-12:
        return leaf
    _, f, limit = best
    return Node(f, limit, grow([r for r in rows if r[f] <= limit], depth - 1, least), grow([r for r in rows if r[f] > limit], depth - 1, least))


@cache
def tree() -> Node:
    return grow(labelled(), least=4)


@dataclass
class Block:
    text: str
    words: int
    links: float
    outer: int
    inner: int
    heading: int


def _kind(tag: str, attributes: str, inside: bool) -> tuple[int, int, bool]:
    """(outer, inner, hidden) by a tag and its attributes. A header within an article may hold its heading, so
    header counts as boilerplate outside of one only."""
    outer = tag in OUTER_TAGS or (tag == "header" and not inside)
    inner, hidden = tag in INNER_TAGS, tag in HIDDEN_TAGS
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                for token in value.split():
                    if token in INNER_WORDS and tag not in ("body", "html"):
                        inner = True
                    elif tag not in ("body", "html", "article", "main"):
                        parts = {x for x in re.split(r"[-_0-9]+", token) if x}
                        if token in OUTER_WORDS or (parts & OUTER_WORDS and parts <= OUTER_WORDS | COMPANIONS):
                            outer = True
            elif name == "role":
                outer, inner = outer or value in OUTER_ROLES, inner or value in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = hidden or tag not in ("body", "html")
    return int(outer), int(inner and not outer), hidden


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    # open elements: (tag, outer, inner, hidden) with what they inherit
    stack: list[tuple[str, int, int, bool]] = []
    opened: dict[str, int] = {}  # how many of each tag are on the stack, so that none is looked for in vain
    state, anchors, heading, at, size = (0, 0, False), 0, 0, 0, len(page)
    state_now = state

    def close(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                n = text.count(" ") + 1
                inked = len(html.unescape("".join(linked)).split())
                out.append(Block(text, n, min(1.0, inked / n), state_now[0], state_now[1], heading))
            parts, linked = [], []

    while at < size:
        m = TOKEN.search(page, at)
        upto = m.start() if m else size
        if upto > at and not state[2]:
            if not parts:
                state_now = state
            parts.append(page[at:upto])
            if anchors:
                linked.append(page[at:upto] + " ")
        if not m:
            break
        at = m.end()
        if m[2] is None:  # comment, declaration
            if m[0].startswith("<![CDATA[") and not state[2]:
                parts.append(html.escape(m[0][9:-3]))
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
            flush()
        if closing:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag[0] == "h" and tag[1:].isdigit():
                heading = 0
            if opened.get(tag):
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            state = stack[-1][1:] if stack else (0, 0, False)
            if tag in BLOCK_TAGS and tag not in ("br", "hr"):
                anchors = 0  # an unclosed link ends with its block
            continue
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if tag == "a":
            anchors += 1
        if tag[0] == "h" and tag[1:].isdigit():
            heading = 1
        if tag in RAW_TAGS:  # what is inside is no markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in SELF_ENDING and opened.get(tag):  # it ends an open one of its kind, if no other block stands between
            k = len(stack) - 1
            while stack[k][0] != tag and (stack[k][0] in SELF_ENDING or stack[k][0] not in BLOCK_TAGS):
                k -= 1
            if stack[k][0] == tag:
                close(k)
            state = stack[-1][1:] if stack else (0, 0, False)
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS or "class" in m[3] or "id" in m[3]:
            o, i, h = _kind(tag, m[3], bool(state[1]))
            if tag in HIDDEN_TAGS or tag in BLOCK_TAGS or o or h:
                # boilerplate inside an article ends its being article text
                outer = 1 if o or (state[0] and not (i and tag in INNER_TAGS)) else 0
                state = (outer, 0 if outer else int(i or state[1]), state[2] or h)
                stack.append((tag, *state))
                opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def features(found: list[Block]) -> Iterator[tuple]:
    seen = int(any(b.inner for b in found))
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        yield (b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0, b.outer, b.inner, b.heading, seen)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    decide = tree().decide
    return " ".join(b.text for b, x in zip(found, features(found), strict=True) if decide(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_stage(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
