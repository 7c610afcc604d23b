"""Main text of HTML pages: flat text blocks, described by their own and their neighbours' word counts and link
densities and by where they stand, classified by a decision tree that is grown from a small labelled table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dossierlake.llm import words as W

# Elements whose content is never text of the page.
_DROPPED = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|audio|video|map"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_DROPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-z!?/][^>]*(?:>|\Z)", re.I | re.S)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements whose end can be left out: a new one of the same group ends the one before.
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_OUTSIDE = frozenset("head title nav footer aside form button menu dialog label legend fieldset".split())
_INSIDE = frozenset("article main".split())
# Words in class, id and role values.
_OUTSIDE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promoted promotion cookie cookies
consent gdpr notice notices alert alerts popup modal overlay sidebar side rail nav navbar navigation menu menus breadcrumb breadcrumbs footer foot
masthead topbar toolbar comment comments commentlist disqus reply replies respond reactions discussion share sharing social follow related recommended recommendations
newsletter subscribe subscription signup login search pagination pager widget widgets copyright legal disclaimer skip hidden contentinfo complementary""".split())
_INSIDE_WORDS = frozenset("article main content post entry story body text maincontent articlebody postcontent entrycontent articlecontent".split())
# Every attribute with its value, so that names within names or values are not taken for attributes.
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
# What a class or id says about the state or subject of an element, not about its place.
_STATE = re.compile(r"(?:^|--|__)(?:has|have|with|without|no|not|overflow|category|tag|format)(?:[-_]|(?=[A-Z])).*$|^.*[-_](?:open|opened|closed|enabled|disabled)$")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    outside: int
    inside: bool
    heading: bool


def _place(name: str, rest: str) -> tuple[int, bool]:
    """Whether an element stands outside the main text, 2 by its name, role or being hidden and 1 by a class or id word, or inside."""
    outside, inside = 2 * (name in _OUTSIDE), name in _INSIDE
    if rest and "=" in rest or "hidden" in rest:
        for attribute, value in _ATTRIBUTE.findall(rest):
            attribute, value = attribute.lower(), value.strip("\"'")
            if attribute in ("class", "id", "role"):
                parts = {p.lower() for token in value.split() for p in _PARTS.findall(_STATE.sub("", token))}
                if name not in ("html", "body") and parts & _OUTSIDE_WORDS:
                    outside = max(outside, 2 if attribute == "role" else 1)
                inside |= bool(parts & _INSIDE_WORDS)
            elif attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true":
                outside = 2
            elif attribute == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                outside = 2
    return outside, inside and not outside


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Block-level tags end a block, inline tags do not; open elements are kept on a
    stack, an end tag closes everything up to its start tag and is ignored if there is none."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []
    pieces: list[tuple[str, bool]] = []
    links = 0

    def close_block() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = len("".join(p for p, in_link in pieces if in_link).split())
                outside, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                heading = any(name in _HEADINGS for name, _, _ in stack[-3:])
                out.append(Block(text, len(text.split()), linked, outside, inside, heading))
            pieces.clear()

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            pieces.append((entities.unescape(page[at: m.start()]), links > 0))
        at = m.end()
        if m["cdata"] is not None:
            pieces.append((m["cdata"], links > 0))
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "a":
            links = 0 if m["close"] else 1
        # Inline elements with a place of their own, like a span of an advert, are blocks too.
        if name in _INLINE and not (not m["close"] and name != "a" and _place(name, m["rest"])[0]) and not any(n == name for n, _, _ in stack[-1:]):
            continue
        if name == "br":
            pieces.append((" ", links > 0))
            continue
        close_block()
        if name in _VOID:
            continue
        if m["close"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
            links = 0
        else:
            if stack and stack[-1][0] in _IMPLIED.get(name, ()):
                stack.pop()
            if name == "body":
                stack.clear()
            if not m["rest"].rstrip().endswith("/"):
                outside, inside = _place(name, m["rest"])
                above = stack[-1] if stack else ("", 0, False)
                if name == "header" and not above[2]:
                    outside = 2
                # A first article under a class or id word, like a sidebar around the page, is judged by its words and links.
                if name in _INSIDE and above[1] == 1 and not any(n in _INSIDE for n, _, _ in stack):
                    above, inside = (name, 0, False), False
                stack.append((name, max(above[1], outside), (above[2] or inside) and not outside))
    if at < len(page):
        pieces.append((entities.unescape(page[at:]), links > 0))
    close_block()
    return out


# Labelled blocks. Columns: stands outside (1 by a class or id word only, 2 by more), stands inside, is a heading, words, link density in percent, words and link
# density of the block before and of the block after (0 and 0 at the ends), and whether it belongs to the main text.
LABELLED = """
0 1 1 8 0 0 0 60 0 1
0 1 1 11 0 9 0 45 0 1
0 1 1 5 0 6 100 5 0 1
0 1 1 10 0 10 0 2 0 1
0 1 0 2 0 60 0 40 0 1
0 1 0 1 0 0 0 0 0 1
0 1 0 3 0 10 0 12 0 1
0 1 0 4 0 30 0 14 0 1
0 1 0 7 0 3 0 9 0 1
0 1 0 12 0 11 0 8 0 1
0 1 0 12 30 50 0 40 0 1
0 1 0 25 10 12 0 90 0 1
0 1 0 45 5 10 0 60 0 1
0 1 0 80 0 7 0 120 0 1
0 1 0 150 20 90 0 20 0 1
0 1 0 220 0 11 0 14 0 1
0 1 0 600 1 80 0 10 0 1
0 1 0 35 50 80 0 50 0 1
0 1 0 1 100 40 0 55 0 1
0 1 0 3 100 1 100 1 100 1
1 0 0 1 100 0 0 1 100 0
1 0 0 1 100 1 100 1 100 0
1 0 0 2 100 1 100 8 0 0
1 0 0 8 0 1 100 10 0 0
1 0 0 15 0 2 100 60 0 0
1 0 0 40 0 5 0 80 0 0
1 0 0 120 0 60 0 70 0 0
1 0 0 300 5 9 0 45 0 0
1 0 1 3 0 40 0 6 0 0
1 0 1 9 0 0 0 70 0 0
1 0 0 14 0 200 0 0 0 0
1 0 0 6 50 35 0 0 0 0
1 0 0 5 0 60 0 55 0 0
1 0 0 9 20 45 0 80 0 0
1 0 0 16 0 50 0 50 0 0
1 0 0 22 0 40 0 0 0 0
1 0 0 30 0 8 0 45 0 0
1 0 0 48 10 5 100 60 0 0
1 0 0 70 0 60 0 4 0 0
1 0 0 110 25 0 0 0 0 0
1 0 0 250 5 9 0 9 0 0
1 0 1 5 0 70 0 45 0 0
1 0 1 7 0 1 100 4 90 0
1 0 0 500 2 60 0 120 0 1
1 0 0 600 0 80 0 90 0 1
1 0 0 900 0 0 0 0 0 1
1 0 0 450 5 300 0 200 0 1
1 0 0 500 60 60 0 120 0 0
1 0 0 700 90 0 0 0 0 0
2 0 0 500 2 60 0 120 0 0
2 0 0 600 0 80 0 90 0 0
2 0 0 900 0 0 0 0 0 0
2 0 0 450 5 300 0 200 0 0
2 0 0 60 0 0 0 0 0 0
2 0 0 2 100 1 100 2 100 0
0 0 0 1 100 0 0 1 100 0
0 0 0 2 100 2 100 2 100 0
0 0 0 3 90 1 100 50 0 0
0 0 0 8 80 3 100 5 90 0
0 0 0 20 75 6 100 6 100 0
0 0 0 40 60 8 90 5 100 0
0 0 0 4 0 2 100 2 100 0
0 0 0 6 0 0 0 3 100 0
0 0 0 9 0 3 90 0 0 0
0 0 0 5 0 4 0 0 0 0
0 0 0 11 0 5 20 0 0 0
0 0 0 7 0 4 0 5 0 0
0 0 1 4 0 2 100 3 100 0
0 0 1 7 0 1 100 4 90 0
0 0 1 8 0 3 100 60 0 1
0 0 1 5 0 70 0 45 0 1
0 0 1 9 0 6 0 80 0 1
0 0 1 6 10 40 0 35 0 1
0 0 0 30 0 8 0 45 0 1
0 0 0 22 0 40 0 0 0 1
0 0 0 45 10 5 100 60 0 1
0 0 0 70 0 60 0 4 0 1
0 0 0 110 25 0 0 0 0 1
0 0 0 250 5 9 0 9 0 1
0 0 0 16 0 50 0 50 0 1
0 0 0 6 0 60 0 55 0 1
0 0 0 4 0 35 0 40 0 1
0 0 0 9 20 45 0 80 0 1
0 0 0 12 0 90 0 30 0 1
"""


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 in leaves), threshold, the nodes for values up to and over it, and the class of a leaf."""

    feature: list[int]
    threshold: list[float]
    low: list[int]
    high: list[int]
    keep: list[bool]


def grow(table: str = LABELLED, depth: int = 6) -> Tree:
    """A classification tree: splits that lower the Gini impurity most, until leaves are pure."""
    rows = np.array([line.split() for line in table.strip().split("\n")], float)
    tree = Tree([], [], [], [], [])

    def node(x: np.ndarray, y: np.ndarray, left: int) -> int:
        me = len(tree.feature)
        for column, value in zip((tree.feature, tree.threshold, tree.low, tree.high, tree.keep), (-1, 0.0, -1, -1, bool(y.mean() >= 0.5))):
            column.append(value)
        best = (1e-9, -1, 0.0)
        impurity = len(y) * y.mean() * (1 - y.mean())
        for f in range(x.shape[1]) if left and impurity else ():
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                under = x[:, f] <= cut
                gain = impurity - sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[under], y[~under]))
                if gain > best[0]:
                    best = (gain, f, cut)
        if best[1] >= 0:
            under = x[:, best[1]] <= best[2]
            tree.feature[me], tree.threshold[me] = best[1], best[2]
            tree.low[me] = node(x[under], y[under], left - 1)
            tree.high[me] = node(x[~under], y[~under], left - 1)
        return me

    node(rows[:, :-1], rows[:, -1], depth)
    return tree


def features(found: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in found], float)
    density = 100 * np.array([b.linked for b in found], float) / np.maximum(words, 1)
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    own = np.array([(b.outside, b.inside, b.heading) for b in found], float)
    return np.column_stack([own, words, density, before(words), before(density), after(words), after(density)])


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    x = features(found)
    at = np.zeros(len(x), int)
    feature, threshold, low, high, keep = map(np.array, (tree.feature, tree.threshold, tree.low, tree.high, tree.keep))
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        f = at[inner]
        at[inner] = np.where(x[inner, feature[f]] <= threshold[f], low[f], high[f])
    return " ".join(b.text for b, kept in zip(found, keep[at]) if kept)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(row, text) for every row of pages(html, ...): `row` is the row as a struct, text its main text.

    Null, empty and textless pages have an empty text. Broken markup is read as far as it goes: an unclosed comment or
    script ends with the page, unclosed elements end with what contains them.
    """
    tree = tree or grow()
    packed = pages.select(F.struct("*").alias("row"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "html"):
            texts = pa.array([main_text(page, tree) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("row"), texts], ["row", "text"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string")
