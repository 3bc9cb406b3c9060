"""The main body of web pages: flat text blocks, classified by decision trees.

Every line of a page with visible text is a block; a line that holds several block elements is cut at their tags and is as
many blocks. A block is described by its own shallow features (words, links, digits, kind of element, how its words are
used in a small labelled table), by those of its neighbours, and by its place: before or after what looks like the page's
title, in the title's element or outside, or on a page without any title. Trees decide for every block of every page; no rule
drops any before them. They are trained when a query starts, on the two labelled tables beside this module; no document of the input
is ever used for training.
"""

from __future__ import annotations

import html
import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.media import charset_of
from plumbline.llm.garbled import restore
from plumbline.llm.looks import canonical_text

_HERE = os.path.dirname(os.path.abspath(__file__))
#: The labelled pages: a line ``# page``, then one line for each line of the page: 1 or 0 (main body or not), tab, line. The second
#: table has pages of other layouts (no title, ``h2``, ``h3``, a logo as ``h1``, plain text), with the layout's name after ``# page``.
TABLES = (os.path.join(_HERE, "labelled_blocks.tsv"), os.path.join(_HERE, "labelled_layouts.tsv"))
#: At most so many labelled lines of a table are trained on.
TABLE_LINES = 5000
#: Blocks whose own features a worker remembers; beyond it the memory is emptied between groups of pages, results stay the same.
REMEMBERED = 60_000
DEPTH, LEAF = 12, 3

_UNSEEN = re.compile(r"<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*>")
_CODE = re.compile(r"\b(?=[A-Za-z0-9-]*[A-Z])(?=[A-Za-z0-9-]*\d\d)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\b")
_MONEY = re.compile(r"[$€£¥₩]|\d\s?[円원]|\b(?:USD|EUR|KRW|GBP|JPY)\b(?!-)")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?。！？]\s*$")
#: A line that ends in a lost character, and not with a figure before it: its full stop may be what was lost.
_LOST = re.compile(r"\D{5}\ufffd$")
#: Elements that hold others; a line that only opens or closes them is no block.
#: A line that holds several blocks is cut behind the closing tags of these, and around what opens a holder.
_BLOCK = re.compile(r"</(?:p|li|div|nav|h[1-6]|main|aside|footer|header|small|button|article|section|ul|ol|table)>", re.IGNORECASE)
_OPEN = re.compile(r"<(?:div|section|article|main|nav|aside|header|footer|form|table|tbody|body|html)\b[^>]*>", re.IGNORECASE)
_HOLDERS = {"div", "section", "article", "main", "nav", "aside", "header", "footer", "form", "table", "tbody", "body", "html"}
# Kinds of elements a block may be, in the order of the feature "kind".
KINDS = ("text", "p", "li", "td", "a", "button", "h1", "h2", "small", "span", "div", "h3")
_KIND_OF = {"p": 1, "li": 2, "td": 3, "th": 3, "tr": 3, "a": 4, "button": 5, "h1": 6, "h2": 7, "h3": 11, "h4": 11, "h5": 11, "h6": 11, "small": 8, "span": 9, "div": 10}


class Line(NamedTuple):
    """What one line shows by itself. ``words`` is 0 for a line without visible text, ``mark`` a number for its first code;
    ``opens`` and ``closes`` count the holders left open or closed by it."""

    words: int
    chars: int
    kind: int
    link: float
    code: int
    money: int
    digits: float
    sentence: int
    colon: int
    signs: int
    named: int
    heard: int
    use: float
    mark: int
    opens: int
    closes: int


_EMPTY = (0, 0, 0, 0.0, 0, 0, 0.0, 0, 0, 0, 0, 0, 0.0, 0)


def tokens(text: str) -> list[tuple[str, list[str]]]:
    """Words for the table of uses, letters only and in lower case, without codes, each with its pairs of letters if it is a long word of
    a script that joins words or endings."""
    return [
        (w, [f"~{w[i : i + 2]}" for i in range(len(w) - 1)] if len(w) > 2 and not w.isascii() else [])
        for w in _WORD.findall(_CODE.sub(" ", text).lower())
    ]


@dataclass
class Uses:
    """How words are used: log odds of the main body, from counts of labelled lines that hold them."""

    odds: dict[str, float]

    @classmethod
    def learn(cls, pages: list[list[tuple[str, int]]]) -> Uses:
        body, rest, n = Counter(), Counter(), [0, 0]
        for page in pages:
            for text, label in dict.fromkeys(page):
                if is_name(text):
                    continue
                n[label] += 1
                (body if label else rest).update({t for w, pairs in tokens(text) for t in (w, *pairs)})
        return cls(
            {
                w: math.log((body[w] + 0.5) / (n[1] + 1)) - math.log((rest[w] + 0.5) / (n[0] + 1))
                for w in body.keys() | rest.keys()
                if body[w] + rest[w] > 1
            }
        )

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, float]] = {}

    def _word(self, word: str) -> tuple[int, float]:
        """How many odds a word has, of its own or of its pairs, and their sum."""
        odds = self.odds
        if word in odds:
            return 1, odds[word]
        found = [odds[p] for i in range(len(word) - 1) if (p := f"~{word[i : i + 2]}") in odds] if len(word) > 2 and not word.isascii() else []
        return len(found), sum(found)

    def of(self, text: str, coded: bool = True) -> tuple[int, float]:
        """Number of known words, up to 9, and the sum of their odds, of unknown words by their pairs, for the number of
        both. Without ``coded`` the text holds no code. Words are remembered, up to a number."""
        known, heard, total = self.known, 0, 0.0
        for word in _WORD.findall((_CODE.sub(" ", text) if coded else text).lower()):
            got = known.get(word)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[word] = self._word(word)
            heard += got[0]
            total += got[1]
        return min(9, heard), max(-6.0, min(6.0, total / math.sqrt(heard))) if heard else 0.0


def is_name(shown: str, coded: re.Match[str] | None = None) -> bool:
    """Whether a line is a name with a code, not a sentence or a stated property. Its words say nothing about its use."""
    coded = coded or _CODE.search(shown)
    return bool(coded) and not _BREAK.search(shown) and not _LOST.search(shown) and len(shown) < 90 and shown.find(": ", 0, coded.start()) < 0


def read_line(raw: str, uses: Uses) -> Line:
    """The features of one line by itself. Garbled and look-alike characters are read as what they stand for."""
    line = raw.strip()
    if not line:
        return Line(*_EMPTY, 0, 0)
    if not line.isascii():
        line = canonical_text(restore(line, by_word=True))
    if "<" not in line and "&" not in line:
        shown, kind, link, opens, closes = line, 0, 0.0, 0, 0
    else:
        line = _UNSEEN.sub("", line)
        opens = closes = 0
        kind, depth, linked, shown_parts, at = 0, [], 0, [], 0
        for tag in _TAG.finditer(line):
            piece = line[at : tag.start()]
            if piece.strip():
                shown_parts.append(piece)
                linked += len(piece.strip()) if "a" in depth or "button" in depth else 0
            at = tag.end()
            name = tag.group(2).lower()
            if tag.group(1):
                if name in depth:
                    while depth and depth.pop() != name:
                        pass
                elif name in _HOLDERS:
                    closes += 1
            else:
                kind = kind or _KIND_OF.get(name, 0)
                if name == "button" or name == "h1":
                    kind = _KIND_OF[name]
                if name not in ("br", "img", "hr", "input", "meta", "link"):
                    depth.append(name)
        piece = line[at:]
        if piece.strip():
            shown_parts.append(piece)
        opens = sum(name in _HOLDERS for name in depth)
        shown = html.unescape(" ".join(shown_parts)).strip()
        link = linked / max(1, sum(len(p.strip()) for p in shown_parts))
        if "&" in line and not shown.isascii():
            shown = canonical_text(restore(shown, by_word=True))
    shown = " ".join(shown.split())
    if not shown:
        return Line(*_EMPTY, opens, closes)
    digits = sum(map(str.isdigit, shown))
    coded, sentence, colon = _CODE.search(shown), bool(_BREAK.search(shown)), ": " in shown or "：" in shown
    named = coded is not None and is_name(shown, coded)
    heard, use = (1, 0.0) if named else uses.of(shown, coded is not None)
    return Line(
        words=len(shown.split(" ")), chars=len(shown), kind=kind, link=round(link, 3),
        code=int(bool(coded)), money=int(bool(_MONEY.search(shown))), digits=round(digits / len(shown), 3),
        sentence=int(sentence), colon=int(colon),
        signs=int("©" in shown) + 2 * int(" · " in shown or " | " in shown or " > " in shown or " / " in shown),
        named=int(named), heard=heard, use=round(use, 3),
        mark=1 + zlib.crc32(coded.group().encode()) % 1_000_000 if coded else 0, opens=opens, closes=closes,
    )


def blocks(line: str) -> list[str]:
    """A line, or if it holds several block elements with text (a page without line breaks, say) the blocks it is made of."""
    if line.count("</") < 2 or len(_BLOCK.findall(line)) < 2:
        return [line]
    at = {m.end() for m in _BLOCK.finditer(line)} | {x for m in _OPEN.finditer(line) for x in m.span()}
    cuts = sorted(at | {0, len(line)})
    out = [line[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
    return out if sum(bool(_TAG.sub("", _UNSEEN.sub("", x)).strip()) for x in out) > 1 else [line]


FEATURES = (
    "words chars kind link code money digits sentence colon signs named heard use p_named n_named "
    "p_words p_kind p_link p_code p_money p_digits p_sentence p_use n_words n_kind n_link n_code n_money n_digits n_sentence n_use "
    "pp_use nn_use pp_code nn_code pp_words nn_words pp_link nn_link titled since items listed n_listed holder ending other same strange"
).split()
HEARD, HOLDER = FEATURES.index("heard"), FEATURES.index("holder")
# Places of a block, each with its own trees.
NONE, BEFORE, INSIDE, OUTSIDE = "no title", "before", "inside", "outside"
PLACES = (NONE, BEFORE, INSIDE, OUTSIDE)
#: Kinds of titles: none, a heading of the first level, a name with a code, another heading.
UNTITLED, FIRST, NAMED, HEADED = range(4)
_OF = {name: k for k, name in enumerate(Line._fields)}


class Blocks(NamedTuple):
    """The blocks of several pages: the page and the line of each, its features, whether its page is marked up, the kind of the
    page's title and the block's place."""

    page: np.ndarray
    line: np.ndarray
    x: np.ndarray
    marked: np.ndarray
    title: np.ndarray
    place: np.ndarray


def _first_of(mask: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """Index of the first row of each page where ``mask`` holds; -1 without one."""
    out = np.full(pages, -1, np.int64)
    at = np.flatnonzero(mask)[::-1]
    out[page[at]] = at
    return out


def page_blocks(lines: np.ndarray, page: np.ndarray, pages: int) -> Blocks:
    """The blocks of ``pages`` pages and their features. ``lines`` has a row for each line (the fields of :class:`Line`), ``page`` the
    number of its page, ascending.

    The title is the first ``h1`` in whose element two other blocks stand; else the first name with a code, outside
    links, that a short line with digits but no code follows; else the first ``h2``; else the first ``h1`` or heading of
    another level. A page may have none. ``titled`` says whether a block is before, at or after it (-1: no title), ``since`` how many
    blocks after; ``listed`` is a name with another code than the title's after it (what sidebars list), ``items`` counts those before the block,
    ``holder`` how deep the block lies in or outside of the title's element (in a plain page: 1 from the title to the first
    listed name), ``ending`` how many blocks without any digit or code came last, ``other`` that in a plain page a first listed name
    has come behind a block whose words are used outside of main bodies ("Recently viewed"), or are not known and without any digit,
    ``same`` and ``strange`` whether its first code is the title's or another one.
    """
    opens, closes = lines[:, _OF["opens"]].astype(np.int64), lines[:, _OF["closes"]].astype(np.int64)
    level = np.cumsum(opens) - opens - np.cumsum(closes)
    start = np.searchsorted(page, np.arange(pages))
    some = start < len(page)
    base = np.zeros(pages, np.int64)
    base[some] = level[start[some]] + closes[start[some]]
    level -= base[page]
    markup = (lines[:, _OF["kind"]] > 0) | (opens > 0) | (closes > 0)
    marked_page = np.zeros(pages, bool)
    marked_page[page[markup]] = True

    at = np.flatnonzero(lines[:, _OF["words"]] > 0)
    n = len(at)
    if not n:
        none = np.empty(0, np.int64)
        return Blocks(none, none, np.empty((0, len(FEATURES))), none > 0, none, none)
    own, of, deep = lines[at], page[at], level[at]
    col = lambda name: own[:, _OF[name]]

    def beside(step: int) -> np.ndarray:
        """The rows ``step`` blocks on, zeros where the page has none."""
        out = np.zeros_like(own)
        if step > 0 and n > step:
            same = of[step:] == of[:-step]
            out[:-step][same] = own[step:][same]
        elif step < 0 and n > -step:
            same = of[:step] == of[-step:]
            out[-step:][same] = own[:step][same]
        return out

    p, q, pp, qq = beside(-1), beside(1), beside(-2), beside(2)
    get = lambda rows, name: rows[:, _OF[name]]
    index = np.arange(n)

    def within(title: np.ndarray) -> np.ndarray:
        """Whether blocks lie in the element of their page's title, from the title on."""
        mine = title[of]
        known = mine >= 0
        home = np.where(known, deep[np.maximum(mine, 0)], 0)
        # The first line after the title that is less deep ends the element, for blocks at or behind it.
        home_of, line_of = np.zeros(pages, np.int64), np.full(pages, len(page), np.int64)
        has = title >= 0
        home_of[has], line_of[has] = deep[title[has]], at[title[has]]
        left = (level < home_of[page]) & (np.arange(len(page)) > line_of[page])
        end = _first_of(left, page, pages)
        end = np.where(end < 0, len(page), end)
        return known & (index >= mine) & (at < end[of]) & (deep >= home)

    few = (get(q, "words") > 0) & (get(q, "words") <= 9) & (get(q, "sentence") == 0) & (get(q, "link") == 0) & (get(q, "code") == 0)
    few &= (get(q, "money") > 0) | (get(q, "digits") * get(q, "chars") > 2.5)
    name = few & (col("named") > 0) & (col("link") == 0) & (col("money") == 0) & (col("words") <= 14)
    h1 = _first_of(col("kind") == 6, of, pages)
    held = np.bincount(of[within(h1) & (col("link") < 1)], minlength=pages)
    ways = (
        (np.where(held > 2, h1, -1), FIRST), (np.where(marked_page & (h1 < 0) | ~marked_page, _first_of(name, of, pages), -1), NAMED),
        (_first_of((col("kind") == 7) & (col("link") == 0), of, pages), HEADED), (h1, FIRST), (_first_of((col("kind") == 11) & (col("link") == 0), of, pages), HEADED),
    )
    title, kind = np.full(pages, -1, np.int64), np.zeros(pages, np.int64)
    for found, what in ways:
        new = (title < 0) & (found >= 0)
        title[new], kind[new] = found[new], what
    mine = title[of]
    has = mine >= 0
    titled = np.where(has, (index > mine).astype(np.int64) + (index >= mine), -1)
    inside_element = within(title)
    marked = marked_page[of]

    first = np.searchsorted(of, np.arange(pages))[of]
    coded, marks = col("mark") > 0, np.where(has, own[np.maximum(mine, 0), _OF["mark"]], 0)
    loose = (col("link") > 0) | ~np.isin(col("kind"), (1, 2, 3))
    listed = (titled == 2) & (col("named") > 0) & loose & (col("mark") != marks)
    n_listed = (titled >= 1) & (get(q, "named") > 0) & (get(q, "mark") != marks) & ((get(q, "link") > 0) | ~np.isin(get(q, "kind"), (1, 2, 3)))
    counted = np.cumsum(listed)
    items = counted - listed - (counted[first] - listed[first])
    holder = np.where(marked, np.where(titled <= 0, 0, np.where(inside_element, deep - deep[np.maximum(mine, 0)] + 1, -1)), (titled >= 1) & (items == 0) & ~listed)
    told = (col("digits") > 0) | (col("code") > 0)
    last = np.maximum.accumulate(np.where(told, index, -1))
    last = np.concatenate(([-1], last[:-1]))
    ending = index - 1 - np.maximum(last, first - 1)
    opener = listed & (items == 0) & ~marked & ((get(p, "use") < 0) | ((get(p, "use") == 0) & (get(p, "digits") == 0)))
    opened = _first_of(opener, of, pages)[of]
    other = (opened >= 0) & (index >= opened)

    x = np.column_stack([
        *[col(f) for f in "words chars kind link code money digits sentence colon signs named heard use".split()], get(p, "named"), get(q, "named"),
        *[get(p, f) for f in "words kind link code money digits sentence use".split()], *[get(q, f) for f in "words kind link code money digits sentence use".split()],
        get(pp, "use"), get(qq, "use"), get(pp, "code"), get(qq, "code"), get(pp, "words"), get(qq, "words"), get(pp, "link"), get(qq, "link"),
        titled, np.where(titled > 0, np.minimum(40, index - mine), -1), items, listed, n_listed, holder, ending, other,
        coded & (col("mark") == marks), coded & (marks > 0) & (col("mark") != marks),
    ]).astype(np.float64)
    place = np.select([~has, titled == 0, holder > 0], [0, 1, 2], 3)
    return Blocks(of, at, x, marked, kind[of], place)


class Tree:
    """A binary decision tree by Gini impurity, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> None:
        self.feature: list[int] = []
        self.border: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self._grow(x, y.astype(np.float64), depth, leaf)
        self.arrays = tuple(np.array(a) for a in (self.feature, self.border, self.left, self.right, self.value))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        node = len(self.feature)
        for a, v in ((self.feature, -1), (self.border, 0.0), (self.left, node), (self.right, node), (self.value, float(y.mean()))):
            a.append(v)
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return node
        best, n, total = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0), len(y), y.sum()
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= leaf) & (cut <= n - leaf)]
            if not len(cut):
                continue
            a, b = ones[cut - 1], total - ones[cut - 1]
            impurity = a - a * a / cut + b - b * b / (n - cut)
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (float(impurity[i]), f, float((v[cut[i]] + v[cut[i] - 1]) / 2))
        if best[1] < 0:
            return node
        low = x[:, best[1]] < best[2]
        self.feature[node], self.border[node] = best[1], best[2]
        self.left[node] = self._grow(x[low], y[low], depth - 1, leaf)
        self.right[node] = self._grow(x[~low], y[~low], depth - 1, leaf)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of main body among the training rows of each row's leaf."""
        feature, border, left, right, value = self.arrays
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return value[node]
            low = x[rows, np.maximum(f, 0)] < border[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)


@dataclass
class Model:
    """The word uses and the trees: for pages with elements or plain, for blocks with known words or without, by the kind of the
    page's title and the block's place. Small: some thousand words and some hundred nodes, whatever the input."""

    uses: Uses
    trees: dict[tuple[bool, bool, int, int], Tree]

    def main(self, found: Blocks) -> np.ndarray:
        """Whether blocks are main body. Blocks of a kind that no labelled page has are judged by the nearest kind's tree."""
        out = np.zeros(len(found.x), bool)
        if not len(out):
            return out
        key = ((found.marked * 2 + (found.x[:, HEARD] > 0)) * 4 + found.title) * 4 + found.place
        for k in np.unique(key).tolist():
            of = key == k
            out[of] = self._tree(k // 32 > 0, k // 16 % 2 > 0, k // 4 % 4, k % 4).predict(found.x[of]) > 0.5
        return out

    def _tree(self, marked: bool, heard: bool, title: int, place: int) -> Tree:
        wanted = (marked, heard, title, place)
        return self.trees[min(self.trees, key=lambda t: (t[0] != wanted[0], t[3] != wanted[3], t[2] != wanted[2], t[1] != wanted[1]))]


def labelled_pages(path: str = TABLES[0], limit: int = TABLE_LINES) -> list[list[tuple[str, int]]]:
    """Pages of (line, label) of a labelled table, up to ``limit`` lines."""
    return [rows for _, rows in labelled_layouts(path, limit)]


def labelled_layouts(path: str = TABLES[1], limit: int = TABLE_LINES) -> list[tuple[str, list[tuple[str, int]]]]:
    """The layout and the (line, label) rows of each page of a labelled table, up to ``limit`` lines."""
    pages: list[tuple[str, list[tuple[str, int]]]] = []
    with open(path, encoding="utf-8") as rows:
        for k, row in enumerate(rows):
            if k >= limit:
                break
            row = row.rstrip("\n")
            if row.startswith("# page"):
                pages.append((row[7:], []))
            elif row:
                label, _, line = row.partition("\t")
                pages[-1][1].append((line, int(label)))
    return pages


def without_tags(page: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The page as a plain-text capture shows it."""
    out = []
    for line, label in page:
        shown = html.unescape(_TAG.sub("", _UNSEEN.sub("", line))).strip()
        if shown:
            out.append((shown, label))
    return out


_HEADING = re.compile(r"<h[1-6]\b", re.IGNORECASE)


def with_untitled(pages: list[list[tuple[str, int]]]) -> list[list[tuple[str, int]]]:
    """The pages, and those with a heading once more without it."""
    bare = [[row for row in page if not _HEADING.match(row[0])] for page in pages]
    return [*pages, *(b for b, page in zip(bare, pages, strict=True) if len(b) < len(page))]


def train(pages: list[list[tuple[str, int]]], others: list[list[tuple[str, int]]] = [], folds: int = 20, words: bool = True) -> Model:  # noqa: B006
    """A model from labelled pages, each also in its plain form; without ``words`` one that knows no word. ``others`` are pages of which
    only the layout is learned, not the words.

    While the trees are grown, the word uses of a page come from the other pages, so that they learn how far to trust them.
    """
    spoken, pages = len(pages), [*pages, *others]
    both = [p for page in pages for p in ((page, without_tags(page)) if any("<" in line for line, _ in page) else (page,))]
    number = [k for k, page in enumerate(pages) for _ in range(2 if any("<" in line for line, _ in page) else 1)]
    forms = [without_tags(page) for page, k in zip(both, number, strict=True) if k < spoken]
    x: dict[tuple[bool, bool, int, int], list] = {}
    y: dict[tuple[bool, bool, int, int], list] = {}
    for fold in range(folds + 1) if words else (folds,):
        # In the last round no word is known, as in a page that is garbled beyond repair.
        uses = Uses.learn([form for k, form in zip(number, forms, strict=False) if k % folds != fold]) if fold < folds else Uses({})
        chosen = [page for k, page in zip(number, both, strict=True) if k % folds == fold or fold == folds]
        if not chosen:
            continue
        lines = np.array([read_line(line, uses) for page in chosen for line, _ in page], np.float64)
        labels = np.array([label for page in chosen for _, label in page])
        found = page_blocks(lines, np.repeat(np.arange(len(chosen)), [len(p) for p in chosen]), len(chosen))
        for k in range(len(found.x)):
            key = (bool(found.marked[k]), fold < folds, int(found.title[k]), int(found.place[k]))
            x.setdefault(key, []).append(found.x[k])
            y.setdefault(key, []).append(labels[found.line[k]])
    trees = {key: Tree(np.array(x[key], np.float64), np.array(y[key])) for key in x}
    return Model(Uses.learn(forms) if words else Uses({}), trees)


@lru_cache(maxsize=1)
def default_model() -> Model:
    layouts = labelled_layouts()
    closed = [page for name, page in layouts if name == "sign-in"]
    return train([*labelled_pages(), *closed], with_untitled([page for name, page in layouts if name != "sign-in"]))


class Classifier:
    """Main-body lines of pages; remembers the own features of a bounded number of distinct lines."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[tuple[bytes, str], list[int]] = {}
        self.table = np.empty((4096, len(Line._fields)), np.float32)
        self.size = 0

    def _add(self, line: Line) -> int:
        if self.size == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[self.size] = line
        self.size += 1
        return self.size - 1

    def lines(self, content: bytes, charset: str) -> list[list[int]]:
        """For each line of a page the rows of its blocks in the table of features; lines end at the byte 0x0A only."""
        known, out = self.known, []
        for raw in content.split(b"\n"):
            key = (raw, charset)
            line = known.get(key)
            if line is None:
                line = [self._add(read_line(block, self.model.uses)) for block in blocks(raw.decode(charset, "replace"))]
                if len(raw) < 4096:
                    known[key] = line
            out.append(line)
        return out

    def found(self, contents: list[tuple[bytes, str]]) -> list[list[tuple[int, int]]]:
        """For each page the line (from 1) and the number within the line (from 0) of its main-body blocks."""
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        pages = [self.lines(content, charset) for content, charset in contents]
        out: list[list[tuple[int, int]]] = [[] for _ in contents]
        counts = np.fromiter((len(line) for page in pages for line in page), np.int64)
        rows = np.fromiter(chain.from_iterable(chain.from_iterable(pages)), np.int64, counts.sum())
        sizes = np.array([len(page) for page in pages], np.int64)
        number = np.arange(len(counts)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        number, within = np.repeat(number, counts), np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = page_blocks(self.table[rows], np.repeat(np.repeat(np.arange(len(pages)), sizes), counts), len(pages))
        main = self.model.main(found)
        at = found.line[main]
        for page, n, k in zip(found.page[main].tolist(), number[at].tolist(), within[at].tolist(), strict=True):
            out[page].append((n, k))
        return out

    def pages(self, contents: list[tuple[bytes, str]]) -> list[list[int]]:
        """For each page the numbers of its lines with main body, counted from 1."""
        return [list(dict.fromkeys(n for n, _ in page)) for page in self.found(contents)]

    def texts(self, contents: list[tuple[bytes, str]]) -> list[str]:
        """For each page the text of its main body, a line for each block, without tags and with references resolved."""
        out = []
        for (content, charset), page in zip(contents, self.found(contents), strict=True):
            lines = content.split(b"\n")
            shown = [_TAG.sub(" ", _UNSEEN.sub("", blocks(lines[n - 1].decode(charset, "replace"))[k])) for n, k in page]
            out.append("\n".join(" ".join(html.unescape(x).split()) for x in shown))
        return out


#: Pages are classified in groups of about so many bytes, so that memory does not depend on the pages' sizes.
GROUP_BYTES = 2_000_000


def _captures(captures: DataFrame) -> DataFrame:
    return captures.select(
        "capture_id", "ingested_at", "content", "media_type", F.col("variant_snapshots.content").alias("variants")
    ).where(F.col("capture_id").isNotNull())


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list[tuple[int, int]], list[tuple[bytes, str]]]]:
    """The pages of a batch of captures in groups of bounded size: (row, snapshot) and (content, charset) of each."""
    where: list[tuple[int, int]] = []
    group: list[tuple[bytes, str]] = []
    size = 0
    contents, media, variants = batch.column(2), batch.column(3), batch.column(4)
    for k in range(batch.num_rows):
        pages = [(contents[k].as_py(), charset_of(media[k].as_py()))]
        pages += [(v, "utf-8") for v in variants[k].as_py() or ()]
        for snapshot, (content, charset) in enumerate(pages):
            if content:
                group.append((content, charset))
                where.append((k, snapshot))
                size += len(content)
        if size >= GROUP_BYTES:
            yield where, group
            where, group, size = [], [], 0
    if group:
        yield where, group


def main_body(captures: DataFrame, model: Model | None = None) -> DataFrame:
    """``capture_id, snapshot_no, line_no``: the lines of main body of every page of a capture.

    Snapshot 0 is ``content``, read as ``media_type`` declares; 1, 2, ... are the entries of ``variant_snapshots`` in order,
    in UTF-8. Lines are counted from 1 and end at the byte 0x0A; a line that holds several blocks is one of main body if any of
    them is. Empty and null pages have no lines; null entries keep their number. Of repeated deliveries the one with the
    latest ``ingested_at`` stands; rows with a null id are left out; other columns are ignored. Whole pages are read, of any
    length.

    Pages are classified where they are read; one shuffle moves line numbers, to drop repeated deliveries.
    """
    fitted = model or default_model()
    rows = _captures(captures)
    time = rows.schema["ingested_at"].dataType.simpleString()

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(fitted)
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for where, group in _groups(batch):
                for (row, snapshot), lines in zip(where, classifier.pages(group), strict=True):
                    found[row] += [snapshot << 32 | n for n in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["capture_id", "ingested_at", "lines"]
            )

    judged = rows.mapInArrow(classify, f"capture_id string, ingested_at {time}, lines array<bigint>")
    latest = judged.groupBy("capture_id").agg(F.max(F.struct("ingested_at", "lines")).alias("v"))
    return latest.select("capture_id", F.explode("v.lines").alias("at")).select(
        "capture_id", F.shiftright("at", 32).cast("int").alias("snapshot_no"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("line_no")
    )


def main_text(captures: DataFrame, model: Model | None = None) -> DataFrame:
    """``capture_id, snapshot_no, text``: the main body of every page as text, a line for each block, without tags.

    Unlike :func:`main_body` it also parts what stands on one line: of a page without line breaks only the blocks of main body come
    out. Pages with content but without main body have an empty text. All else is as there; the texts are shuffled once.
    """
    fitted = model or default_model()
    rows = _captures(captures)
    time = rows.schema["ingested_at"].dataType.simpleString()
    shape = pa.list_(pa.struct([("snapshot_no", pa.int32()), ("text", pa.string())]))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(fitted)
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for where, group in _groups(batch):
                for (row, snapshot), text in zip(where, classifier.texts(group), strict=True):
                    found[row].append({"snapshot_no": snapshot, "text": text})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, shape)], ["capture_id", "ingested_at", "texts"])

    judged = rows.mapInArrow(classify, f"capture_id string, ingested_at {time}, texts array<struct<snapshot_no int, text string>>")
    latest = judged.groupBy("capture_id").agg(F.max(F.struct("ingested_at", "texts")).alias("v"))
    return latest.select("capture_id", F.inline("v.texts"))
