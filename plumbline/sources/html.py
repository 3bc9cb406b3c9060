"""A small document tree of an HTML page, and CSS selectors on it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style template noscript head".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Elements that an opening tag of the same group closes.
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class Node:
    """An element with its attributes and children; text children are strings."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> Iterator[Node]:
        """The element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def hidden(self) -> bool:
        return "hidden" in self.attrs or self.attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(self.attrs.get("style", "")))

    def shown(self) -> bool:
        """Whether neither the element nor one around it is hidden."""
        node = self
        while node is not None:
            if node.hidden() or node.tag in SILENT:
                return False
            node = node.parent
        return True

    def text(self) -> str:
        """Visible text, white space collapsed."""
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in SILENT and not node.hidden():
                stack.extend(reversed(node.children))
        return " ".join("".join(parts).split())

    def raw_text(self) -> str:
        return "".join(c for n in self.elements() for c in n.children if isinstance(c, str))

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.at.tag in _CLOSES.get(tag, ()) and self.at.parent is not None:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


@lru_cache(maxsize=1)
def parse(page: str) -> Node:
    """The tree of a page; anything is a page. The last one is kept for the next scan of the same page; don't change it."""
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


_STEP = re.compile(r"(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)\"?(?P<val>[^\"\]]*)\"?)?\]")


@lru_cache(maxsize=512)
def compile_selector(selector: str) -> tuple[tuple[tuple[str, tuple[tuple[str, ...], ...]], ...], ...]:
    """Alternatives, each a chain of (combinator, tests). Supports tags, classes, ids, attributes, descendants, ``>``, ``,``."""
    out = []
    for part in selector.split(","):
        chain, combinator = [], " "
        for piece in re.findall(r">|[^\s>]+(?:\[[^\]]*\])?", part.strip()):
            if piece == ">":
                combinator = ">"
                continue
            tests, at = [], 0
            for m in _STEP.finditer(piece):
                if m.start() != at:
                    raise ValueError(f"selector not understood: {selector!r}")
                at = m.end()
                if m["tag"]:
                    tests.append(("tag", m["tag"].lower()))
                elif m["cls"]:
                    tests.append(("class", m["cls"]))
                elif m["id"]:
                    tests.append(("attr", "id", "=", m["id"]))
                else:
                    tests.append(("attr", m["attr"].lower(), m["op"] or "", m["val"] or ""))
            if at != len(piece) or not tests:
                raise ValueError(f"selector not understood: {selector!r}")
            chain.append((combinator, tuple(tests)))
            combinator = " "
        if not chain:
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(tuple(chain))
    return tuple(out)


def _passes(node: Node, tests: tuple[tuple[str, ...], ...]) -> bool:
    for test in tests:
        if test[0] == "tag":
            if test[1] not in ("*", node.tag):
                return False
        elif test[0] == "class":
            if test[1] not in node.classes():
                return False
        else:
            _, name, op, want = test
            have = node.attrs.get(name)
            if have is None or not {
                "": True, "=": have == want, "~=": want in have.split(), "^=": have.startswith(want), "$=": have.endswith(want),
                "*=": want in have, "|=": have == want or have.startswith(want + "-"),
            }[op]:
                return False
    return True


def matches(node: Node, selector: str, scope: Node | None = None) -> bool:
    """Whether an element matches; elements above ``scope`` take no part."""
    for chain in compile_selector(selector):
        todo = [(node, len(chain) - 1)]
        while todo:
            at, k = todo.pop()
            combinator, tests = chain[k]
            if not _passes(at, tests):
                continue
            if k == 0:
                return True
            above = at.parent
            while above is not None and above is not scope and above.tag != "#root":
                todo.append((above, k - 1))
                if combinator == ">":
                    break
                above = above.parent
    return False


def select(node: Node, selector: str) -> list[Node]:
    """All elements below ``node`` that match, in document order."""
    return [n for n in node.elements() if n is not node and matches(n, selector, node)]


def value(node: Node, selector: str) -> str | None:
    """The first match's visible text, or of ``selector::attr(name)`` its attribute; null for none, hidden and blank ones. The selector
    ``.`` is the node itself."""
    selector, _, attribute = selector.partition("::attr(")
    for found in [node] if selector == "." else select(node, selector):
        if attribute:
            got = found.attrs.get(attribute.rstrip(") "))
        else:
            got = found.text() if found.shown() else None
        if got and got.strip():
            return got.strip()
    return None


def grid(table: Node, most: int = 1000) -> list[list[str]]:
    """Cell texts of a table with row and column spans filled in; spans are read up to ``most``."""

    def span(cell: Node, name: str) -> int:
        text = cell.attrs.get(name, "1")
        return max(1, min(most, int(text))) if text.isdigit() else 1

    rows: list[list[str]] = []
    held: dict[int, tuple[int, str]] = {}  # by column: rows still covered by a cell above, and its text
    for tr in (n for n in table.elements() if n.tag == "tr"):
        cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        row: list[str] = []
        below: dict[int, tuple[int, str]] = {}
        while cells or any(c >= len(row) for c in held):
            if len(row) in held:
                left, text = held[len(row)]
                if left > 1:
                    below[len(row)] = (left - 1, text)
                row.append(text)
            elif cells:
                cell = cells.pop(0)
                text, high = cell.text(), span(cell, "rowspan")
                for _ in range(span(cell, "colspan")):
                    if high > 1:
                        below[len(row)] = (high - 1, text)
                    row.append(text)
            else:
                row.append("")
        held = below
        rows.append(row)
    return rows
