"""Scans of captured pages: rows by CSS rules, links, structured data, tables. One output row for each record found.

Every scan parses a page once, in an Arrow UDF that returns an array of records; the array is then exploded by the JVM.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Collection, Iterator, Mapping
from decimal import Decimal
from typing import NamedTuple
from urllib.parse import urldefrag, urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.amounts import ISO_CODES, Found, currencies, marked_amounts, range_ends
from plumbline.functions.media import decode
from plumbline.sources.html import SILENT, Node, grid, parse, select, value

# Keys of structured data that lead to further records.
_NESTED = ("@graph", "hasVariant", "itemListElement", "item", "mainEntity", "offers", "priceSpecification", "isVariantOf")


def scan(captures: DataFrame, find: Callable[[str, str | None], list[tuple]], record: str, keep: tuple[str, ...] = ("capture_id", "url")) -> DataFrame:
    """``keep`` and the fields of ``record`` for everything that ``find`` (page text, URL) returns; its place as ``position``.
    Where captures are :func:`snapshots`, ``snapshot_no`` is kept too.

    Null and empty contents give nothing.
    """
    def run(content: bytes | None, media_type: str | None, url: str | None) -> list[tuple]:
        text = decode(content, media_type)
        return find(text, url) if text else []

    keep = (*keep, *(c for c in ("snapshot_no",) if c in captures.columns and c not in keep))
    found = F.udf(run, f"array<struct<{record}>>", useArrow=True)("content", "media_type", "url")
    rows = captures.select(*keep, F.posexplode(found).alias("position", "__r"))
    return rows.select(*keep, "position", "__r.*")


def css_rows(captures: DataFrame, row_selector: str, fields: Mapping[str, str]) -> DataFrame:
    """``locator, fields``: one row for each element that matches ``row_selector``; ``fields`` maps names to selectors below it
    (``::attr(name)`` takes an attribute). Hidden text is no value; a row without any value is left out.
    """
    wanted = dict(fields)

    def find(text: str, url: str | None) -> list[tuple]:  # noqa: ARG001
        out = []
        for k, node in enumerate(select(parse(text), row_selector)):
            got = {name: v for name, s in wanted.items() if (v := value(node, s)) is not None}
            if got:
                out.append((f"css:{k + 1}", got))
        return out

    return scan(captures, find, "locator:string,fields:map<string,string>")


def links(captures: DataFrame, hosts: list[str] | None = None) -> DataFrame:
    """``link, text``: absolute web links of pages (``a[href]``) and sitemaps (``loc``), each once a page, fragments removed.

    Links with credentials, control characters or backslashes are left out; with ``hosts``, links to others too.
    """
    def find(text: str, url: str | None) -> list[tuple]:
        tree = parse(text)
        pairs = [(n.attrs.get("href", ""), n.text()) for n in tree.elements() if n.tag == "a"] + [(n.raw_text(), "") for n in tree.elements() if n.tag == "loc"]
        out: dict[str, str] = {}
        for href, shown in pairs:
            href = href.strip()
            if not href or re.search(r"[\x00-\x1f\x7f\\]", href):
                continue
            try:
                link = urldefrag(urljoin(url or "", href))[0]
                parts = urlsplit(link)
                _ = parts.port
            except ValueError:
                continue
            if parts.scheme in ("http", "https") and parts.hostname and "@" not in parts.netloc and (hosts is None or parts.hostname in hosts):
                out.setdefault(link, shown)
        return list(out.items())

    return scan(captures, find, "link:string,text:string")


def _walk(data: object) -> Iterator[dict]:
    """All records of structured data, however deep, each before those in it."""
    todo = [data]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, dict):
            yield x
            todo.extend(x[key] for key in reversed(_NESTED) if key in x)


def _scalar(x: object) -> str | None:
    if isinstance(x, dict):
        x = x.get("name") or x.get("value") or x.get("@value")
    if isinstance(x, list):
        x = x[0] if len(x) == 1 else None
    return None if x is None or isinstance(x, (dict, list)) or str(x).strip() == "" else str(x).strip()


def _types(record: dict) -> set[str]:
    kinds = record.get("@type", [])
    return {str(k).rsplit("/", 1)[-1] for k in (kinds if isinstance(kinds, list) else [kinds])}


def _find_json_ld(text: str, url: str | None) -> list[tuple]:  # noqa: ARG001
    out = []
    if "<script" not in text.lower():
        return out
    for node in select(parse(text), "script[type=application/ld+json]"):
        try:
            data = json.loads(node.raw_text(), parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            continue
        for record in _walk(data):
            if not _types(record) & {"Product", "ProductModel", "IndividualProduct"}:
                continue
            name, sku = _scalar(record.get("name")), _scalar(record.get("sku") or record.get("mpn"))
            offers = record.get("offers") or []
            rows = []
            for offer in offers if isinstance(offers, list) else [offers]:
                if not isinstance(offer, dict):
                    continue
                stock = _scalar(offer.get("availability"))
                specs = offer.get("priceSpecification") or []
                for spec in (specs if isinstance(specs, list) else [specs]) or [offer]:
                    if isinstance(spec, dict):
                        currency = _scalar(spec.get("priceCurrency")) or _scalar(offer.get("priceCurrency"))
                        rows.append((name, sku, _scalar(spec.get("price")), _scalar(spec.get("lowPrice")), _scalar(spec.get("highPrice")), currency, stock))
            out += rows or [(name, sku, None, None, None, None, None)]
    return out


def json_ld(captures: DataFrame) -> DataFrame:
    """``name, sku, price, low, high, currency, availability``: every offer of every product in a page's JSON-LD.

    A product's offers, their price specifications and a range (AggregateOffer) are rows; a product without any is a row
    without a price. Numbers are kept as they are written. Blocks that are no JSON are left out.
    """
    return scan(captures, _find_json_ld, "name:string,sku:string,price:string,low:string,high:string,currency:string,availability:string")


def _find_microdata(text: str, url: str | None) -> list[tuple]:  # noqa: ARG001
    out = []
    if "itemscope" not in text.lower():
        return out
    for item in select(parse(text), "[itemscope]"):
        got: dict[str, str] = {}
        stack = [c for c in reversed(item.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            name = node.attrs.get("itemprop")
            if name and "itemscope" not in node.attrs:
                got.setdefault(name, node.attrs.get("content") or node.attrs.get("href") or node.attrs.get("src") or node.text())
            if "itemscope" not in node.attrs:
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if got:
            out.append((item.attrs.get("itemtype", ""), got))
    return out


def microdata(captures: DataFrame) -> DataFrame:
    """``properties``: each item marked up with ``itemscope``, its own properties; values are ``content``, links or text."""
    return scan(captures, _find_microdata, "type:string,properties:map<string,string>")


def embedded_records(captures: DataFrame, name_keys: tuple[str, ...] = ("name", "title"), value_keys: tuple[str, ...] = ("price", "amount")) -> DataFrame:
    """``name, value``: objects with a name and a value anywhere in the JSON scripts of a page, numbers as written."""
    def find(text: str, url: str | None) -> list[tuple]:  # noqa: ARG001
        out = []
        for node in select(parse(text), "script"):
            if "json" not in node.attrs.get("type", "") and node.attrs.get("id") != "__NEXT_DATA__":
                continue
            try:
                todo = [json.loads(node.raw_text(), parse_float=str, parse_int=str)]
            except (ValueError, RecursionError):
                continue
            while todo:
                x = todo.pop()
                if isinstance(x, list):
                    todo.extend(reversed(x))
                elif isinstance(x, dict):
                    low = {str(k).lower(): v for k, v in x.items()}
                    name = next((_scalar(low[k]) for k in name_keys if k in low), None)
                    val = next((_scalar(low[k]) for k in value_keys if k in low), None)
                    if name and val:
                        out.append((name, val))
                    todo.extend(v for v in reversed(list(x.values())) if isinstance(v, (dict, list)))
        return out

    return scan(captures, find, "name:string,value:string")


def table_cells(captures: DataFrame) -> DataFrame:
    """``table_no, row_no, column_no, header, label, cell``: the cells of all tables below their first row, spans filled in,
    each with the text at its head and at the start of its row: a matrix as rows."""
    def find(text: str, url: str | None) -> list[tuple]:  # noqa: ARG001
        out = []
        for t, node in enumerate(select(parse(text), "table")):
            rows = grid(node)
            head = rows[0] if rows else []
            for r, row in enumerate(rows[1:], 1):
                out += [(t, r, c, head[c] if c < len(head) else None, row[0], cell) for c, cell in enumerate(row) if c or len(row) == 1]
        return out

    return scan(captures, find, "table_no:int,row_no:int,column_no:int,header:string,label:string,cell:string")


def repeated_cards(captures: DataFrame, least: int = 3) -> DataFrame:
    """``signature, cards, texts``: groups of at least ``least`` siblings of one kind and class that hold a figure, the largest
    group of each page first."""
    def find(text: str, url: str | None) -> list[tuple]:  # noqa: ARG001
        groups: dict[tuple, list[str]] = {}
        for node in parse(text).elements():
            if node.parent is not None and node.tag in ("li", "div", "article", "tr", "a", "section") and node.shown():
                shown = node.text()
                if re.search(r"\d", shown):
                    groups.setdefault((id(node.parent), node.tag, " ".join(sorted(node.classes()))), []).append(shown)
        big = [(f"{tag}.{cls}" if cls else tag, len(t), t) for (_, tag, cls), t in groups.items() if len(t) >= least]
        return sorted(big, key=lambda g: -g[1])

    return scan(captures, find, "signature:string,cards:int,texts:array<string>")


def snapshots(captures: DataFrame) -> DataFrame:
    """``capture_id, snapshot_no, url, content, media_type``: every state of a captured page; 0 is the content, 1, 2, ... its
    variants in order (UTF-8). States without content are left out."""
    first = captures.select("capture_id", F.lit(0).alias("snapshot_no"), "url", "content", "media_type")
    further = captures.select("capture_id", F.posexplode("variant_snapshots").alias("k", "v"), "url").select(
        "capture_id", (F.col("k") + 1).alias("snapshot_no"), F.coalesce("v.final_url", "url").alias("url"),
        F.col("v.content").alias("content"), F.lit("text/html; charset=utf-8").alias("media_type"),
    )
    return first.unionByName(further).where(F.length("content") > 0)


def pattern_rows(pages: DataFrame, text: str, pattern: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep, line_no, fields``: the named groups of ``pattern`` in every line of a text that it matches.

    Texts come from an earlier step (the pages of a PDF, say). A null or blank text is one row with null ``fields``: a
    gap that is told, not a page without records. A text without a match gives nothing.
    """
    compiled = re.compile(pattern)

    def find(shown: str | None) -> list[tuple]:
        if not shown or not shown.strip():
            return [(None, None)]
        return [(n, {k: v for k, v in m.groupdict().items() if v is not None}) for n, line in enumerate(shown.split("\n"), 1) for m in compiled.finditer(line)]

    found = F.udf(find, "array<struct<line_no:int,fields:map<string,string>>>", useArrow=True)(F.col(text))
    return pages.select(*keep, F.inline(found))


def _find_price_lines(text: str, url: str | None, least: int = 2) -> list[tuple]:  # noqa: ARG001
    from plumbline.functions.amounts import marked_amounts

    out = []
    for line in re.sub(r"<br\s*/?>|</(?:p|div|li|tr|h\d)>", "\n", text).split("\n"):
        if ":" not in line and "：" not in line:
            continue
        shown = " ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split())
        label, colon, rest = shown.partition(":") if ":" in shown else shown.partition("：")
        found = marked_amounts(rest) if colon else []
        if len(found) == 1 and label.strip() and found[0].value != "0":
            out.append((label.strip(), found[0].value, found[0].marker))
    return out if len({label for label, _, _ in out}) >= least else []


def price_lines(captures: DataFrame, least: int = 2) -> DataFrame:
    """``label, amount, marker``: lines of a page that are a label and one amount ("Plan A : 13,500원"), on pages with at least
    ``least`` labels. Amounts of zero are left out."""
    return scan(captures, lambda text, url: _find_price_lines(text, url, least), "label:string,amount:string,marker:string")


#: Texts of links that lead to the next page of a listing.
NEXT = ("next", "다음", "次へ", "suivant", "weiter", "›", "»", ">")


def pagination_links(captures: DataFrame) -> DataFrame:
    """``link, text``: links to further pages of a listing: ``rel=next``, links in pagers, and links named "next"."""
    def find(text: str, url: str | None) -> list[tuple]:
        out: dict[str, str] = {}
        for node in parse(text).elements():
            if node.tag not in ("a", "link") or not node.attrs.get("href"):
                continue
            shown, around, at = node.text(), set(), node
            while at is not None:
                around |= {c.lower() for c in at.classes()}
                at = at.parent
            pager = any(w in c for c in around for w in ("pager", "pagination", "paging")) and shown.isdigit()
            if "next" in node.attrs.get("rel", "").lower().split() or shown.strip().lower() in NEXT or pager:
                link = urldefrag(urljoin(url or "", node.attrs["href"]))[0]
                if urlsplit(link).scheme in ("http", "https"):
                    out.setdefault(link, shown)
        return list(out.items())

    return scan(captures, find, "link:string,text:string")


def frontier(found: DataFrame, priority: str, order: str, group: str, limit: int) -> DataFrame:
    """``found`` with ``place`` and ``truncated``: for each group the first ``limit`` links by priority and order; ``truncated``
    tells on every row whether the group had more."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(group)
    ranked = found.withColumns({"place": F.row_number().over(w.orderBy(priority, order)), "truncated": F.count("*").over(w) > limit})
    return ranked.where(F.col("place") <= limit)


# Words in classes and labels that tell current, former and other amounts apart.
_CURRENT = frozenset(("sale", "sales", "discount", "discounted", "final", "current", "selling", "special", "now", "deal", "offer", "dc", "member"))
_FORMER = frozenset(("origin", "original", "regular", "consumer", "retail", "before", "was", "strike", "old", "msrp", "compare", "list"))
_OTHER = frozenset(("shipping", "delivery", "point", "points", "reward", "mileage", "coupon", "installment", "unit", "per"))
_CURRENT_LABEL = re.compile(r"판매가|할인가|혜택가|최종가|특가|최저가|sale\s*price|now\b|our\s*price", re.IGNORECASE)
_FORMER_LABEL = re.compile(r"정가|소비자가|시중가|기존가|정상가|권장가|\bwas\b|regular\s*price|list\s*price|\bmsrp\b", re.IGNORECASE)
_OTHER_LABEL = re.compile(
    r"^\s*\(?\s*[+＋]|배송비|택배비|적립|포인트|쿠폰|할부|단위\s*가격|(?:\d+\s*(?:g|ml|kg|l|개|매|입|m)\s*당)|shipping|delivery|reward|per\s+\d|/\s*\d+\s*(?:g|ml)\b|unit\s*price",
    re.IGNORECASE,
)
_STRUCK = re.compile(r"line-through", re.IGNORECASE)
_MARKER = re.compile(rf"[₩￦$＄€£￡¥￥원円元]|{'|'.join(ISO_CODES)}")


class Price(NamedTuple):
    """The smallest element that shows an amount: how many it shows, the one it stands for, and what kind that is."""

    node: Node
    shown: int
    value: str | None
    marker: str | None
    current: bool
    former: bool
    struck: bool
    other: bool

    @property
    def usable(self) -> bool:
        return not (self.former or self.struck or self.other)

    @property
    def key(self) -> tuple[str | None, str]:
        return self.value, currencies(self.marker or "")


def _words(node: Node) -> set[str]:
    raw = " ".join(node.attrs.get(k, "") for k in ("class", "id", "itemprop"))
    return set(re.split(r"[\s_-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", raw).lower())) - {""}


def _prices(top: Node) -> list[Price]:
    """The elements in ``top`` that show amounts, in document order. Figures in parts ("$249" and ".99") are read in the
    element around them; an element around a further one with amounts counts with the rest of its text."""
    read: dict[int, tuple[str, list[Found]]] = {}

    def amounts(node: Node) -> list[Found]:
        if id(node) not in read:
            shown = node.text()
            read[id(node)] = (shown, marked_amounts(shown))
        return read[id(node)][1]

    found: dict[int, Node] = {}
    around: set[int] = set()
    for own in top.elements():
        if not any(isinstance(c, str) and re.search(r"\d", c) for c in own.children) or not own.shown():
            continue
        node = own
        while not amounts(node) and node is not top:
            node = node.parent
        for _ in range(2):
            if len(amounts(node)) != 1 or node is top or len(amounts(node.parent)) != 1:
                break
            inner, outer = amounts(node)[0].token, amounts(node.parent)[0].token
            if inner == outer or not outer.startswith(inner):
                break
            node = node.parent
        if amounts(node) and id(node) not in found:
            found[id(node)] = node
            while node is not top:
                node = node.parent
                around.add(id(node))
    out = []
    for node in found.values():
        text, shown = read[id(node)]
        if id(node) in around:
            text = _text_besides(node, found.keys())
            shown = marked_amounts(text)
            if not shown:
                continue
        near, at, step = set(), node, 0
        struck = False
        while True:
            struck = struck or at.tag in ("del", "s", "strike") or bool(_STRUCK.search(f"{at.attrs.get('style')} {at.attrs.get('class')}"))
            if at is top:
                break
            near |= _words(at) if step < 2 else set()
            at, step = at.parent, step + 1
        current = bool(near & _CURRENT or _CURRENT_LABEL.search(text))
        former = not current and bool(near & _FORMER or _FORMER_LABEL.search(text))
        other = bool((node is not top and _words(node) & _OTHER) or _OTHER_LABEL.search(text))
        one = not range_ends(text) and len({(f.value, currencies(f.marker)) for f in shown}) == 1
        out.append(Price(node, len(shown), shown[0].value if one else None, shown[0].marker if one else None, current, former, struck, other))
    return out


def _text_besides(top: Node, others: Collection[int]) -> str:
    """The visible text of ``top`` without that of the elements ``others`` in it."""
    parts: list[str] = []
    stack: list[Node | str] = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node is not top and id(node) in others:
            parts.append(" ")
        elif node.tag not in SILENT and not node.hidden():
            stack.extend(reversed(node.children))
    return " ".join("".join(parts).split())


def _chosen(prices: list[Price], text: str) -> tuple[str | None, str | None]:
    """Amount and marker of the one current price: the only one, else the one marked as current, else the lower of two that a
    shown discount rate joins; nulls if that leaves none or several."""
    usable = [p for p in prices if p.usable and p.value]
    one = lambda found: len({p.key for p in found}) == 1
    if not any(p.usable for p in prices):
        unstruck = [p for p in prices if p.value and not p.struck]
        usable = [p for p in unstruck if not p.other] or unstruck
    if one(usable):
        return usable[0].value, usable[0].marker
    hinted = [p for p in usable if p.current]
    if one(hinted):
        return hinted[0].value, hinted[0].marker
    by_value = {Decimal(p.value): p for p in reversed(usable)}
    if len(by_value) == 2:
        low, high = sorted(by_value)
        for rate in re.findall(r"(?<![\d.])(\d{1,2})\s*%", text):
            if int(rate) and abs(high * (100 - int(rate)) / 100 - low) <= max(Decimal(1), high * Decimal("0.005")):
                return by_value[low].value, by_value[low].marker
    return None, None


def _card_name(card: Node, shown: str) -> str | None:
    """The first heading, link or bold text without an amount; else the text before the first amount, or all of it."""
    named = [t for n in select(card, "h2, h3, h4, strong, a, b") if n.shown() and (t := n.text())]
    first = next((t for t in named if not marked_amounts(t)), None) or next((t for t in named if marked_amounts(t)[0].start), None)
    found = marked_amounts(shown)
    alt = next((t for n in select(card, "img") if (t := n.attrs.get("alt", "").strip())), None)
    return first or (shown[: found[0].start].strip() if found else None) or alt or shown or None


def _priced(card: Node, prices: list[Price]) -> bool:
    """Whether a card shows one to three amounts, struck and other ones counted or not; text without any element or link, a
    sentence say, has to show one amount only."""
    if card.tag != "a" and not any(isinstance(c, Node) for c in card.children):
        return any(p.value or p.shown == 1 for p in prices)
    return 1 <= sum(p.shown for p in prices) <= 3 or 1 <= sum(p.shown for p in prices if p.usable) <= 3


def _card_rows(text: str) -> list[tuple[str, str | None, str | None]]:
    """Name, amount and marker of all cards of the largest repeated group in which four of five cards are ``_priced``. A card
    without one clear amount has nulls; elements that show nothing are no cards."""
    groups: dict[tuple, list[Node]] = {}
    for node in parse(text).elements():
        if node.parent is not None and node.tag in ("li", "div", "article", "tr", "a", "section") and node.shown():
            groups.setdefault((id(node.parent), node.tag, " ".join(sorted(node.classes()))), []).append(node)
    for nodes in sorted(groups.values(), key=len, reverse=True):
        if len(nodes) < 3:
            break
        cards = [(n, shown) for n in nodes if (shown := n.text()) or any(i.attrs.get("alt") for i in select(n, "img"))]
        spare, read = len(cards) - 0.8 * len(cards), []
        for card, shown in cards if len(cards) >= 3 else ():
            prices = _prices(card) if _MARKER.search(shown) else []
            spare -= not _priced(card, prices)
            if spare < -1e-9:
                break
            read.append((card, shown, prices))
        if read and len(read) == len(cards):
            return [(_card_name(n, shown), *_chosen(prices, shown)) for n, shown, prices in read]
    return []


def _single_row(text: str) -> list[tuple[str, str | None, str | None]]:
    """The page's heading with its one marked amount; the heading alone if there is none or several."""
    from plumbline.functions.amounts import marked_amounts

    tree = parse(text)
    name = value(tree, "h1")
    if not name:
        return []
    prices = [n for n in select(tree, "[class*=price], [itemprop=price]") if n.shown()]
    found = {(f.value, f.marker) for n in prices for f in marked_amounts(n.text())}
    only = found.pop() if len(found) == 1 else (None, None)
    return [(name, *only)]


# How two shop platforms mark up a listing: its cards, and in them the name and the price.
PLATFORMS = {
    "cafe24": ("li[id^=anchorBoxId_]", (".name a", ".name"), (".spec", ".price", "ul")),
    "woocommerce": ("li.product", (".woocommerce-loop-product__title", "h2", "h3"), (".price",)),
}


def _platform_rows(text: str) -> list[tuple[str, str, str | None, str | None]]:
    """Platform, name, amount and marker of the cards of a listing of a known platform."""
    tree, out = parse(text), []
    for platform, (card, names, prices) in PLATFORMS.items():
        for node in select(tree, card) if card.split("[")[0].split(".")[0] else ():
            if not node.shown():
                continue
            name = next((t for s in names if (t := value(node, s))), None)
            if platform == "woocommerce" and not any("woocommerce" in c or c.startswith("type-product") for n in [node, *node.elements()] for c in n.classes()):
                continue
            part = next((n for s in prices for n in select(node, s) if n.shown() and marked_amounts(n.text())), None)
            if name:
                out.append((platform, name, *(_chosen(_prices(part), part.text()) if part is not None else (None, None))))
    return out


def platform_cards(captures: DataFrame) -> DataFrame:
    """``platform, name, amount, currency``: the cards of listings that a known shop platform made; see ``PLATFORMS``.

    A card without one clear current price has a null amount.
    """
    return scan(captures, lambda text, url: _platform_rows(text), "platform:string,name:string,amount:string,currency:string")  # noqa: ARG005


def _open_graph_row(text: str) -> list[tuple[str, str, str | None]]:
    """Title, price and currency of a page's OpenGraph metadata, if it states both a title and a price."""
    if "property" not in text:
        return []
    stated = {n.attrs["property"].lower(): n.attrs.get("content", "").strip() for n in select(parse(text), "meta[property]")}
    price = next((v for k in ("product:sale_price:amount", "product:price:amount", "og:price:amount") if (v := stated.get(k))), None)
    currency = next((v for k in ("product:sale_price:currency", "product:price:currency", "og:price:currency") if (v := stated.get(k))), None)
    return [(stated["og:title"], price, currency)] if stated.get("og:title") and price else []


def _headed_row(text: str) -> list[tuple[str, str | None, str | None]]:
    """The product of a page's only ``h1``, if one clear price stands beside it, within its parent or the parent's: a product page, whatever
    cards of other things it lists."""
    heads = [n for n in select(parse(text), "h1") if n.shown() and n.text()]
    if len(heads) != 1:
        return []
    around = heads[0].parent
    for _ in range(2):
        if around is None or around.tag in ("body", "html", "#root"):
            return []
        shown = around.text()
        if marked_amounts(shown) and len(_prices(around)) <= 3:
            amount = _chosen(_prices(around), shown)
            return [(heads[0].text(), *amount)] if amount[0] else []
        around = around.parent
    return []


def generic_records(captures: DataFrame) -> DataFrame:
    """``method, name, amount, currency``: the records of any page, by the first of these that finds one: ``platform`` cards, structured data
    (``json_ld``, ``microdata``), the ``heading`` with a price beside it, repeated ``cards``, ``price_lines``, the price of
    ``open_graph`` metadata, a ``single`` product.

    A card or single product without one clear amount is a row with a null amount: a gap that is told.
    """
    def chain(text: str, url: str | None) -> list[tuple]:
        found = [("platform", *row[1:]) for row in _platform_rows(text)]
        if found:
            return found
        found = [("json_ld", n or "", p or low, c) for n, _, p, low, _, c, _ in _find_json_ld(text, url) if p or low]
        if not found:
            items = [props for _, props in _find_microdata(text, url)]
            found = [("microdata", i["name"], i["price"], i.get("priceCurrency")) for i in items if i.get("name") and i.get("price")]
        if not found:
            found = [("heading", *row) for row in _headed_row(text)]
        if not found:
            found = [("cards", *row) for row in _card_rows(text)]
        if not found:
            found = [("price_lines", *row) for row in _find_price_lines(text, url)]
        if not found:
            found = [("open_graph", *row) for row in _open_graph_row(text)]
        return found or [("single", *row) for row in _single_row(text)]

    return scan(captures, chain, "method:string,name:string,amount:string,currency:string")


#: The scans that a source may name; a closed list.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "generic": generic_records, "json_ld": json_ld, "microdata": microdata, "embedded": embedded_records, "cards": repeated_cards,
    "platform": platform_cards, "price_lines": price_lines, "tables": table_cells, "links": links,
}


def by_adapter(captures: DataFrame, hosts: Mapping[str, str], default: str = "generic") -> dict[str, DataFrame]:
    """For each adapter the result of its scan over the captures of its hosts; other hosts go to ``default``."""
    unknown = set(hosts.values()) - ADAPTERS.keys()
    if unknown or default not in ADAPTERS:
        raise ValueError(f"no such adapter: {', '.join(sorted(unknown)) or default}")
    at = F.lower(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1))
    out = {}
    for name in dict.fromkeys([*hosts.values(), default]):
        mine = [h for h, a in hosts.items() if a == name]
        test = at.isin(mine) if mine else F.lit(False)
        if name == default:
            test = test | ~at.isin(list(hosts)) if hosts else F.lit(True)
        out[name] = ADAPTERS[name](captures.where(test))
    return out
