from __future__ import annotations

import json

import pytest
from plumbline.sources.html import grid, matches, parse, select, value
from plumbline.sources.pages import by_adapter, css_rows, embedded_records, frontier, generic_records, json_ld, links, microdata, pagination_links, pattern_rows, price_lines, repeated_cards, snapshots, table_cells
from plumbline.sources.records import read_csv, read_json, read_xlsx, url_list, xlsx_rows
from plumbline.sources.sinks import content_store, dashboard, read_back, replace_keys, workbook, write_checked, write_store

from tests.conftest import rows

PAGE = """<!doctype html><html><body>
<ul class="list"><li class="card"><a href="/p/1?x=1#top">Alpha</a> <b class="price">10</b></li>
<li class="card"><a href="https://b.example/p/2">Beta</a> <b class="price" style="display:none">20</b></li>
<li class="card"><a href="javascript:x()">Gamma</a> <b class="price" data-v="30">30</b><li>loose</ul>
<table><tr><th>Car</th><th colspan=2>Terms</th></tr><tr><td rowspan=2>A</td><td>12</td><td>24</td></tr><tr><td>13</td><td>25</td></tr></table>
<div itemscope itemtype="P"><span itemprop="name">Pump</span><meta itemprop="price" content="9.50"></div>
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Reel","sku":7,"offers":[{"price":1.50,"priceCurrency":"EUR"},
{"@type":"AggregateOffer","lowPrice":"1","highPrice":"3"}]},{"@type":"Product","name":"Bare"}]}</script>
<script type="application/json">{"x":[{"Name":"Deep","PRICE":{"value":5}}]}</script><script type="application/ld+json">{broken</script>
</body></html>"""


@pytest.fixture
def captures(spark):
    data = [("c1", "https://a.example/l/", PAGE.encode(), "text/html", "x"), ("c2", "https://a.example/", b"", None, "x"), ("c3", None, None, None, "x")]
    return spark.createDataFrame(data, "capture_id string, url string, content binary, media_type string, locator string")


def test_selectors():
    tree = parse(PAGE)
    assert len(select(tree, "ul.list > li.card")) == 3 and len(select(tree, "li")) == 4
    assert [n.text() for n in select(tree, "a[href^=/p], b[data-v=30]")] == ["Alpha", "30"]
    card = select(tree, ".card")
    assert [value(c, "b.price") for c in card] == ["10", None, "30"] and value(card[2], "b::attr(data-v)") == "30"
    assert matches(card[0], "body li") and not matches(card[0], "div li")
    with pytest.raises(ValueError, match="not understood"):
        select(tree, "li:hover")
    assert grid(select(tree, "table")[0]) == [["Car", "Terms", "Terms"], ["A", "12", "24"], ["A", "13", "25"]]
    assert parse("<p>a<p>b</div></x>").text() == "ab"


def test_scans(captures):
    got = css_rows(captures, "li.card", {"name": "a", "price": "b.price"}).collect()
    assert [(r.locator, r.fields) for r in got] == [("css:1", {"name": "Alpha", "price": "10"}), ("css:2", {"name": "Beta"}), ("css:3", {"name": "Gamma", "price": "30"})]
    assert [(r.link, r.text) for r in links(captures).collect()] == [("https://a.example/p/1?x=1", "Alpha"), ("https://b.example/p/2", "Beta")]
    assert links(captures, ["b.example"]).count() == 1
    assert [(r.name, r.sku, r.price, r.low, r.high, r.currency) for r in json_ld(captures).collect()] == [("Reel", "7", "1.50", None, None, "EUR"), ("Reel", "7", None, "1", "3", None), ("Bare", None, None, None, None, None)]
    assert [r.properties for r in microdata(captures).collect()] == [{"name": "Pump", "price": "9.50"}]
    assert [(r.name, r.value) for r in embedded_records(captures).collect()][-1] == ("Deep", "5")
    assert [(r.header, r.label, r.cell) for r in table_cells(captures).collect()] == [("Terms", "A", "12"), ("Terms", "A", "24"), ("Terms", "A", "13"), ("Terms", "A", "25")]
    assert [(r.signature, r.cards) for r in repeated_cards(captures, 2).collect()][0] == ("li.card", 2)
    assert links(captures.limit(0)).count() == 0


def test_snapshots(spark):
    kind = "capture_id string, url string, content binary, media_type string, variant_snapshots array<struct<content binary, final_url string>>"
    df = spark.createDataFrame([("a", "u", b"x", "t", [(b"y", "v"), (None, "w"), (b"z", None)]), ("b", "u", None, None, None)], kind)
    assert [(r.capture_id, r.snapshot_no, r.url) for r in snapshots(df).orderBy("snapshot_no").collect()] == [("a", 0, "u"), ("a", 1, "v"), ("a", 3, "u")]


def test_record_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿모델,금액,spec:color\r\nA-1,\"12,000\",\"red\nblue\"\r\nB-2,,\r\n".encode())
    got = [(r.locator, r.fields, r.specs) for r in read_csv(spark, str(tmp_path / "a.csv"), {"모델": "model", "금액": "price"}).collect()]
    assert got == [("csv:row:2", {"model": "A-1", "price": "12,000"}, {"color": "red\nblue"}), ("csv:row:3", {"model": "B-2", "price": ""}, {"color": ""})]
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"p": 1.50, "q": None, "r": True, "s": [1]}, "x"]}).replace("1.5", "1.50"))
    assert [(r.locator, r.fields) for r in read_json(spark, str(tmp_path / "a.json")).collect()] == [("json:item:0", {"p": "1.50", "r": "true"})]
    (tmp_path / "bad.json").write_text("{")
    assert read_json(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "a.xlsx").write_bytes(workbook({"S & T": (["model", "price"], [["A", 1.5], [None, 2], ["<x>", None]])}))
    got = [(r.locator, r.fields, r.uncached) for r in read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()]
    assert got == [("xlsx:S & T:2", {"model": "A", "price": "1.5"}, []), ("xlsx:S & T:3", {"price": "2"}, []), ("xlsx:S & T:4", {"model": "<x>"}, [])]
    assert xlsx_rows(b"no book") == []


def test_url_list(spark):
    entries = ["https://a.example/", "# note", "", "HTTPS://A.example", "nope", "nope", None, "https://b.example/#x"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "position int, entry string")
    assert [(r.position, r.status) for r in url_list(df).orderBy("position").collect()] == [(0, "accepted"), (3, "duplicate"), (4, "invalid"), (5, "invalid"), (7, "accepted")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(b"a",), (b"a",), (None,), (b"bb",)], "c binary")
    assert [(r.size, bytes(r.payload)) for r in content_store(df, "c").orderBy("size").collect()] == [(1, b"a"), (2, b"bb")]
    store = str(tmp_path / "store")
    write_store(df.limit(2), "c", store)
    write_store(df, "c", store)
    assert spark.read.parquet(store).count() == 2
    table = str(tmp_path / "keyed")
    replace_keys(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), table, "k")
    replace_keys(spark.createDataFrame([("b", 2)], "k string, v int"), table, "k")
    assert rows(spark.read.parquet(table).select("k", "v")) == [("a", 1), ("b", 2)]
    assert write_checked(spark.createDataFrame([("b", 2), ("b", 2)], "k string, v int"), str(tmp_path / "out")).count() == 2


def test_further_scans(spark):
    page = """<p>Plan A : 13,500원</p><p>Plan B: $20</p><p>Free: 0원</p><div class="pagination"><a href="?p=2">2</a><a href="/x">About</a></div><a rel="next" href="?p=3#f">more</a><a href="?p=4">다음</a>"""
    df = spark.createDataFrame([("a", "https://a.example/l", page.encode(), None), ("b", "https://b.example/", b"<p>Only: 5 EUR</p>", None)], "capture_id string, url string, content binary, media_type string")
    assert [(r.label, r.amount, r.marker) for r in price_lines(df).collect()] == [("Plan A", "13500", "원"), ("Plan B", "20", "$")]
    assert [r.link for r in pagination_links(df).collect()] == ["https://a.example/l?p=2", "https://a.example/l?p=3", "https://a.example/l?p=4"]
    texts = spark.createDataFrame([("x", "A-1 12\nnone\nB-2 7"), ("y", " "), ("z", None), ("w", "none")], "k string, t string")
    got = rows(pattern_rows(texts, "t", r"(?P<model>[A-Z]-\d) (?P<price>\d+)", ("k",)))
    assert got == [("x", 1, {"model": "A-1", "price": "12"}), ("x", 3, {"model": "B-2", "price": "7"}), ("y", None, None), ("z", None, None)]
    found = spark.createDataFrame([("p", 2, "b"), ("p", 1, "z"), ("p", 1, "a"), ("q", 1, "c")], "page string, prio int, link string")
    assert rows(frontier(found, "prio", "link", "page", 2).select("page", "link", "place", "truncated")) == [("p", "a", 1, True), ("p", "z", 2, True), ("q", "c", 1, False)]


def test_reports(spark):
    df = spark.createDataFrame([("<a>", 1), (None, 2)], "k string, n int")
    shown = dashboard("T & U", {"counts": df}, most=1)
    assert "&lt;a&gt;" in shown and "T &amp; U" in shown and "Only the first 1 rows" in shown
    sheets = {"S": (["k", "n"], [["a", 1], [None, 2.5], ["x\x00", "7"]])}
    assert read_back(workbook(sheets), sheets) == []
    assert read_back(workbook(sheets), {"S": (["k", "n"], [["a", 1], [None, 2.5], ["y", "7"]])}) == ["S!A4: 'y' != 'x_x0000_'"]


def test_generic_chain_and_adapters(spark):
    cards = "<ul>" + "".join(f'<li class="c"><a href="/{i}">Item {i}</a> <b>{i}0원</b></li>' for i in range(1, 5)) + "</ul><h1>List</h1>"
    pages = {
        "ld": PAGE, "micro": '<div itemscope><b itemprop="name">Pump</b><i itemprop="price" content="9.50"></i></div>' + cards, "cards": cards,
        "lines": "<h1>Plans</h1><p>A: 10원</p><p>B: 20원</p>", "one": '<h1>Reel</h1><span class="price">5 EUR</span>', "gap": '<h1>Reel</h1><span class="price">5 EUR or 6 EUR</span>', "none": "<p>hi</p>",
    }
    df = spark.createDataFrame([(k, f"https://{k}.example/", v.encode(), None) for k, v in pages.items()], "capture_id string, url string, content binary, media_type string")
    got = [(r.capture_id, r.method, r.name, r.amount) for r in generic_records(df).orderBy("capture_id", "position").collect()]
    assert got == [
        ("cards", "cards", "Item 1", "10"), ("cards", "cards", "Item 2", "20"), ("cards", "cards", "Item 3", "30"), ("cards", "cards", "Item 4", "40"), ("gap", "single", "Reel", None),
        ("ld", "json_ld", "Reel", "1.50"), ("ld", "json_ld", "Reel", "1"), ("lines", "price_lines", "A", "10"), ("lines", "price_lines", "B", "20"), ("micro", "microdata", "Pump", "9.50"), ("one", "single", "Reel", "5"),
    ]
    parts = by_adapter(df, {"cards.example": "links", "lines.example": "price_lines"})
    assert {k: v.count() for k, v in parts.items()} == {"links": 4, "price_lines": 2, "generic": 5}
    with pytest.raises(ValueError, match="no such adapter: nope"):
        by_adapter(df, {"a": "nope"})


def test_cards_with_several_amounts_and_none(spark):
    def listing(*cards: str) -> str:
        return "<h1>List</h1><ul>" + "".join(f'<li class="c"><a href="/{k}">Item {k}</a> {c}</li>' for k, c in enumerate(cards, 1)) + "</ul>"

    pages = {
        "twice": listing(*["<i>10 EUR</i><em>10 EUR</em>"] * 3),
        "struck": listing("<del>20,000원</del><em>15,000원</em>", '<i style="text-decoration:line-through">$20</i><i>$15</i>', '<i class="list-price">9 USD</i><i>8 USD</i>'),
        "named": listing("<i>정가 20,000원</i><i>판매가 15,000원</i>", "<i>10 USD</i><i>9 USD</i> 10% off", "<i>10 USD</i><i>9 USD</i>", "<del>10 USD</del> 9 USD", "7 USD free shipping", "6 USD until 2026-02-18", "5~6 EUR"),
        "mixed": listing("<i>1 EUR</i>", "<i>2 EUR</i>", "<i>$3</i><i>.50</i>", "<i>4 EUR</i> <i>1 EUR shipping</i>", "on request"),
        "many": listing(*["<i>1 EUR</i><i>2 EUR</i><i>3 EUR</i><i>4 EUR</i>"] * 3),
    }
    df = spark.createDataFrame([(k, f"https://{k}.example/", v.encode(), None) for k, v in pages.items()], "capture_id string, url string, content binary, media_type string")
    got: dict[str, list] = {}
    for r in generic_records(df).orderBy("capture_id", "position").collect():
        got.setdefault(r.capture_id, []).append((r.method, r.name, r.amount))
    assert got == {
        "twice": [("cards", f"Item {k}", "10") for k in (1, 2, 3)],
        "struck": [("cards", "Item 1", "15000"), ("cards", "Item 2", "15"), ("cards", "Item 3", "8")],
        "named": [("cards", "Item 1", "15000"), ("cards", "Item 2", "9"), ("cards", "Item 3", None), ("cards", "Item 4", "9"), ("cards", "Item 5", "7"), ("cards", "Item 6", "6"), ("cards", "Item 7", None)],
        "mixed": [("cards", "Item 1", "1"), ("cards", "Item 2", "2"), ("cards", "Item 3", "3.5"), ("cards", "Item 4", "4"), ("cards", "Item 5", None)],
        "many": [("single", "List", None)],
    }


def test_page_queries_read_all_states(spark, tmp_path):
    from plumbline.plans.queries import QUERIES

    kind = "capture_id string, url string, content binary, media_type string, variant_snapshots array<struct<content binary, final_url string>>"
    page = '<div><h1>Reel</h1><span class="price">{} EUR</span></div><p>A: 1 EUR</p><p>B: 2 EUR</p><ul><li>1</li><li>2</li><li>3</li></ul><a href="/x{}">x</a>'
    df = spark.createDataFrame([("a", "https://a.example/", page.format(5, 5).encode(), None, [(None, None), (page.format(6, 6).encode(), "https://b.example/")])], kind)
    df.write.parquet(str(tmp_path / "captures.parquet"))
    for name in ("page_prices", "page_links", "page_price_lines", "page_records", "page_cards"):
        got = QUERIES[name](spark, str(tmp_path)).select("snapshot_no", "url").distinct()
        assert rows(got) == [(0, "https://a.example/"), (2, "https://b.example/")], name
