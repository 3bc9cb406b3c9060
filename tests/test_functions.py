from __future__ import annotations

import hashlib
import json
from datetime import datetime

from plumbline.functions.amounts import amounts_column, currencies, deposit, hinted_currency, marked_amounts, only_amount, only_amount_column, positive_quantity, replayed_amount, scaled_decimal, strict_amount
from plumbline.functions.hashing import canonical_map, stable_id
from plumbline.functions.media import bare_media_type, charset_of, decode, media_type_of_path
from plumbline.functions.terms import market_currency, recurring_basis, retry_delay, term_months
from plumbline.functions.text import CELL_UNITS, bare_name, cell_text, comparable, comparable_column, scripts, sheet_number
from plumbline.functions.times import expired, freshness, zoned_time
from plumbline.functions.urls import canonical_url_column, host, host_allowed, item_identity, without_secrets
from pyspark.sql import functions as F


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_strict_amounts(spark):
    values = ["1,234.50", "KRW 5,000", "₩10", "1,23", "1e3", "-5", "5원", "", None, "1.234,5", " 7 "]
    got = column(spark, values, lambda v: strict_amount(v, F.lit(".")).cast("double"))
    assert got == [1234.5, 5000.0, 10.0, None, None, None, 5.0, None, None, None, 7.0]
    assert column(spark, ["1.234,5", "1,5", "1.5"], lambda v: strict_amount(v, F.lit(",")).cast("double")) == [1234.5, 1.5, None]
    assert column(spark, ["0", "2"], lambda v: positive_quantity(v, F.lit(".")).cast("double")) == [None, 2.0]
    assert column(spark, ["5"], lambda v: strict_amount(v, F.lit(";"))) == [None]


def test_marked_amounts(spark):
    text = "Was $1,299.00, now 1.234,56 € or 3만원, KRW 5.000; 12円"
    assert [(f.value, f.marker) for f in marked_amounts(text)] == [("1299", "$"), ("1234.56", "€"), ("30000", "원"), ("5000", "KRW"), ("12", "円")]
    assert only_amount("판매가 12,000원") == ("12000", None)
    assert [only_amount(t)[1] for t in (None, " ", "10원~20원", "10원 20원", "10원부터", "none")] == ["no_amount", "no_amount", "range", "several", "starting_price", "no_amount"]
    assert only_amount("10원부터", allow_from=True) == ("10", None)
    assert currencies("¥") == "CNY JPY" and currencies("eur") == "EUR" and currencies("?") == ""
    assert column(spark, ["5원", None], amounts_column)[1] == [] and column(spark, ["5원"], only_amount_column)[0].value == "5"


def test_amount_readings(spark):
    texts = {
        "€10 €20": ["10", "20"], "10 USD 20 USD": ["10", "20"], "10 20 USD": ["20"], "1.2.3 USD": [], "USD": [], "5$": [], "12 273,61\u00a0€": ["273.61"], "12\u00a0273,61 €": ["12273.61"],
        "KRW 1,234,567.5": ["1234567.5"], "3만 5천원": [], "LKB-54919 12,273.61 USD": ["12273.61"], "1.234 €": ["1.234"], "1.234원": ["1234"], "12,34,567원": [], "usd 5": ["5"],
    }
    assert {t: [f.value for f in marked_amounts(t)] for t in texts} == texts
    assert [only_amount(t)[1] for t in ("3~5만원", "$5 - $9", "2026-03-26 5원", "from $5", "$5 from here", "5원~", "3-5 days, 10 USD", "10 USD, 10 USD")] == ["range", "range", None, "starting_price", None, "starting_price", None, None]
    assert replayed_amount("$ 5") == "5" and replayed_amount("5원 6원") is None and replayed_amount(None) is None and replayed_amount(" 3만원 ") == "30000"
    df = spark.createDataFrame([("$", "usd"), ("$", "KRW"), ("원", None), ("EUR", "usd"), ("?", "usd"), (None, None)], "m string, h string")
    assert [r[0] for r in df.select(hinted_currency(F.col("m"), F.col("h"))).collect()] == ["USD", None, "KRW", "EUR", None, None]
    got = column(spark, ["보증금 300,000원 월 5원", "deposit: 5 USD, deposit 6 USD", "none", None, "Kaution 5 EUR oder 6 EUR"], deposit)
    assert [tuple(g) for g in got] == [(None, "several"), (None, "several_labels"), (None, "no_label"), (None, "no_label"), (None, "several")]
    assert tuple(column(spark, ["The deposit of 1,200 USD is returned"], deposit)[0]) == ("1200", None)
    assert column(spark, ["1,234.5", "3만", "1,23", "x", None, "0"], lambda v: scaled_decimal(v, F.lit(10))) == ["12345", "300000", None, None, None, "0"]


def test_urls(spark):
    cases = {
        "HTTPS://Shop.Example:443/a?q=1#f": "https://shop.example/a?q=1", "http://a.example": "http://a.example/", "http://a.example:8080/": "http://a.example:8080/",
        "https://bücher.example/": "https://xn--bcher-kva.example/", "ftp://a.example/": None, "https://u:p@a.example/": None, "https://localhost/": None,
        "https://10.0.0.1/": None, "https://8.8.8.8/x": "https://8.8.8.8/x", "https://a b.example/": None, "": None, "https://a..example/": None, "https://-a.example/": None,
    }
    cases |= {
        "https://a.example/" + "x" * 3000: None, "https://a.example:99999/": None, "https://a.example:0/": None, "https://[2001:DB9::1]/x": "https://[2001:db9::1]/x", "https://[::1]/": None,
        "https://192.168.1.1/": None, "https://1.2.3/": None, "http://a.example:80/p?x#y": "http://a.example/p?x", "https://a.example./": "https://a.example/", "//a.example/": None,
    }
    assert dict(zip(cases, column(spark, list(cases), canonical_url_column), strict=True)) == cases and column(spark, [None], canonical_url_column) == [None]
    urls = ["https://U:p@Shop.Example:8/a/b/?SKU=7&x=1#f", "https://a.example", None]
    assert column(spark, urls, host) == ["shop.example", "a.example", None]
    assert column(spark, urls, without_secrets) == ["https://Shop.Example:8/a/b/", "https://a.example", None]
    assert column(spark, urls, item_identity) == ["sku=7", "path:/", None]
    assert column(spark, urls, lambda v: host_allowed(v, ["example"])) == [True, True, False]


def test_identities(spark):
    df = spark.createDataFrame([('a"b', "é\n", None)], "a string, b string, c string")
    want = hashlib.sha256(json.dumps(['a"b', "é\n", None], ensure_ascii=False).encode()).hexdigest()[:24]
    assert df.select(stable_id(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want
    maps = spark.createDataFrame([({"b": "2", "a": None},), ({"a": None, "b": "2"},), (None,)], "m map<string,string>")
    assert [r[0] for r in maps.select(canonical_map(F.col("m"))).collect()] == ['{"a":null,"b":"2"}'] * 2 + [None]


def test_media(spark):
    assert charset_of('text/html; Charset="EUC-KR"') == "euc_kr" and charset_of(None) == charset_of("text/html") == charset_of("x; charset=nope") == "utf-8"
    assert decode("가".encode("euc-kr"), "text/plain;charset=euc-kr") == "가" and decode(b"\xff", None) == "�" and decode(None, None) is None
    assert column(spark, ["TEXT/HTML; x", " ", None], bare_media_type) == ["text/html", None, None]
    assert column(spark, ["a/b.CSV?x=1", "noext", None], media_type_of_path) == ["text/csv", "application/octet-stream", "application/octet-stream"]


def test_texts(spark):
    assert comparable("  Ｓtraße　Ⅳ ") == "strasse iv" and comparable(None) is None
    assert column(spark, ["ＡB", None], comparable_column) == ["ab", None]
    assert column(spark, ["Öl-Filter (XL) 5_a!"], bare_name) == ["ölfilterxl5a"]
    assert column(spark, ["한글 abc 漢字", "1"], scripts) == [["cjk", "hangul", "latin"], []]
    assert cell_text("a\x00b") == "a_x0000_b" and len(cell_text("😀" * 20000).encode("utf-16-le")) // 2 <= CELL_UNITS and cell_text(None) is None
    got = column(spark, ["123456789012345", "1234567890123456", "0.10"], lambda v: sheet_number(v.cast("decimal(38,4)")))
    assert got == [123456789012345.0, None, 0.1]


def test_times(spark):
    values = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+09:00", "2026-01-02T03:04:05", "x", None]
    got = column(spark, values, lambda v: zoned_time(v).cast("string"))
    assert got == ["2026-01-02 03:04:05", "2026-01-01 18:04:05", None, None, None]
    at = F.lit("2026-01-02 12:00:00").cast("timestamp")
    assert column(spark, ["2026-01-01", "2026-01-02", "2026-01-02T11:00:00Z", "", None, "junk"], lambda v: expired(v, at)) == [True, False, True, False, False, None]
    when = [datetime(2026, 1, 2, 12, 4), datetime(2026, 1, 2, 12, 6), datetime(2026, 1, 1), None]
    assert column(spark, when, lambda v: freshness(v, at, F.lit(24)), "timestamp") == ["observed", "unknown", "stale", "unknown"]


def test_terms(spark):
    values = ["48개월 약정", "payable for 12 months", "the 36-month plan", "24개월 또는 36개월", "12~36개월", "2년", "24 months or 2 years", "none", None, "12 months, 12개월"]
    assert column(spark, values, term_months) == [48, 12, 36, None, None, 24, 24, None, None, 12]
    assert column(spark, ["월 5원", "5 USD per year", "weekly or daily", "x", None], recurring_basis) == ["monthly", "yearly", None, None, None]
    assert column(spark, [" South  Korea", "usd", "미국", "eur", "moon", None], market_currency) == ["KRW", "USD", "USD", "EUR", None, None]
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    got = column(spark, ["7", "Thu, 01 Jan 2026 00:00:30 GMT", "Wed, 31 Dec 2025 00:00:00 GMT", "soon", None], lambda v: retry_delay(v, F.lit(3), now))
    assert got == [7.0, 30.0, 0.0, 1.5, 1.5]
