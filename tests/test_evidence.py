"""Declared rules of evidence: each proves only its fields, only from whole texts."""

from __future__ import annotations

from plumbline.functions.evidence import attests, comparable_value, literal_price, proven_value
from pyspark.sql import functions as F


def test_rules(spark):
    cases = [
        ("price", "korean_won_amount", " 12,000 원 ", "12000"), ("price", "korean_won_amount", "월 12,000원", None), ("tax", "korean_won_amount", "12원", None), ("term_months", "korean_months", "48개월", "48"),
        ("term_months", "korean_months", "0개월", None), ("currency", "korean_won_currency", "₩", "KRW"), ("currency", "currency_marker", "$", None), ("currency", "currency_marker", "€", "EUR"),
        ("tax", "korean_vat_included", "부가세 포함", "included"), ("tax", "korean_vat_excluded", "부가세 별도", "excluded"), ("rental_conditions.annual_mileage_km", "kilometers", "20,000 KM", "20000"),
        ("reference_price", "displayed_amount", "$1,299.00", "1299"), ("price", "displayed_amount", "$5 or $6", None), ("term_months", "contract_term", "2 years", "24"), ("term_months", "contract_term", "36 months", "36"),
        ("price_basis", "recurring_marker", "/month", "monthly"), ("price_basis", "recurring_marker", "5 /month", None), ("price", "unknown", "5원", None), ("price", None, "5원", None), ("price", "korean_won_amount", None, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, field string, rule string, raw string, want string").coalesce(1)
    got = {r.i: r.v for r in df.select("i", proven_value(F.col("field"), F.col("rule"), F.col("raw")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
    proofs = spark.createDataFrame([("price", None, " 5원", "5원 "), ("price", "korean_won_amount", "5원", "5"), ("price", "korean_won_amount", "5원", "6"), ("price", None, None, None)], "f string, r string, raw string, v string")
    assert [r[0] for r in proofs.select(attests(F.col("f"), F.col("r"), F.col("raw"), F.col("v"))).collect()] == [True, True, False, False]


def test_values_and_literal_prices(spark):
    df = spark.createDataFrame([("term_months", "48 개월"), ("term_months", "x  Y"), ("price", "1,200.50 원"), ("price", "3만원"), ("price", "Ask"), ("colour", " Dark  RED "), ("price", None)], "f string, v string")
    assert [r[0] for r in df.select(comparable_value(F.col("f"), F.col("v"))).collect()] == ["48", "x y", "1200.5", "30000", "ask", "dark red", None]
    df = spark.createDataFrame([("월 12,000원부터",), ("₩ 500",), ("500",), ("5,00원",), (None,)], "p string")
    got = [tuple(r[0]) for r in df.select(literal_price(F.col("p"))).collect()]
    assert got == [("12000", "from", "monthly", "KRW"), ("500", "listed", None, "KRW"), ("500", "listed", None, None), (None,) * 4, (None,) * 4]
