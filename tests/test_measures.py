from __future__ import annotations

import itertools
import random

import pytest
from plumbline.functions.units import alias_dictionary, edit_distance
from plumbline.operators.measures import normalize_offers, same_offers

from tests.conftest import rows

ROWS = "row_id long, source_id string, model string, price string, currency string, unit string, pack_quantity string, price_basis string, ingested_at timestamp_ntz, __sep string, dimension int"


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([("dot", "."), ("comma", ","), (None, None)], "source_id string, decimal_separator string")


def offers(spark, sources, items):
    import datetime

    data = [(i, src, "M", price, "EUR", unit, pack, basis, datetime.datetime(2026, 1, 1), "x", 1) for i, (src, price, unit, pack, basis) in enumerate(items)]
    return {r.row_id: (r.dimension, r.content and round(r.content, 6), r.unit_price and round(r.unit_price, 9)) for r in normalize_offers(spark.createDataFrame(data, ROWS), sources).collect()}


def test_contents_and_prices(spark, sources):
    got = offers(
        spark, sources,
        [
            ("dot", "1,200.50", "g", "500", "pack"), ("comma", "1.200,50", "g", "0,5 kg", "per pack"), ("dot", "12", "box", "4 x 6입", "pack"),
            ("dot", "2.5 / kg", "-", "500g×2", None), ("dot", "30 cents", "100g", "5", "each"), ("dot", "1.2만원", "kg", "10", "per 100 g"),
            ("dot", "5", "dozen", "2", "per unit"), ("dot", "5천원", "fl. oz", "1", "팩"), ("dot", "8 per 1 gal", "l", "2", "pack"), ("dot", "1", "㎏", "1", "kg당"),
        ],
    )
    assert got[0] == got[1] == ("mass", 500.0, 2.401)
    assert got[2] == ("count", 24.0, 0.5)
    assert got[3] == ("mass", 1000.0, 0.0025)
    assert got[4] == ("mass", 500.0, 0.003)
    assert got[5] == ("mass", 10000.0, 120.0)
    assert got[6] == ("count", 24.0, round(5 / 12, 9))
    assert got[7] == ("volume", 29.573530, round(5000 / 29.5735295625, 9))
    assert got[8] == ("volume", 2000.0, round(8 / 3785.411784, 9))
    assert got[9] == ("mass", 1000.0, 0.001)


def test_unknown_stays_unknown(spark, sources):
    items = [
        ("dot", None, "g", "1", "pack"), ("dot", "가격 문의", "g", "1", "pack"), ("dot", "5", None, "1", "pack"), ("dot", "5", "g", None, "pack"),
        ("dot", "5", "g", "1", None), ("dot", "5", "g", "1", ""), ("dot", "5", "box", "24", "pack"), ("dot", "5", "box", "24 ea", "each"),
        ("dot", "5", "g", "1", "per m"), ("dot", "0", "g", "1", "pack"), ("dot", "5", "blorp", "1", "pack"), ("dot", "1.2.3", "g", "1", "pack"),
        (None, "", "", "", ""), ("dot", "5" * 4000, "g" * 4000, "x" * 4000, "per " * 1000),
    ]
    assert set(offers(spark, sources, items).values()) == {(None, None, None)}


def test_spellings_are_mapped_by_nearness(spark):
    words = ["Grams", "KILOGRAM", "mililiter", "Litre ", "metrs", "inchs", "mm", "MM", "M", "ｋｇ", "qq", "", None, "g", "xyzzy", "gram", "gram"]
    df = spark.createDataFrame([(w,) for w in words], "spelling string")
    got = {r.spelling: r.unit for r in alias_dictionary(df).collect()}
    assert got == {"Grams": "g", "KILOGRAM": "kg", "mililiter": "ml", "Litre ": "l", "metrs": "m", "inchs": "in", "mm": "mm", "MM": "mm", "M": "m", "ｋｇ": "kg", "g": "g", "gram": "g"}
    assert edit_distance("Gram", "gram") < edit_distance("grem", "gram") and edit_distance("garm", "gram") < 1


def test_latest_delivery_and_repeats(spark, sources):
    import datetime

    t = datetime.datetime
    data = [(1, "dot", "M", p, "EUR", "g", "1", "pack", at, "x", 1) for p, at in (("5", t(2026, 1, 1)), ("7", t(2026, 1, 2)), ("7", t(2026, 1, 2)), ("9", None))]
    got = normalize_offers(spark.createDataFrame(data, ROWS), sources).collect()
    assert [(r.row_id, r.unit_price) for r in got] == [(1, 7.0)]


def test_empty(spark, sources):
    empty = spark.createDataFrame([], ROWS)
    assert normalize_offers(empty, sources.limit(0)).count() == 0
    assert same_offers(normalize_offers(empty, sources)).count() == 0


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["A", "A", "A", "B", None]), rng.choice(["EUR", "USD"]), rng.choice(["mass", "count"]), 100 * (1 + rng.randrange(5) * 0.0004), 2 * (1 + rng.randrange(5) * 0.0004)) for i in range(150)]
    data += [(200, "A", "EUR", None, None, None), (201, "A", "EUR", "mass", 1e-9, 1e9), (202, "A", "EUR", "mass", 1e-9, 1e9)]
    df = spark.createDataFrame(data, "row_id long, model string, currency string, dimension string, content double, unit_price double")
    near = lambda x, y: abs(x - y) <= 0.001 * max(x, y)
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(data, 2) if a[1] and a[1:4] == b[1:4] and a[4] and b[4] and near(a[4], b[4]) and near(a[5], b[5]))
    assert rows(same_offers(df)) == sorted(want, key=repr) and len(want) > 100


def test_one_model_with_a_third_of_all_rows_is_many_keys(spark):
    """Offers of one model that differ meet in no key: the join forms about as many pairs as there are agreeing ones."""
    df = spark.range(30_000).selectExpr(
        "id AS row_id", "if(id % 3 = 0, 'hot', concat('m', id)) AS model", "'EUR' AS currency", "'mass' AS dimension", "exp(id * 0.003) AS content", "2.0D AS unit_price"
    )
    assert rows(same_offers(df)) == []
    twins = df.unionByName(df.where("row_id % 3000 = 0").withColumn("row_id", df["row_id"] + 100_000))
    assert len(rows(same_offers(twins))) == 10
