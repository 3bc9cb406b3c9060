from __future__ import annotations

import unicodedata
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm.looks import _look, canonical_column, canonical_text, look_alikes

from tests.conftest import rows

CAP = "capture_id string, ingested_at timestamp_ntz, content binary, media_type string, form string, raw int"
PRO = "product_id string, name string, form string, id int"
T = datetime(2026, 1, 1)


def whole(text: str) -> str:
    """The form by normalising all of a text, without looking for stable parts."""
    for _ in range(6):
        done = unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFC", "".join(_look(x) for x in unicodedata.normalize("NFD", c))) for c in unicodedata.normalize("NFC", text)))
        if done == text:
            break
        text = done
    return text


SAME = [
    ("Ångvik Luftfilter 1", "Ångvik Luftﬁlter 1"), ("café hose", "café hose"), ("가온누리", unicodedata.normalize("NFD", "가온누리")), ("ホース", "ﾎｰｽ"), ("ガラス", "ｶﾞﾗｽ"),
    ("ABC-123", "ＡＢＣ－１２３"), ("price", "рrісе"), ("TLU-1", "TLU‐1"), ("label", "la​b­e⁠l﻿"), ("é", "е́"), ("a　b", "a b"), ("EKT", "ΕΚΤ"),
]
OTHER = [("Angvik", "Ångvik"), ("abc", "ABC"), ("22", "2²"), ("TLU-1", "TLU1"), ("O0", "00"), ("l", "1"), ("a b", "a  b"), ("a", ""), ("x₂", "x2"), ("①", "1"), ("½", "1/2")]


def test_same_and_other():
    for a, b in SAME:
        assert canonical_text(a) == canonical_text(b), (a, b)
    for a, b in OTHER:
        assert canonical_text(a) != canonical_text(b), (a, b)
    assert canonical_text(None) is None and canonical_text("") == "" and canonical_text("​") == ""


ALPHABET = st.sampled_from(list("abé한각각가カﾞｶ̧́̊‍ ЕеοΡﬁＡ²-‐ \n漢留") + ["é", "ᅡ", "゙"])


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=14).map("".join))
def test_splicing_equals_the_whole(text):
    form = canonical_text(text)
    assert form == whole(text)
    assert canonical_text(form) == form
    assert unicodedata.is_normalized("NFC", form)


def test_products_and_captures(spark):
    products = spark.createDataFrame(
        [("p1", "Kaposé A-1", "x", 1), ("p2", "Kaposé A-1", "x", 1), ("p2", "Kaposé A-1", "y", 2), ("p3", "Kaposé A-1", "x", 1), ("p4", "KAPOSÉ A-1", "x", 1), ("p5", None, "x", 1), ("p6", "", "x", 1), (None, "Kaposé A-1", "x", 1), ("p7", "", "x", 1)],
        PRO,
    )
    long = "가나다 " * 50_000
    captures = spark.createDataFrame(
        [
            ("c1", T, "가격 1".encode("euc-kr"), "text/html; charset=EUC-KR", "x", 1), ("c2", T, "가격 1".encode(), None, "x", 1), ("c3", T, "가격 1".encode(), "text/html", "x", 1),
            ("c4", T, long.encode(), None, "x", 1), ("c5", T, (long[:-1] + " ").encode(), None, "x", 1), ("c6", T, None, None, "x", 1), ("c7", T, b"", None, "x", 1),
            ("c8", T, "가격 1".encode(), None, "x", 1), ("c8", datetime(2026, 2, 1), b"other", None, "x", 1), ("c9", T, b"\xff", None, "x", 1),
        ],
        CAP,
    )
    got = rows(look_alikes(products, captures))
    assert got == [("capture", "c1", "c3"), ("capture", "c2", "c3"), ("capture", "c4", "c5"), ("product", "p1", "p2"), ("product", "p2", "p3")]
    assert look_alikes(products.limit(0), captures.limit(0)).count() == 0
    assert products.select(canonical_column(products["name"]).alias("c")).where("c is null").count() == 1


def test_many_equal_strings_make_no_pairs(spark):
    products = spark.range(3000).selectExpr("cast(id as string) AS product_id", "if(id = 7, 'a b', 'a b') AS name")
    got = look_alikes(products, spark.createDataFrame([], CAP))
    assert got.count() == 2999
