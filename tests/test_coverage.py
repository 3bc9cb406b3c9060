"""Coverage, gaps, merged counters and decisions: nulls, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

from datetime import datetime

from plumbline.operators.coverage import (
    attention, counters_text, event_states, gap_items, locator_gaps, merge_counters, newest_before, not_allowed, page_status, refined_identity, refresh_reason,
    retry_batches, reuse_decisions, run_state, with_names,
)
from plumbline.sources.pages import generic_records, platform_cards
from pyspark.sql import functions as F

from tests.conftest import rows

T = [datetime(2026, 1, d) for d in range(1, 9)]


def test_newest_before(spark):
    history = spark.createDataFrame([("a", T[0], "r1"), ("a", T[2], "r2"), ("a", T[2], "r3"), ("a", T[5], "r4"), (None, T[0], "r5"), ("b", None, "r6")], "k string, t timestamp_ntz, run string")
    left = spark.createDataFrame([("a", T[2], 1), ("a", T[1], 2), ("a", T[7], 3), ("b", T[7], 4), (None, T[7], 5)], "k string, t timestamp_ntz, place0 int")
    got = sorted((r.place0, r.place, r.earlier_run) for r in newest_before(left, history, "k", "t", "run", 2).collect())
    assert got == [(1, 1, "r3"), (1, 2, "r2"), (2, 1, "r1"), (3, 1, "r4"), (3, 2, "r3")]
    assert newest_before(left.limit(0), history, "k", "t", "run", 2).count() == newest_before(left, history.limit(0), "k", "t", "run", 2).count() == 0


def test_statuses(spark):
    df = spark.createDataFrame([([],), (None,), (["bad", "bad"],), (["ok", "ok"],), (["ok", "bad"],), (["ok", None],), ([None],)], "s array<string>")
    assert [r[0] for r in df.select(page_status(F.col("s"), ["ok"], ["bad"])).collect()] == ["empty", "empty", "failed", "complete", "review", "partial", "partial"]
    runs = spark.createDataFrame([("a", "ok"), ("a", None), ("b", "ok"), ("b", "ok"), ("c", "stop"), ("c", "ok"), (None, "ok")], "k string, s string")
    assert rows(run_state(runs, ["k"], "s", ["ok"], ["stop"])) == sorted([("a", "partial"), ("b", "completed"), ("c", "paused"), (None, "completed")], key=repr)


def test_gaps(spark):
    f = lambda x: spark.createDataFrame([(v,) for v in x], "k string")
    assert rows(locator_gaps(f(["a", "a", "b", None, "d"]), f(["b", "z"]), f(["d"]), ["k"])) == sorted([("a",), (None,)], key=repr)
    pages = spark.createDataFrame([("a", "ok"), ("a", "ok"), ("b", None), ("c", "ok"), ("d", "ok")], "k string, s string")
    issues = spark.createDataFrame([("c", "x"), ("c", "w"), ("c", "x")], "k string, s string")
    got = rows(gap_items(pages, f(["a", "c"]), issues, "k", "s", ["ok"], "s"))
    assert got == [("b", 1, 1, 0, 0, ""), ("c", 1, 0, 1, 3, "w; x"), ("d", 1, 0, 0, 0, "")]
    noted = spark.createDataFrame([("a", "done"), ("a", "done"), ("b", "done"), ("b", "new"), ("b", None)], "k string, state string")
    assert rows(attention(f(["a", "b", "c", None]), noted, ["k"], "state", ["done"])) == sorted([("b", 2), ("c", 0), (None, 0)], key=repr)
    assert rows(not_allowed(f(["a", "a", "b"]), f(["b"]), ["k"])) == [("a",)]


def test_counters(spark):
    df = spark.createDataFrame([("a", {"x": 1, "y": 2}, "full"), ("a", {"x": 4}, "part"), ("b", None, "full"), ("b", {}, "full"), (None, {"z": 1}, None)], "k string, counters map<string,long>, m string")
    got = rows(merge_counters(df, ["k"], "counters", "m").withColumn("counters", counters_text(F.col("counters"))).select("k", "counters", "mode"))
    assert got == sorted([("a", "x=5; y=2", "mixed"), ("b", "", "full"), (None, "z=1", None)], key=repr) or got == sorted([("a", "x=5; y=2", "mixed"), ("b", "", "full"), (None, "z=1", "mixed")], key=repr)
    assert merge_counters(df.limit(0), ["k"], "counters").count() == 0


def test_identities_are_refined_where_they_repeat(spark):
    shape = "s string, base string, variant string, identity0 int"
    old = spark.createDataFrame([("s", "a", "1", 1), ("s", "b", "1", 1), ("s", None, "1", 1)], shape)
    new = spark.createDataFrame([("s", "a", "1", 1), ("s", "a", None, 1), ("s", "b", "2", 1)], shape)
    o, n = refined_identity(old, new, ["s"], "base", "variant")
    assert sorted(r.identity or "" for r in o.collect()) == ["", "a|1", "b"] and sorted(r.identity for r in n.collect()) == ["a|", "a|1", "b"]


def test_decisions(spark):
    shape = "known boolean, rules string, valid boolean, last timestamp_ntz"
    df = spark.createDataFrame([(False, None, None, None), (True, "r1", True, T[0]), (True, None, True, T[0]), (True, "r2", None, T[0]), (True, "r2", True, T[0]), (True, "r2", True, None), (True, "r2", True, T[6])], shape)
    why = lambda manual: [r[0] for r in df.select(refresh_reason(F.col("known"), F.col("rules"), F.lit("r2"), F.col("valid"), F.col("last"), F.lit(T[7]).cast("timestamp_ntz"), 5, manual)).collect()]
    assert why(False) == ["first_run", "rules_changed", "rules_changed", "no_valid_baseline", "interval_elapsed", "interval_elapsed", "scheduled_incremental"] and set(why(True)) == {"manual_full"}
    f = lambda x: spark.createDataFrame(x, "k string, d string, m string")
    got = rows(reuse_decisions(f([("a", "1", "t"), ("a", "2", "t"), ("a", None, "t"), ("b", "1", "t"), (None, "1", "t")]), f([("a", "1", "t"), ("a", "1", "t"), ("a", None, "t")]), "k", ["d", "m"]))
    assert {(k, d): x for k, d, _, x in got} == {("a", "1"): "reused", ("a", "2"): "changed", ("a", None): "changed", ("b", "1"): "new", (None, "1"): "new"}
    events = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), (None, 9, "x")], "k string, at int, state string")
    assert rows(event_states(events, "k", ["at"], ["state"])) == [("a", "y", 3)] and event_states(events.limit(0), "k", ["at"], ["state"]).count() == 0


def test_lookups(spark):
    names = spark.createDataFrame([("a", "B"), ("a", "A"), ("c", None)], "k string, name string")
    assert rows(with_names(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string"), names, "k", "name")) == sorted([("a", "A"), ("b", "b"), ("c", "c"), (None, None)], key=repr)
    approved = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3), ("u3", 9)], "url string, position long")
    assert rows(retry_batches(spark.createDataFrame([("u3",), ("u3",), ("x",)], "url string"), approved, "url", "position", 2)) == [("u3", 3, 1)]


def test_pages_of_shops(spark):
    def records(body):
        df = spark.createDataFrame([("c", "https://a.example/", body.encode(), None)], "capture_id string, url string, content binary, media_type string")
        return [(r.method, r.name, r.amount, r.currency) for r in generic_records(df).collect()]

    cards = "<ul>" + "".join(f"<li><a>Other {k}</a> {k}00원</li>" for k in (1, 2, 3)) + "</ul>"
    assert records(f"<body><div><h1>Pump</h1><p><del>9,000원</del> <b>7,000원</b></p></div>{cards}</body>") == [("heading", "Pump", "7000", "원")]
    assert [m for m, *_ in records(f"<body><h1>Shop</h1>{cards}</body>")] == ["cards"] * 3
    assert records('<meta property="og:title" content="Reel"><meta property="product:price:amount" content="12.50"><meta property="product:price:currency" content="EUR"><p>x</p>') == [("open_graph", "Reel", "12.50", "EUR")]
    assert records('<meta property="og:title" content="Reel"><h1>Reel</h1>') == [("single", "Reel", None, None)]
    df = spark.createDataFrame([("c", "u", b'<li class="product type-product"><h2>Box</h2></li><li class="product"><h2>No shop</h2></li>', None), ("d", "u", None, None)], "capture_id string, url string, content binary, media_type string")
    assert [(r.platform, r.name, r.amount) for r in platform_cards(df).collect()] == [("woocommerce", "Box", None)]
