from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from plumbline.operators.snapshots import baseline_fingerprint, page_fingerprint, refresh_changes, snapshot_changes
from pyspark.sql import functions as F

from tests.conftest import rows

SCHEMA = "plan_key string, url string, snapshot_no int, delivered_at timestamp_ntz, data string, __fp string, pair int"
T0 = datetime(2026, 3, 1)


def page(*candidates, **more) -> str:
    return json.dumps({"candidates": list(candidates)} | more)


def make(spark, items):
    return spark.createDataFrame([(k, u, s, at, d, "x", 1) for k, u, s, at, d in items], SCHEMA)


def changes(spark, items):
    df = make(spark, items)
    return rows(snapshot_changes(df, ["plan_key", "url"], fingerprint=page_fingerprint(F.col("data"))))


def test_what_counts_and_what_does_not(spark):
    a, b = {"fields": {"n": "é", "p": 1}, "specs": {}}, {"fields": {"n": "b"}, "specs": {"k": None}}
    same = '{"checked_at":"later", "candidates":[{"specs":{"k":null},"fields":{"n":"b"}},\n {"specs":{},"fields":{"p":1.0,"n":"\\u00e9"}}]}'
    got = changes(spark, [("k", "u", 1, T0, page(a, b)), ("k", "u", 2, T0, same), ("k", "u", 3, T0, page(a, b, b))])
    assert got == [("k", "u", 3, "changed")]


def test_added_removed_returned_and_gaps(spark):
    items = [("k", "a", 1, T0, page()), ("k", "b", 1, T0, page()), ("k", "b", 5, T0, page()), ("k", "a", 9, T0, page()), ("k", "b", 9, T0, page(1))]
    assert changes(spark, items) == [("k", "a", 5, "removed"), ("k", "a", 9, "added"), ("k", "b", 9, "changed")]


def test_latest_delivery_stands_and_repeats_count_once(spark):
    late = T0 + timedelta(days=30)
    items = [("k", "u", 1, T0, page(1)), ("k", "u", 2, late, page(1)), ("k", "u", 2, T0, page(2)), ("k", "u", 2, late, page(1)), ("k", "u", 1, None, page(7))]
    assert changes(spark, items) == []


def test_nulls_bad_json_and_empty_tables(spark):
    items = [(None, None, 1, T0, None), (None, None, 2, T0, "no json"), ("k", "u", None, T0, page()), ("k", "w", 1, T0, "{}"), ("k", "w", 2, T0, page())]
    assert changes(spark, items) == [(None, None, 2, "changed")]
    assert changes(spark, []) == []
    assert changes(spark, [("k", "u", 1, T0, page())]) == []


def test_tie_is_repeatable(spark):
    items = [("k", "u", 1, T0, page(1)), ("k", "u", 2, T0, page(1)), ("k", "u", 2, T0, page(2))]
    assert len({str(changes(spark, random.sample(items, 3))) for _ in range(3)}) == 1


def test_baselines(spark):
    def base(rules="r1", valid=True, **pages):
        return json.dumps({"rules_version": rules, "valid": valid, "last_full_at": "x", "pages": {u: {"candidates": c, "checked_at": "y"} for u, c in pages.items()}})

    data = [base(a=[1, 2]), base(a=[2, 1]), base(a=[1]), base(a=[1], b=[]), base("r2", a=[1], b=[]), base("r2", False, a=[1], b=[])]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, data string")
    prints = [r.f for r in df.select("i", baseline_fingerprint(F.col("data")).alias("f")).orderBy("i").collect()]
    assert prints[0] == prints[1] and len(set(prints)) == 5


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(f"k{rng.randrange(3)}", f"u{rng.randrange(6)}", rng.randrange(1, 5), T0 + timedelta(hours=rng.randrange(40)), page(*[rng.randrange(2) for _ in range(rng.randrange(3))])) for _ in range(120)]
    last: dict[tuple, tuple] = {}
    for k, u, s, at, d in items:
        version = (at, sorted(json.loads(d)["candidates"]))
        if (k, u, s) not in last or last[k, u, s][0] < at:
            last[k, u, s] = version
    tied = {key for key in last if len({d for k, u, s, at, d in items if (k, u, s) == key and at == last[key][0]}) > 1}
    want = set()
    for k, u in {(k, u) for k, u, _ in last}:
        for s in (2, 3, 4):
            if {(k, u, s), (k, u, s - 1)} & tied:
                continue
            old, new = last.get((k, u, s - 1)), last.get((k, u, s))
            if old is None and new is not None:
                want.add((k, u, s, "added"))
            elif new is None and old is not None:
                want.add((k, u, s, "removed"))
            elif old and new and old[1] != new[1]:
                want.add((k, u, s, "changed"))
    got = {r for r in changes(spark, items) if not {(r[0], r[1], r[2]), (r[0], r[1], r[2] - 1)} & tied}
    assert got == want


def test_both_tables(spark):
    pages = make(spark, [("k", "u", 1, T0, page()), ("k", "v", 2, T0, page())])
    baselines = spark.createDataFrame([("s", 1, T0, "{}"), ("s", 2, T0, '{"valid":true}')], "scope_key string, snapshot_no int, delivered_at timestamp_ntz, data string")
    assert rows(refresh_changes(pages, baselines)) == [("baselines", "s", "", 2, "changed"), ("pages", "k", "u", 2, "removed"), ("pages", "k", "v", 2, "added")]


def test_a_key_repeated_without_end_is_one_record(spark):
    df = spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id)) AS plan_key", "'u' AS url", "int(1 + id % 2) AS snapshot_no", "timestamp_ntz'2026-01-01 00:00:00' AS delivered_at", "'[]' AS data"
    )
    got = snapshot_changes(df, ["plan_key", "url"], fingerprint=page_fingerprint(F.col("data"))).groupBy("change").count()
    assert rows(got) == [("added", 20_000), ("removed", 20_000)]
