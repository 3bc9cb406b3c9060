from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal
from statistics import median

import pytest
from plumbline.operators.aggregates import conflicts, fixed_counts, group_statistics, listed_counts, state_rollup, summary_rows, top_and_rest, with_statistics
from plumbline.operators.conditions import classify, combined, outcome, term_match
from plumbline.operators.graph import connected_components, reachable
from plumbline.operators.joins import asof_join, associate, containment_pairs, last_before, match_identifiers, most_specific_rule, planned_gaps, unidentified
from plumbline.operators.pairing import item_changes, severity
from plumbline.operators.sets import first_occurrences, insert_if_absent, missing_elements, multiset_difference, multiset_equal, union_with_provenance, upsert
from plumbline.operators.versions import first_per_key, latest_per_key
from plumbline.operators.windows import batch_slices, deterministic_sample, global_rank, occurrence_suffix, page, previous_value
from pyspark.sql import functions as F

from tests.conftest import rows


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, None, "n"), (None, None, "n")], "k string, v int, w string")
    assert rows(latest_per_key(df, ["k"], ["v"])) == [("a", 2, "z"), (None, None, "n")]
    with_map = df.withColumn("m", F.create_map(F.lit("q"), "w"))
    assert latest_per_key(with_map, ["k"], ["v"]).where("k = 'a'").first()["m"] == {"q": "z"}
    assert latest_per_key(df.limit(0), ["k"], ["v"]).count() == 0
    assert ("a", 1, "x") in rows(first_per_key(df, ["k"], "v"))


def test_exact_median(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), Decimal(rng.randrange(20)) / 4) for _ in range(61)] + [("c", None), (None, Decimal(1))]
    df = spark.createDataFrame(data, "k string, v decimal(18,2)")
    got = {r.k: (r.n, r.least, r.most, r.middle) for r in group_statistics(df, ["k"], "v").collect()}
    for k in "ab":
        v = [x for q, x in data if q == k]
        assert got[k] == (len(v), min(v), max(v), median(v))
    assert "c" not in got and got[None][0] == 1
    assert with_statistics(df, ["k"], "v").count() == len(data)
    assert group_statistics(df.limit(0), ["k"], "v").count() == 0


def test_conflicts_and_states(spark):
    df = spark.createDataFrame([("a", "10", "ok", "r2"), ("a", "10.0", "ok", "r1"), ("b", None, "no", ""), ("b", None, "no", None), ("c", "1", "ok", "r"), ("c", None, None, "r")], "k string, v string, s string, r string")
    assert rows(conflicts(df, ["k"], "v")) == [("a", 2, 2), ("c", 2, 2)]
    assert rows(state_rollup(df, ["k"], "s", "r", "ok", "no")) == [("a", "ok", "r1; r2"), ("b", "no", ""), ("c", "review", "r")]


def test_counts(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "q"), ("b", None), (None, "x")], "k string, s string")
    assert rows(fixed_counts(df, ["k"], "s", ["x", "z"])) == [("a", 1, 0), ("b", 0, 0), (None, 1, 0)]
    assert rows(listed_counts(df, "s", ["x", "z"])) == [("x", 0, 2), ("z", 1, 0)]
    assert rows(top_and_rest(df, F.col("k"), 1)) == [("a", 2), ("other", 3)]
    assert rows(top_and_rest(df.limit(0), F.col("k"), 1)) == []
    assert rows(summary_rows(df, {"n": F.count("*"), "m": F.max("s")})) == [("m", "y"), ("n", "5")]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "i int, s string")
    assert rows(multiset_difference(a, b, ["i", "s"])) == [(1, "x", "missing", 1), (3, "z", "extra", 1)]
    assert multiset_equal(a, a, ["i", "s"]) and not multiset_equal(a, b, ["i", "s"]) and multiset_equal(a.limit(0), a.limit(0), ["i", "s"])
    assert Counter(rows(union_with_provenance({"a": a, "b": b}))) == Counter([(*r, "a") for r in rows(a)] + [(*r, "b") for r in rows(b)])
    with pytest.raises(ValueError, match="columns of b"):
        union_with_provenance({"a": a, "b": b.withColumnRenamed("s", "t")})
    old = spark.createDataFrame([("a", 1), (None, 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), (None, 9), ("b", 5), ("b", 4)], "k string, v int")
    assert rows(insert_if_absent(old, new, ["k"], ["v"])) == [("a", 1), ("b", 4), (None, 1)]
    assert rows(upsert(old, new, ["k"], "v")) == [("a", 9), ("b", 5), (None, 9)]
    arrays = spark.createDataFrame([(["a", "b", "b"], ["a"], None), (None, None, None)], "e array<string>, f array<string>, g array<string>")
    assert [r[0] for r in arrays.select(missing_elements(F.col("e"), F.col("f"), F.col("g"))).collect()] == [["b"], []]
    assert rows(first_occurrences(new, "k", "v")) == [("a", 9, 1), ("b", 4, 2), (None, 9, 1)]


def test_ranks_samples_and_pages(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"k{i}") for i in range(101)], "v int, k string")
    assert [r.rank for r in global_rank(df, [F.col("v")]).orderBy("v").collect()] == list(range(1, 102))
    assert rows(batch_slices(df, [F.col("v")], 40).groupBy("batch").count()) == [(0, 40), (1, 40), (2, 21)]
    first, again = (rows(deterministic_sample(df.repartition(n), "k", "f", 0.1)) for n in (1, 3))
    assert first == again and len(first) == 11
    assert deterministic_sample(df.limit(0), "k", "f", 0.5).count() == 0 and global_rank(df.limit(0), [F.col("v")]).count() == 0
    shown = page(df, [F.col("v")], 95, 10)
    assert [(r.v, r.total, r.has_more) for r in shown.collect()] == [(v, 101, False) for v in range(95, 101)]
    with pytest.raises(ValueError, match="limit"):
        page(df, [F.col("v")], 0, 501)
    dup = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1), (None, 2)], "k string, v int")
    assert rows(occurrence_suffix(dup, "k", [F.col("v")], "n").select("n")) == [("a#2",), ("a#3",), ("a",), ("b",), (None,), (None,)]
    assert rows(previous_value(dup, "k", [F.col("v")], "v", "p").where("k = 'a'").select("v", "p")) == [(1, None), (2, 1), (3, 2)]


def test_identifier_join_equals_linear_scan(spark):
    rng = random.Random(2)
    val = lambda: rng.choice([None, "", " A1", "a1", "B2", "b2 "])
    cands = [(i, val(), val()) for i in range(30)]
    ents = [(f"p{i}", {k: v for k, v in (("model", val()), ("gtin", val())) if rng.random() < 0.8} or None) for i in range(12)]
    got = match_identifiers(spark.createDataFrame(cands, "i int, m string, g string"), spark.createDataFrame(ents, "product_id string, identifiers map<string,string>"), {"m": "model", "g": "gtin"}, "product_id")
    clean = lambda x: (x or "").strip().lower()
    want = []
    for i, m, g in cands:
        for p, ids in ents:
            asked = {k: clean((ids or {}).get(k)) for k in ("model", "gtin")}
            if any(asked.values()) and all(not v or v == clean({"model": m, "gtin": g}[k]) for k, v in asked.items()):
                want.append((i, m, g, p))
    assert rows(got) == sorted(want, key=repr) and want
    none = rows(unidentified(spark.createDataFrame(ents, "product_id string, identifiers map<string,string>"), ["model", "gtin"]).select("product_id"))
    assert none == sorted((p,) for p, ids in ents if not any(clean((ids or {}).get(k)) for k in ("model", "gtin")))


def test_asof(spark):
    rng = random.Random(4)
    t = lambda: datetime(2026, 1, 1) + timedelta(minutes=rng.randrange(30))
    left = [(i, rng.choice(["a", "b", None]), t() if rng.random() < 0.9 else None) for i in range(40)]
    right = [(rng.choice(["a", "b", None]), t(), rng.randrange(99)) for _ in range(25)]
    l, r = spark.createDataFrame(left, "i int, k string, at timestamp"), spark.createDataFrame(right, "k string, at timestamp, v int")
    got = {x.i: x.v for x in asof_join(l, r, "k", "at", "at", ["v"]).collect()}
    for i, k, at in left:
        seen = [(u, v) for q, u, v in right if q == k and k is not None and at and u <= at]
        assert got[i] == (max(seen)[1] if seen else None)
    assert len(got) == len(left)
    good = spark.createDataFrame([("u", 1, "g", "p"), ("u", 2, "b", "q"), ("u", 2, "g", "r"), ("u", 3, "b", "s"), ("w", 1, "b", "t"), (None, 1, "g", "x"), (None, 2, "b", "y")], "k string, at int, s string, id string")
    found = {r.id: r.last for r in last_before(good, "k", "at", F.col("s") == "g", "id", "last").collect()}
    assert found == {"p": None, "q": "p", "r": "p", "s": "r", "t": None, "x": None, "y": "x"}


def test_containment(spark):
    names = ["blue hose reel", "hose reel", "hose", "hose", "reel of hose reel 10", "abcd", "abc", None, "", "hose reel 10"]
    a = spark.createDataFrame([("b", i, n) for i, n in enumerate(names)], "blk string, i int, an string")
    b = spark.createDataFrame([("b", i, n) for i, n in enumerate(names)] + [("c", 99, "hose reel")], "blk string, j int, bn string")
    want = []
    for i, x in enumerate(names):
        for j, y in enumerate(names):
            if x and y and len(x) >= 4 and len(y) >= 4:
                short, long = sorted((x, y), key=len)
                if x == y or len(short) >= 6 and short in long:
                    want.append((i, j))
    got = containment_pairs(a, b, ["blk"], "an", "bn").select("i", "j")
    assert rows(got) == sorted(want, key=repr)


def test_rules_gaps_and_conditions(spark):
    rules = spark.createDataFrame([("site:a.example/*", "wide"), ("site:a.example/p/*", "deep"), ("https://a.example/p/1", "exact"), ("site:a.example/x?y", "one")], "pattern string, rule string")
    urls = spark.createDataFrame([(u,) for u in ("https://a.example/p/1", "https://a.example/p/2", "https://a.example/q", "https://a.example/x.y", "https://b.example/p/1", None)], "url string")
    got = {r.url: r.rule for r in most_specific_rule(urls, rules, "url").collect()}
    assert got == {"https://a.example/p/1": "exact", "https://a.example/p/2": "deep", "https://a.example/q": "wide", "https://a.example/x.y": "one", "https://b.example/p/1": None, None: None}
    planned = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "s string, p int")
    assert rows(planned_gaps(planned, planned.where("p = 1"), ["s", "p"])) == [("a", 2)]
    df = spark.createDataFrame([("red hose", "x"), ("blue", " "), (None, None)], "t string, v string")
    assert [r[0] for r in df.select(term_match(F.col("t"), ["hose"], ["blue"])).collect()] == [True, False, False]
    assert [r[0] for r in df.select(classify(F.col("t"), [("h", ["hose"]), ("b", ["b"])], "none")).collect()] == ["h", "b", "none"]
    a, b = outcome(F.col("v"), "equals", ["x"]), outcome(F.col("t"), "contains", ["red"])
    assert [tuple(r) for r in df.select(a, b, combined(a, b)).collect()] == [("matched", "matched", "matched"), ("unknown", "excluded", "excluded"), ("unknown", "unknown", "unknown")]


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 200)], "a int, b int")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}
    roots = spark.createDataFrame([(5,), (100,), (None,), (999,)], "node int")
    found = {r.node for r in reachable(edges.limit(12).union(edges.where("a >= 100")), roots, "a", "b").collect()}
    assert found == {*range(5, 13), 100, 101, 999}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def changes_by_hand(old, new):
    """The pairing as it is told: equal items first, then unique identities, then the rest."""
    unique = {i for i in {x[0] for x in old + new} if i is not None and sum(x[0] == i for x in old) == 1 and sum(x[0] == i for x in new) == 1}
    left, out, come = list(old), Counter(), []
    for x in new:
        if x in left:
            left.remove(x)
            out[x[0], x[1], x[1], "unchanged"] += 1
        else:
            come.append(x)
    for x in come:
        mate = next((y for y in left if x[0] in unique and y[0] == x[0]), None)
        if mate:
            left.remove(mate)
            out[x[0], mate[1], x[1], "changed"] += 1
        else:
            out[x[0], None, x[1], "added"] += 1
    for y in left:
        out[y[0], y[1], None, "unavailable"] += 1
    return out


def test_item_changes_against_the_rule(spark):
    rng = random.Random(6)
    for _ in range(3):
        lists = [[(rng.choice(["i", "j", "k", None]), f"v{rng.randrange(3)}") for _ in range(rng.randrange(9))] for _ in range(2)]
        old, new = (spark.createDataFrame([("s", *x) for x in side], "scope string, id string, body string") for side in lists)
        got = Counter()
        for r in item_changes(old, new, ["scope"], "id", F.col("body")).collect():
            got[r.identity, r.before, r.after, r.status] += r.n
        assert got == changes_by_hand(*lists)


def test_item_changes_flags(spark):
    shape = "scope string, id string, body string, rest string"
    old = spark.createDataFrame([("s", "a", "A 1", "1"), ("s", "b", "B 1", "1"), ("s", "g", "G", "1")], shape)
    new = spark.createDataFrame([("s", "a", "X 1", "1"), ("s", "b", "B 2", "2"), ("t", "n", "N", "1")], shape)
    got = item_changes(old, new, ["scope"], "id", F.col("body"), name_only=F.col("rest"), complete=F.col("scope") == "s", first=F.col("scope") == "t")
    assert [(r.identity, r.status) for r in got.orderBy(severity(F.col("status"))).collect()] == [("g", "removed_candidate"), ("b", "changed"), ("a", "conditions_changed"), ("n", "baseline")]


def test_association(spark):
    left = spark.createDataFrame([(1, "u", "a", {"size": "m"}), (2, "u", "b", None), (3, "u", "c", {"size": "m"}), (4, None, "a", None), (5, "u", "z", {})], "i int, url string, name string, v map<string,string>")
    right = spark.createDataFrame([("r1", "u", "a", {"size": "m", "x": "1"}), ("r2", "u", "a", {"size": "l"}), ("r3", "u", "b", {"size": "s"}), ("r4", "u", "b", None), ("r5", "u", "c", {"size": "l"}), ("r6", None, "a", None)], "r string, url string, name string, v map<string,string>")
    got = rows(associate(left, right, ["url", "name"], "i", "r", "v"))
    assert got == [(1, "r1", "linked"), (2, None, "ambiguous"), (3, None, "unmatched"), (4, None, "unmatched"), (5, None, "unmatched")]


def test_large_pages_and_samples_by_rank(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7 % 101, f"k{i}") for i in range(101)], "v int, k string")
    few = rows(deterministic_sample(df, "k", "f", 0.3)), [tuple(r) for r in page(df, [F.col("v")], 60, 20).collect()]
    monkeypatch.setattr("plumbline.operators.windows.HEAP_ROWS", 5)
    assert few == (rows(deterministic_sample(df, "k", "f", 0.3)), [tuple(r) for r in page(df, [F.col("v")], 60, 20).collect()])


def test_a_chain_of_more_than_64_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(66)], "a int, b int").coalesce(1)
    assert reachable(edges, spark.createDataFrame([(0,)], "node int"), "a", "b").count() == 67


@pytest.mark.parametrize("rows_of_key", [0, 1_000_000])
def test_carried_forward_over_partitions(spark, monkeypatch, rows_of_key):
    """Against brute force on both sides of the bound, with keys that fill several range partitions, nulls, and few distinct keys."""
    monkeypatch.setattr("plumbline.operators.windows.KEY_ROWS", rows_of_key)
    import random

    from plumbline.operators.windows import carried_forward, occurrence_suffix, previous_value

    rng = random.Random(5)
    data = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([None, None, None, i])) for i in range(400)]
    data += [("b", 1000 + i, None) for i in range(40)]
    df = spark.createDataFrame(data, "k string, t int, v int").repartition(3)
    for before in (False, True):
        got = {(r.k, r.t): r.seen for r in carried_forward(df, "k", [F.col("t")], "v", "seen", before=before).collect()}
        want, last = {}, {}
        for k, t, v in sorted(data, key=lambda r: r[1]):
            now = v if v is not None else last.get(k)
            want[k, t] = None if k is None else last.get(k) if before else now
            last[k] = now
        assert got == want
    assert carried_forward(df.limit(0), "k", [F.col("t")], "v", "seen").count() == 0
    number, want = {}, set()
    for k, t, _ in sorted(data, key=lambda r: r[1]):
        number[k] = number.get(k, 0) + 1
        want.add((t, None if k is None else k if number[k] == 1 else f"{k}#{number[k]}"))
    assert {(r.t, r.x) for r in occurrence_suffix(df, "k", [F.col("t")], "x").collect()} == want
    last, want = {}, set()
    for k, t, _ in sorted(data, key=lambda r: r[1]):
        want.add((t, last.get(k)))
        last[k] = t
    assert {(r.t, r.p) for r in previous_value(df, "k", [F.col("t")], "t", "p").collect()} == want


def test_newest_rows(spark):
    from plumbline.operators.versions import newest_rows

    data = [("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("a", 2, {"x": "2"}), ("b", None, None), (None, 1, None), (None, None, None)]
    df = spark.createDataFrame(data, "k string, v int, m map<string,string>")
    assert sorted(((r.k, r.v, r.m) for r in newest_rows(df, "k", "v").collect()), key=repr) == sorted([("a", 2, {"x": "2"}), ("b", None, None), (None, 1, None)], key=repr)
    assert newest_rows(df.limit(0), "k", "v").count() == 0
