from __future__ import annotations

from datetime import datetime

from plumbline.plans.reuse import extract_changed, orphans, paired_counts, replay_problems, rule_key
from pyspark.sql import functions as F

from tests.conftest import rows


def test_only_changed_captures_are_extracted(spark):
    seen = []

    def extract(df):
        seen.append(sorted(r.capture_id for r in df.collect()))
        return df.where("content <> 'none'").select("capture_id", F.upper("content").alias("found"))

    shape = "capture_id string, content string, rules string"
    cache = spark.createDataFrame([], "rule_key string, digest string, found string")
    first = spark.createDataFrame([("a", "x", "r1"), ("b", "x", "r1"), ("c", "none", "r1")], shape)
    run = lambda df, known: extract_changed(df, known, rule_key(F.col("rules"), F.lit("v1")), F.sha2("content", 256), extract)
    results, made = run(first, cache)
    assert rows(results.select("capture_id", "found")) == [("a", "X"), ("b", "X"), ("c", None)]
    second = spark.createDataFrame([("a", "x", "r1"), ("b", "y", "r1"), ("c", "none", "r1"), ("d", "x", "r2"), ("e", None, "r1")], shape)
    results, _ = run(second, cache.unionByName(made))
    assert rows(results.select("capture_id", "found")) == [("a", "X"), ("b", "Y"), ("c", None), ("d", "X")] and seen[1] == ["b", "d", "e"]


def test_orphans(spark):
    t = lambda d: datetime(2026, 1, d)
    stored = spark.createDataFrame([("a", 1, t(1)), ("b", 2, t(1)), ("c", 3, t(1)), ("d", 4, t(9)), ("e", 5, None)], "digest string, size int, at timestamp")
    refs = spark.createDataFrame([("root", "a"), ("a", "b"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("root",)], "node string")
    assert rows(orphans(stored, refs, roots, "digest", "size", "at", F.lit("2026-01-05").cast("timestamp"))) == [("c", 3)]


def test_pairing_and_replay(spark):
    last = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), (None, "n")], "k string, v string")
    now = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "2"), ("d", "1"), (None, "n"), ("e", "x")], "k string, v string")
    assert rows(paired_counts(last, now, "k", F.col("v"))) == [(2, 1, 1, 2)]
    assert rows(paired_counts(last.limit(0), now.limit(0), "k", F.col("v"))) == [(0, 0, 0, 0)]
    assert rows(replay_problems(last, now, ["k", "v"]))[:2] == [("b", "1", 1, "not reproduced"), ("b", "2", 1, "not stored")]
