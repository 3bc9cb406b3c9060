from __future__ import annotations

from datetime import datetime

from plumbline.streaming.baselines import advance_baselines, current_baselines, lease_events, run_available, windowed_counts
from pyspark.sql import functions as F

from tests.conftest import rows

SHAPE = "url string, checked int, complete boolean"


def test_baselines_advance_and_partial_never_replaces(spark, tmp_path):
    source, path, check = (str(tmp_path / x) for x in ("in", "base", "check"))
    assert current_baselines(spark, path) is None
    for batch in ([("a", 1, True), ("b", 1, True), ("b", 1, True)], [("a", 5, False), ("b", 3, True), ("c", 2, False)], [("b", 2, True), (None, 1, True)]):
        spark.createDataFrame(batch, SHAPE).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SHAPE).parquet(source)
        run_available(advance_baselines(stream, path, check, ["url"], "checked", F.col("complete")))
    assert rows(current_baselines(spark, path)) == [("a", 1, True), ("b", 3, True), (None, 1, True)]


def test_leases(spark, tmp_path):
    source = str(tmp_path / "in")
    t = lambda m: datetime(2026, 1, 1, 0, m)
    events = [("u", "x", "claim", t(0)), ("u", "y", "claim", t(1)), ("u", "y", "done", t(2)), ("u", "y", "claim", t(11)), ("u", "x", "done", t(12)), ("u", "y", "done", t(13)), ("u", "x", "claim", t(14))]
    spark.createDataFrame(events, "item string, worker string, event string, at timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("item string, worker string, event string, at timestamp").parquet(source)
    writer = lease_events(stream).writeStream.format("memory").queryName("leases").outputMode("append")
    run_available(writer.option("checkpointLocation", str(tmp_path / "check")))
    got = [(r.worker, r.event, r.accepted) for r in spark.table("leases").collect()]
    assert got == [("x", "claim", True), ("y", "claim", False), ("y", "done", False), ("y", "claim", True), ("x", "done", False), ("y", "done", True), ("x", "claim", False)]


def test_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", datetime(2026, 1, 1, 0, m)) for m in (1, 2, 11, 25)], "k string, at timestamp").write.parquet(source)
    stream = spark.readStream.schema("k string, at timestamp").parquet(source)
    writer = windowed_counts(stream, "at", "10 minutes", "10 minutes", "k").writeStream.format("memory").queryName("windows").outputMode("complete")
    run_available(writer.option("checkpointLocation", str(tmp_path / "check")))
    assert sorted(r.n for r in spark.table("windows").collect()) == [1, 1, 2]
