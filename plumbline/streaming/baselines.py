"""Structured Streaming: baselines that advance batch by batch, and leases on work items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.sets import upsert


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below ``path``, ascending."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(root):
        return []
    found = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def _remove(spark: SparkSession, places: list[str]) -> None:
    for place in places:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)  # noqa: SLF001
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)  # noqa: SLF001


def current_baselines(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version of the baselines; None before the first."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1]:012d}") if known else None


def advance_baselines(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, trusted: Column | None = None
) -> DataStreamWriter:
    """A writer that keeps, for each key, the newest row that is ``trusted`` (all are, if none is given).

    Each micro-batch makes a new version of the whole table in its own folder, named by the batch. A batch that is run
    again after a failure starts from the version before it and overwrites its own, so the result is exactly once; versions before
    that one are removed, so two of them are kept. A row
    that isn't trusted never replaces one that is. Late rows are compared by ``version``, not by arrival.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(trusted) if trusted is not None else batch
        earlier = [v for v in _versions(spark, path) if v < number]
        base = spark.read.parquet(f"{path}/v{earlier[-1]:012d}") if earlier else rows.limit(0)
        upsert(base, rows, keys, version).write.mode("overwrite").parquet(f"{path}/v{number:012d}")
        _remove(spark, [f"{path}/v{v:012d}" for v in earlier[:-1]])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


LEASE_STATE = "status string, worker string, until_ms long, attempts int"
LEASE_OUTPUT = "item string, worker string, event string, accepted boolean, status string, attempts int"


def lease_events(events: DataFrame, seconds: int = 600) -> DataFrame:
    """Leases on items from a stream of ``item, worker, event, at`` (event: claim, done, fail).

    A claim is accepted if the item isn't done and nobody else holds an unexpired lease on it; ``done`` and ``fail`` are
    accepted from the holder while the lease lasts. One output row for each event, in event time order within a batch.
    The state of an item is one small record; rows of one item are handled one by one, in the order of their times.
    """
    span = seconds * 1000

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        status, worker, until, attempts = state.get if state.exists else ("open", "", 0, 0)
        out = []
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.at, r.worker, r.event))
        for r in rows:
            now = int(pd.Timestamp(r.at).timestamp() * 1000)
            held = status == "leased" and until > now
            good = False
            if r.event == "claim":
                good = status != "done" and (not held or worker == r.worker)
                if good:
                    attempts += not (held and worker == r.worker)
                    status, worker, until = "leased", r.worker, now + span
            elif r.event in ("done", "fail"):
                good = held and worker == r.worker
                if good:
                    status, until = ("done" if r.event == "done" else "open"), 0
            out.append((key[0], r.worker, r.event, good, status, attempts))
        state.update((status, worker, until, attempts))
        yield pd.DataFrame(out, columns=["item", "worker", "event", "accepted", "status", "attempts"])

    return events.groupBy("item").applyInPandasWithState(step, LEASE_OUTPUT, LEASE_STATE, "append", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts by windows of event time; rows later than ``late`` behind the newest are dropped by the watermark."""
    named = stream.withColumn("__at", F.col(time).cast("timestamp")).withWatermark("__at", late)
    return named.groupBy(F.window("__at", width), *by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n"
    )


def run_available(writer: DataStreamWriter, after: Callable[[], Any] | None = None) -> Any:
    """Run a stream over all that is there now, wait for its end, and return ``after()``."""
    writer.trigger(availableNow=True).start().awaitTermination()
    return after() if after else None
