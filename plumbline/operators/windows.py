"""Ranks, slices, samples, suffixes and earlier values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import cut_lineage


#: Up to so many rows are taken from an order with a heap; more by their rank, which no single task holds.
HEAP_ROWS = 10_000


def _first(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + limit`` of the order."""
    if offset + limit <= HEAP_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    return global_rank(df, order, "__rank").where(F.col("__rank").between(offset + 1, offset + limit)).orderBy("__rank").drop("__rank")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based position of each row in the whole order, without a window over one partition.

    Rows are range-partitioned and sorted; each partition's rows are numbered from the number of rows before it. The order
    must be total for a repeatable result; equal rows get any of their positions. The ranged rows are written to the
    checkpoint folder, because the bounds are sampled and must not be drawn twice.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # One row for each partition, however many rows.
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    local = ranged.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return local.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__rn")).alias(name))


def batch_slices(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """``df`` with ``position`` (from 1) and ``batch`` (from 0): consecutive slices of ``size`` rows of the order."""
    return global_rank(df, order, "position").withColumn("batch", F.floor((F.col("position") - 1) / size))


def deterministic_sample(df: DataFrame, key: str, fingerprint: str, ratio: float, least: int = 5) -> DataFrame:
    """The ``max(least, ceil(ratio * n))`` rows with the smallest SHA-256 of fingerprint and key.

    The same rows come out in every run and on every machine. Null keys are left out. ``n`` counts all rows with a key.
    """
    keyed = df.where(F.col(key).isNotNull())
    ranked = keyed.withColumn("sample_hash", F.sha2(F.concat(F.lit(fingerprint + "\n"), F.col(key)), 256))
    wanted = max(least, math.ceil(ratio * keyed.count()))
    return _first(ranked, [F.col("sample_hash"), F.col(key)], 0, wanted)


#: Up to so many rows of a key are sorted in one task; with a key of more, rows are spread over range partitions. Results are the same.
KEY_ROWS = 1_000_000


def _has_large_key(df: DataFrame, key: str) -> bool:
    """Whether any key, null among them, has more than ``KEY_ROWS`` rows; one pre-aggregated count."""
    most = df.groupBy(key).count().agg(F.max("count")).first()[0]
    return most is not None and most > KEY_ROWS


def occurrence_suffix(df: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """``name``: the key, with ``#2``, ``#3``, ... on its second, third, ... row in the order. Null keys stay null.

    If a key has very many rows, all are numbered in the whole order by key and order, and a row's number within its key counts from the
    key's first, so that it is spread over many tasks.
    """
    if not _has_large_key(df, key):
        rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        return df.withColumn(name, F.when(F.col(key).isNull(), None).when(rn == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), rn)))
    ranked = global_rank(df, [F.col(key).asc_nulls_first(), *order], "__rank")
    firsts = ranked.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("__rank").alias("__first"))
    numbered = ranked.join(firsts, key, "left").withColumn("__rn", F.col("__rank") - F.col("__first") + 1)
    later = F.concat(F.col(key), F.lit("#"), F.col("__rn"))
    return numbered.select(*df.columns, F.when(F.col("__rn") == 1, F.col(key)).when(F.col("__rn") > 1, later).alias(name))


def previous_value(df: DataFrame, key: str, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``name``: the value of the row before, in the order, of the same key (null keys are one); null for the first.

    If a key has very many rows, all are numbered in the whole order by key and order and joined with those one number before, so that no key
    is one task.
    """
    if not _has_large_key(df, key):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    ranked = global_rank(df, [F.col(key).asc_nulls_first(), *order], "__rank")
    before = ranked.select((F.col("__rank") + 1).alias("__rank"), F.col(key).alias("__key"), F.col(value).alias("__value"))
    return ranked.join(before, "__rank", "left").select(*df.columns, F.when(F.col(key).eqNullSafe(F.col("__key")), F.col("__value")).alias(name))


def carried_forward(df: DataFrame, key: str, order: Sequence[Column], value: str, name: str, *, before: bool = False) -> DataFrame:
    """``name``: the last ``value`` that isn't null of the rows of a key up to a row in the order (``before`` it, if given); null if there is none
    and for null keys.

    If a key has very many rows, all are range-partitioned by key and order and each partition is carried forward by itself. What the last
    key of a partition leaves to the next ones is one small row a partition. So a key with a third of all rows is spread over many tasks.
    """
    if not _has_large_key(df.where(F.col(key).isNotNull()), key):
        so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return df.withColumn(name, F.when(F.col(key).isNotNull(), F.last(value, True).over(so_far)))
    ranged = cut_lineage(df.where(F.col(key).isNotNull()).repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    here = ranged.withColumn("__here", F.last(value, True).over(within))
    # For each partition and its greatest key the last value; the partitions of one key follow each other.
    greatest = ranged.groupBy("__part").agg(F.max(key).alias("__key"))
    ends = ranged.join(F.broadcast(greatest), "__part").where(F.col(key) == F.col("__key")).withColumn(
        "__left", F.last(value, True).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).groupBy("__part", "__key").agg(F.first("__left").alias("__left"))
    carried = ends.withColumn("__left", F.last("__left", True).over(Window.partitionBy("__key").orderBy("__part")))
    spans = ranged.select("__part", F.col(key).alias("__key")).groupBy("__part").agg(F.min("__key").alias("__key"))
    # A partition's first key may go on from the partitions before it: the nearest of those that end in it.
    into = spans.alias("s").join(carried.alias("c"), (F.col("s.__key") == F.col("c.__key")) & (F.col("c.__part") < F.col("s.__part"))).groupBy("s.__part", "s.__key").agg(
        F.max_by("c.__left", "c.__part").alias("__in")
    ).select(F.col("__part").alias("__into_part"), F.col("__key").alias("__into_key"), "__in")
    joined = here.join(F.broadcast(into), (F.col("__part") == F.col("__into_part")) & (F.col(key) == F.col("__into_key")), "left")
    known = joined.select(*df.columns, F.coalesce("__here", "__in").alias(name))
    return known.unionByName(df.where(F.col(key).isNull()).withColumn(name, F.lit(None).cast(df.schema[value].dataType)))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered result, with ``total`` rows of the whole and ``has_more``."""
    if offset < 0 or not 1 <= limit <= 500:
        raise ValueError("offset must not be negative, limit between 1 and 500")
    total = df.count()
    rows = _first(df, order, offset, limit)
    return rows.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(total > offset + limit)})
