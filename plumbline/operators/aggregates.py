"""Grouped statistics, conflicts, state roll-ups and counts with fixed keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_statistics(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """``keys, n, least, most, middle``: count, minimum, maximum and exact median of a decimal column, nulls left out.

    The median of an even number of values is the exact mean of the middle two. A group is never gathered into an array:
    values are counted first, so that a group is as large as its number of distinct values, and the median is read off
    the running counts of a window, which spills. Groups without values are left out.
    """
    counts = df.where(F.col(amount).isNotNull()).groupBy(*keys, F.col(amount).alias("__v")).agg(F.count("*").alias("__c"))
    of = Window.partitionBy(*keys)
    running = counts.select(
        "*",
        F.sum("__c").over(of).alias("__n"),
        F.sum("__c").over(of.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
    )
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1
    holds = lambda at: (F.col("__upto") - F.col("__c") < at) & (at <= F.col("__upto"))
    return running.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"),
        ((F.max(F.when(holds(low), F.col("__v"))) + F.max(F.when(holds(high), F.col("__v")))) / 2).alias("middle"),
    )


def with_statistics(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Each row of ``df`` with the statistics of its group; null for rows of a group without values and null keys."""
    return df.join(group_statistics(df, keys, amount), list(keys), "left")


def conflicts(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """The groups whose rows state more than one amount, null counting as an amount: ``keys, n, amounts``.

    Amounts are compared as they are written: as strings ``10`` and ``10.0`` conflict.
    """
    stated = F.coalesce(F.col(amount).cast("string"), F.lit("\0"))
    return (
        df.groupBy(*keys, stated.alias("__a")).agg(F.count("*").alias("__c"))
        .groupBy(*keys).agg(F.sum("__c").alias("n"), F.count("*").alias("amounts"))
        .where("amounts > 1")
    )


def state_rollup(df: DataFrame, keys: Sequence[str], state: str, reason: str, complete: str, unavailable: str) -> DataFrame:
    """``keys, state, reasons``: one state for the states of a group's rows.

    All ``complete``: complete; all ``unavailable``: unavailable; otherwise ``review``. Reasons: the distinct non-empty
    ones, sorted, joined by ``; ``. A null state is neither. The distinct reasons of a group make one text, so reasons are
    expected to be of a kind, not free text for each row.
    """
    every = lambda wanted: F.every(F.coalesce(F.col(state) == wanted, F.lit(False)))
    kept = F.collect_set(F.when(F.trim(reason) != "", F.col(reason)))
    return df.groupBy(*keys).agg(
        F.when(every(complete), complete).when(every(unavailable), unavailable).otherwise("review").alias("state"),
        F.array_join(F.array_sort(kept), "; ").alias("reasons"),
    )


def fixed_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """One count for each of ``values`` (zero where there is none) for each key; other values aren't counted."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def listed_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """``value, n``: one row for each of ``values``, in their order (``position``), with zero where there is none."""
    listed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, position int")
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return listed.join(counted, "value", "left").select("value", "position", F.coalesce("n", F.lit(0)).alias("n"))


def top_and_rest(df: DataFrame, key: Column, top: int, rest: str = "other") -> DataFrame:
    """``key, n``: the ``top`` most frequent keys, equal counts by key, and one row for all others together.

    Null keys count among the others.
    """
    counts = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    best = counts.where(F.col("key").isNotNull()).orderBy(F.desc("n"), F.asc("key")).limit(top)
    others = counts.join(best.select("key"), "key", "left_anti").agg(F.sum("n").alias("n")).where(F.col("n").isNotNull())
    return best.unionByName(others.select(F.lit(rest).alias("key"), "n"))


def summary_rows(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """``measure, value``: several aggregates of one table as rows, in one pass."""
    row = df.agg(*[v.cast("string").alias(k) for k, v in measures.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in measures])))
