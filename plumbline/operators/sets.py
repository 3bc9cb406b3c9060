"""Set and multiset operations, upserts and merges with provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.versions import latest_per_key


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns, side, n``: rows that one side has ``n`` times more often than the other; nulls equal nulls.

    One shuffle of pre-aggregated counts; a row repeated without end is one row with a count.
    """
    tagged = left.select(*columns, F.lit(1).alias("__d")).unionAll(right.select(*columns, F.lit(-1).alias("__d")))
    sums = tagged.groupBy(*columns).agg(F.sum("__d").alias("__d")).where("__d <> 0")
    return sums.select(*columns, F.when(F.col("__d") > 0, "missing").otherwise("extra").alias("side"), F.abs("__d").alias("n"))


def multiset_equal(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> bool:
    """Whether both sides have the same rows equally often."""
    return multiset_difference(left, right, columns).limit(1).count() == 0


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks; of several new ones with a key the first in ``order``.

    Null keys are never absent from each other: they are matched like values.
    """
    first = latest_per_key(new.withColumns({f"__{o}": _descending(new, o) for o in order}), keys, [f"__{o}" for o in order])
    same = [existing[k].eqNullSafe(first[k]) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return existing.unionByName(first.join(existing, cond, "left_anti").select(*existing.columns))


def _descending(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    if kind in ("int", "bigint", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
        return -F.col(column)
    if kind.startswith(("timestamp", "date")):
        return -F.unix_micros(F.col(column).cast("timestamp"))
    raise TypeError(f"no descending order of {kind}")


def upsert(existing: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Both tables with one row for each key: the newest by ``version``, of equally new ones the one from ``changes``."""
    tagged = existing.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest_per_key(tagged, keys, [version, "__new"]).drop("__new")


def union_with_provenance(parts: Mapping[str, DataFrame], name: str = "origin") -> DataFrame:
    """All rows of ``parts`` with the name of their part. The parts must have the same columns of the same types."""
    items = list(parts.items())
    shape = [(f.name, f.dataType) for f in items[0][1].schema]
    for label, df in items[1:]:
        if [(f.name, f.dataType) for f in df.schema] != shape:
            raise ValueError(f"the columns of {label} differ from those of {items[0][0]}")
    result = items[0][1].withColumn(name, F.lit(items[0][0]))
    for label, df in items[1:]:
        result = result.unionByName(df.withColumn(name, F.lit(label)))
    return result


def missing_elements(expected: Column, *found: Column) -> Column:
    """Distinct elements of the array ``expected`` that none of the arrays ``found`` holds; null arrays hold nothing."""
    rest = F.coalesce(expected, F.array())
    for f in found:
        rest = F.array_except(rest, F.coalesce(f, F.array()))
    return F.array_distinct(rest)


def first_occurrences(df: DataFrame, key: str, position: str) -> DataFrame:
    """The ordered distinct: for each key the row with the smallest position, and ``occurrences``."""
    return df.groupBy(key).agg(F.min(position).alias(position), F.count("*").alias("occurrences"))
