"""Keep one version of each record: the latest, the first, the best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the one with the greatest ``order`` columns, nulls lowest.

    Rows equal in ``order`` are decided by their other columns, so that the result is the same in every run; columns
    without an order (maps, variants) are left out of that decision. Null keys are a key. One shuffle on the keys, with
    partial aggregation before it, and no group is ever held in memory: ``max`` of a struct keeps one row.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    plain = [c for c in rest if _orderable(df.schema[c].dataType)]
    opaque = [c for c in rest if c not in plain]
    if not opaque:
        best = df.groupBy(*[df[k] for k in keys]).agg(F.max(F.struct(*order, *plain)).alias("__best"))
        return best.select(*[F.col(f"__best.{c}").alias(c) if c not in keys else F.col(c) for c in df.columns])
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *plain]])
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def _orderable(kind) -> bool:  # noqa: ANN001
    text = kind.simpleString()
    return not any(x in text for x in ("map<", "variant", "interval"))


def latest_by_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (a window, for orders that are expressions)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def first_per_key(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row of each key with the smallest ``position`` (the ordered distinct of an input list)."""
    return latest_by_window(df, keys, [F.col(position).asc_nulls_last()])


def newest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """One whole row for each key: one with the greatest ``version`` (null is the least). For rows that have no order, with maps or long contents:
    only keys and versions are compared and shuffled before the rows are joined to them."""
    newest = df.groupBy(F.col(key).alias("__key")).agg(F.max(version).alias("__version"))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(version).eqNullSafe(F.col("__version"))
    return df.join(newest, same).select(*df.columns).dropDuplicates([key])
