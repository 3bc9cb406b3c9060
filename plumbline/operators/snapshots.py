"""What changed between consecutive full snapshots of a table.

The two snapshots of a pair are unioned with a side tag, grouped by key in one shuffle, and classified from one row hash
for each side. JSON is parsed, canonicalised and hashed in the scan stage, so that only keys, a delivery time and a
64-bit hash are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A member value that was written as a floating point number but is whole: ``1e3`` and ``1000.0`` print as ``1000.0``.
_WHOLE_DOUBLE = r'(?<=[^\\]":)(-?\d+)\.0(?=[,}])'


def canonical_json(variant: Column) -> Column:
    """Canonical text of a variant: sorted object keys, no white space, no needless zeros, characters unescaped."""
    return F.regexp_replace(F.to_json(variant), _WHOLE_DOUBLE, "$1")


def json_multiset(variant: Column) -> Column:
    """The elements of a JSON array as a sorted array of canonical texts, so that equal multisets are equal arrays.

    Null and a missing value give an empty array; any other value that is no array counts as its only element.
    """
    parts = F.expr("array()").cast("array<string>")
    elements = F.try_variant_get(variant, "$", "array<variant>")
    single = F.array(canonical_json(variant))
    missing = variant.isNull() | F.is_variant_null(variant)
    return (
        F.when(missing, parts)
        .when(elements.isNotNull(), F.array_sort(F.transform(elements, lambda v: F.coalesce(canonical_json(v), F.lit("null")))))
        .otherwise(single)
    )


def page_fingerprint(data: Column) -> Column:
    """64-bit hash of what counts in a refresh page: its ``candidates`` as a multiset of JSON values.

    Text that is no JSON (or repeats a key in one object) is hashed as it is; null has a hash of its own.
    """
    doc = F.try_parse_json(data)
    return F.when(doc.isNull(), F.xxhash64(F.lit("text"), data)).otherwise(
        F.xxhash64(F.lit("page"), json_multiset(F.try_variant_get(doc, "$.candidates", "variant")))
    )


def baseline_fingerprint(data: Column) -> Column:
    """64-bit hash of what counts in a refresh baseline: ``rules_version``, ``valid``, the page URLs and each page's
    ``candidates`` as a multiset. Other text and null: as in :func:`page_fingerprint`.
    """
    doc = F.try_parse_json(data)

    def member(path: str) -> Column:
        return F.coalesce(canonical_json(F.try_variant_get(doc, path, "variant")), F.lit("null"))

    pages = F.map_entries(F.try_variant_get(doc, "$.pages", "map<string,variant>"))
    listed = F.array_sort(
        F.transform(
            pages,
            lambda e: F.struct(
                e["key"].alias("url"),
                json_multiset(F.try_variant_get(e["value"], "$.candidates", "variant")).alias("candidates"),
            ),
        )
    )
    return F.when(doc.isNull(), F.xxhash64(F.lit("text"), data)).otherwise(
        F.xxhash64(F.lit("baseline"), member("$.rules_version"), member("$.valid"), listed)
    )


def snapshot_changes(
    df: DataFrame,
    keys: Sequence[str],
    *,
    snapshot: str = "snapshot_no",
    delivered: str = "delivered_at",
    fingerprint: Column,
) -> DataFrame:
    """``keys``, ``snapshot`` (the later of two consecutive ones) and ``change``: added, removed or changed.

    * Consecutive are the snapshot numbers that occur in ``df``, in order; gaps in the numbering don't matter.
    * A record sent more than once in a snapshot counts as delivered last. Of equally late ones the greatest
      fingerprint stands, so that the result is the same in every run. A null delivery time is the earliest.
    * Rows with a null snapshot number belong to no snapshot and are left out. Null keys are keys like others.
    * A record that returns after an absence is added. No snapshot or only one gives no rows.

    One shuffle of (key, time, hash); a row is sent at most twice, once for each pair it takes part in. No step gathers
    a key's rows, so a key repeated without end costs no memory.
    """
    rows = df.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(snapshot).alias("__no"),
        F.col(delivered).alias("__at"),
        fingerprint.alias("__fp"),
    ).where(F.col("__no").isNotNull())
    # One row for each snapshot, however large the table: the window runs over their numbers only.
    numbers = df.select(F.col(snapshot).alias("__no")).where(F.col("__no").isNotNull()).distinct()
    order = Window.orderBy("__no")
    numbers = numbers.select(
        "__no",
        F.array_compact(
            F.array(
                F.when(F.lag("__no").over(order).isNotNull(), F.struct(F.col("__no").alias("pair"), F.lit(True).alias("later"))),
                F.when(
                    F.lead("__no").over(order).isNotNull(),
                    F.struct(F.lead("__no").over(order).alias("pair"), F.lit(False).alias("later")),
                ),
            )
        ).alias("__sides"),
    )
    tagged = rows.join(numbers, "__no").select("*", F.inline("__sides"))
    version = F.struct("__at", "__fp")
    ids = [f"__k{i}" for i in range(len(keys))]
    sides = tagged.groupBy(*ids, "pair").agg(
        F.max(F.when(F.col("later"), version)).alias("new"), F.max(F.when(~F.col("later"), version)).alias("old")
    )
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.__fp") != F.col("new.__fp"), "changed")
    )
    return sides.select(
        *[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], F.col("pair").alias(snapshot), change.alias("change")
    ).where(F.col("change").isNotNull())


def refresh_changes(pages: DataFrame, baselines: DataFrame) -> DataFrame:
    """``tbl, k1, k2, snapshot_no, change`` of both refresh tables; see :func:`snapshot_changes`."""
    page = snapshot_changes(
        pages.select(F.col("plan_key").alias("k1"), F.col("url").alias("k2"), "snapshot_no", "delivered_at", "data"),
        ["k1", "k2"],
        fingerprint=page_fingerprint(F.col("data")),
    )
    baseline = snapshot_changes(
        baselines.select(F.col("scope_key").alias("k1"), F.lit("").alias("k2"), "snapshot_no", "delivered_at", "data"),
        ["k1", "k2"],
        fingerprint=baseline_fingerprint(F.col("data")),
    )
    return page.select(F.lit("pages").alias("tbl"), "*").unionByName(baseline.select(F.lit("baselines").alias("tbl"), "*"))
