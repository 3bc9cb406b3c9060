"""Item changes between two lists of items: equal items as a multiset, then the same item with other values.

Set-based: items equal in all their values are paired by their number among equals, the rest by an identity that must be
unique on both full lists. No order of rows matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The changes in the order in which they are listed.
SEVERITY = ("removed_candidate", "changed", "conditions_changed", "added", "unavailable", "baseline", "unchanged")


def item_changes(
    previous: DataFrame, current: DataFrame, scope: Sequence[str], identity: str, canonical: Column, *, name_only: Column | None = None,
    complete: Column | None = None, first: Column | None = None,
) -> DataFrame:
    """``scope, identity, n, before, after, status`` of the items of each scope (a page, say); ``n`` is how many equal items.

    ``canonical`` makes one text of all that counts in an item. Status: ``unchanged`` for items equal on both sides;
    ``changed`` for the same identity with other values (``conditions_changed`` if ``name_only``, a text of what may
    vary, is all that differs); what is left is ``added`` (``baseline`` where ``first`` holds: nothing was known of the
    scope) or, on the earlier side, ``removed_candidate`` where the inventory is ``complete`` and ``unavailable`` where
    it isn't. Identities are counted on the full lists; a null identity pairs with nothing.

    Equal items are aggregated to counts, so that a value repeated without end is one row with a count.
    """
    rest = name_only if name_only is not None else canonical
    keys = [*scope, "identity", "body", "rest"]

    def listed(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(*scope, F.col(identity).cast("string").alias("identity"), canonical.alias("body"), rest.alias("rest"))
        return rows.groupBy(*keys).agg(F.count("*").alias(side))

    sides = listed(previous, "old").unionByName(listed(current, "new"), allowMissingColumns=True)
    both = sides.groupBy(*keys).agg(F.coalesce(F.sum("old"), F.lit(0)).alias("old"), F.coalesce(F.sum("new"), F.lit(0)).alias("new"))
    same_id = Window.partitionBy(*scope, "identity")
    known = F.col("identity").isNotNull()
    counted = both.withColumns(
        {
            "unique": known & (F.sum("old").over(same_id) == 1) & (F.sum("new").over(same_id) == 1),
            "other_body": F.max(F.when(F.col("old") > F.col("new"), F.col("body"))).over(same_id),
            "other_rest": F.max(F.when(F.col("old") > F.col("new"), F.col("rest"))).over(same_id),
        }
    )
    flags = counted.withColumns(
        {
            "complete": F.coalesce(complete, F.lit(False)) if complete is not None else F.lit(False),
            "first": F.coalesce(first, F.lit(False)) if first is not None else F.lit(False),
        }
    )
    null = F.lit(None).cast("string")
    paired = F.col("unique") & (F.col("old") == 0) & (F.col("new") == 1)
    gone = F.greatest(F.col("old") - F.col("new"), F.lit(0))
    come = F.greatest(F.col("new") - F.col("old"), F.lit(0))

    def part(n: Column, before: Column, after: Column, status: Column) -> Column:
        return F.struct(n.cast("long").alias("n"), before.alias("before"), after.alias("after"), status.alias("status"))

    changed = F.when(F.col("rest") == F.col("other_rest"), "conditions_changed").otherwise("changed") if name_only is not None else F.lit("changed")
    parts = F.array(
        part(F.least("old", "new"), F.col("body"), F.col("body"), F.lit("unchanged")),
        part(F.when(paired, 1).otherwise(0), F.col("other_body"), F.col("body"), changed),
        part(F.when(paired, 0).otherwise(come), null, F.col("body"), F.when(F.col("first"), "baseline").otherwise("added")),
        part(
            F.when(F.col("unique") & (F.col("old") == 1) & (F.col("new") == 0), 0).otherwise(gone), F.col("body"), null,
            F.when(F.col("complete"), "removed_candidate").otherwise("unavailable"),
        ),
    )
    return flags.select(*scope, "identity", F.inline(parts)).where("n > 0")


def severity(status: Column) -> Column:
    """Place of a status in the listing order, from 1; after all others for an unknown one."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status)
    return F.when(at > 0, at).otherwise(len(SEVERITY) + 1)
