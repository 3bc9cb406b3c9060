"""Connected components and reachability as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: every node of ``edges`` with the smallest node of its component.

    Each round every node takes the smallest label among itself and its neighbours, then the label of that label
    (pointer jumping), so that long chains need a logarithmic number of rounds. Labels are written to the shared
    checkpoint folder after each round; the driver sees one count a round and never an edge. Self loops and repeated
    edges change nothing, edges with a null end are ignored.

    A node with very many neighbours is no single task: its labels are pre-aggregated where they arise.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    links = cut_lineage(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = links.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component"))
    labels = cut_lineage(labels)
    while True:
        offered = links.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(
            F.min("component").alias("near")
        )
        lower = labels.join(offered, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("far"))
        moved = cut_lineage(
            lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("component"), "old")
        )
        changed = moved.where(F.col("component") != F.col("old")).limit(1).count()
        labels = moved.select("node", "component")
        if not changed:
            return labels


def reachable(edges: DataFrame, roots: DataFrame, src: str, dst: str) -> DataFrame:
    """``node``: all nodes that can be reached from ``roots`` (one column ``node``) along edges, roots included.

    A frontier of new nodes is joined to the edges until it is empty, one round a hop, however many. Cycles end, dangling
    edges name their target.
    """
    links = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where(F.col("next").isNotNull()).distinct()
    seen = cut_lineage(roots.select("node").where(F.col("node").isNotNull()).distinct())
    frontier = seen
    while True:
        frontier = cut_lineage(
            links.join(frontier, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        )
        if not frontier.limit(1).count():
            return seen
        seen = cut_lineage(seen.unionByName(frontier))
