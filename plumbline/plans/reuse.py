"""Work that need not be done again, stores without orphans, and checks of stored results against their sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import reachable
from plumbline.operators.sets import multiset_difference


def rule_key(*parts: Column) -> Column:
    """Key of a set of rules and the version of the code that applies them; null parts are empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def extract_changed(
    captures: DataFrame, cache: DataFrame, key: Column, digest: Column, extract: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Results of all captures, extracting only what the cache lacks: (results of the reused ones and the new ones, new only).

    ``cache`` has ``rule_key``, ``digest`` and the columns of ``extract``'s result, of which ``capture_id`` is dropped and
    taken from the captures instead. Captures with equal rules and content are extracted once; a capture whose content or
    rules changed is extracted again. A cached pair without results is known by a row with nulls.
    """
    marked = captures.withColumns({"rule_key": key, "digest": digest})
    wanted = marked.select("capture_id", "rule_key", "digest")
    work = marked.dropDuplicates(["rule_key", "digest"]).join(cache.select("rule_key", "digest").distinct(), ["rule_key", "digest"], "left_anti")
    made = extract(work).join(work.select("capture_id", "rule_key", "digest"), "capture_id", "right").drop("capture_id")
    known = cache.unionByName(made.select(*cache.columns))
    return wanted.join(known, ["rule_key", "digest"]), made


def orphans(stored: DataFrame, references: DataFrame, roots: DataFrame, node: str, size: str, at: str, before: Column) -> DataFrame:
    """Stored nodes that no root leads to and that are older than ``before``: ``node, size``.

    ``references``: ``src, dst``. Nothing is deleted; a caller decides. Nodes without a time are kept.
    """
    kept = reachable(references, roots, "src", "dst")
    old = stored.where(F.col(at) < before)
    return old.join(kept.withColumnRenamed("node", node), node, "left_anti").select(node, size)


def paired_counts(last: DataFrame, current: DataFrame, key: str, body: Column) -> DataFrame:
    """``same, changed, only_last, only_current``: keys of two results by whether their bodies agree (one row).

    Of several rows with a key their sorted bodies are compared as a whole. Null keys are one key.
    """
    def bodies(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(F.col(key).alias("k"), body.alias("b")).agg(F.count("*").alias("n"))
        # Order-free and of fixed size however many rows a key has: sums of the hashes of distinct bodies and their counts.
        return counted.groupBy("k").agg(F.sum(F.xxhash64("b", "n").cast("decimal(38,0)")).alias(name))

    both = bodies(last, "l").unionByName(bodies(current, "c"), allowMissingColumns=True)
    merged = both.groupBy("k").agg(F.max("l").alias("l"), F.max("c").alias("c"))
    return merged.agg(
        F.count_if(F.col("l") == F.col("c")).alias("same"),
        F.count_if(F.col("l") != F.col("c")).alias("changed"),
        F.count_if(F.col("c").isNull()).alias("only_last"),
        F.count_if(F.col("l").isNull()).alias("only_current"),
    )


def replay_problems(stored: DataFrame, again: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored rows that extracting their evidence again doesn't give, and rows it gives that aren't stored."""
    return multiset_difference(stored, again, columns).withColumn("problem", F.when(F.col("side") == "missing", "not reproduced").otherwise("not stored")).drop("side")
