"""Coverage of runs and pages: statuses, gaps, attention, earlier runs, merged counters, refresh and reuse decisions, states from events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import broadcast_if_small


def newest_before(left: DataFrame, history: DataFrame, key: str, time: str, entry: str, most: int) -> DataFrame:
    """``left`` columns, ``entry``, ``place``: for each left row the up to ``most`` newest history rows of its key that started no later,
    ``place`` 1 for the newest. History rows of one moment are in the order of ``entry``, the greater one newer.

    Not a range join: history rows are numbered within their key, each left row learns how many started by its time from running
    counts of moments, and the two meet by equality of key and number. Null keys and times have no history.
    """
    of = Window.partitionBy(key)
    numbered = history.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, entry).withColumn("__no", F.row_number().over(of.orderBy(time, entry)))
    moments = numbered.groupBy(key, time).agg(F.max("__no").alias("__upto")).unionByName(
        left.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time).distinct().withColumn("__upto", F.lit(None).cast("int"))
    )
    upto = moments.groupBy(key, time).agg(F.max("__upto").alias("__upto")).withColumn(
        "__upto", F.last("__upto", True).over(of.orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    ).where("__upto IS NOT NULL")
    wanted = left.join(upto, [key, time]).select(*left.columns, F.posexplode(F.sequence(F.col("__upto"), F.greatest(F.lit(1), F.col("__upto") - (most - 1)))).alias("__p", "__no"))
    named = numbered.select(key, "__no", F.col(entry).alias("__entry"))
    return wanted.join(named, [key, "__no"]).select(*left.columns, F.col("__entry").alias(f"earlier_{entry}"), (F.col("__p") + 1).alias("place"))


def page_status(sections: Column, settled: Sequence[str], failing: Sequence[str]) -> Column:
    """One status for an array of section statuses: ``empty`` for none, ``failed`` if all fail, ``complete`` if all are settled, ``review`` if
    any fails, else ``partial``. Null statuses are neither."""
    known = F.coalesce(sections, F.array())
    fails = lambda s: F.coalesce(s.isin(list(failing)), F.lit(False))
    done = lambda s: F.coalesce(s.isin(list(settled)), F.lit(False))
    return (
        F.when(F.size(known) == 0, "empty").when(F.forall(known, fails), "failed").when(F.forall(known, done), "complete")
        .when(F.exists(known, fails), "review").otherwise("partial")
    )


def run_state(df: DataFrame, keys: Sequence[str], status: str, complete: Sequence[str], pausing: Sequence[str]) -> DataFrame:
    """``keys, state``: ``paused`` if any row has a pausing status, ``completed`` if all are complete, else ``partial``. A null is neither."""
    among = lambda names: F.coalesce(F.col(status).isin(list(names)), F.lit(False))
    return df.groupBy(*keys).agg(F.when(F.some(among(pausing)), "paused").when(F.every(among(complete)), "completed").otherwise("partial").alias("state"))


def locator_gaps(extracted: DataFrame, retained: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct extracted keys that are neither retained nor excluded; nulls equal nulls. One shuffle of flags, no join."""
    flag = lambda df, n: df.select(*keys, F.lit(n).alias("__f"))
    flags = flag(extracted, 0).unionAll(flag(retained, 1)).unionAll(flag(excluded, 1))
    return flags.groupBy(*keys).agg(F.min("__f").alias("__low"), F.max("__f").alias("__high")).where("__low = 0 AND __high = 0").select(*keys)


def gap_items(pages: DataFrame, observations: DataFrame, issues: DataFrame, key: str, status: str, good: Sequence[str], code: str) -> DataFrame:
    """``key, pages, failed, observed, issues, codes``: keys with failed pages, without observations or with issues. ``codes`` are the
    distinct issue codes, sorted, joined by ``; ``.

    Each side is counted by itself before they meet, so a key with a third of all rows is one row in the join.
    """
    bad = ~F.coalesce(F.col(status).isin(list(good)), F.lit(False))
    seen = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(bad).alias("failed"))
    rows = observations.groupBy(key).agg(F.count("*").alias("observed"))
    named = issues.groupBy(key, code).agg(F.count("*").alias("n")).groupBy(key).agg(
        F.sum("n").alias("issues"), F.array_join(F.array_sort(F.collect_set(code)), "; ").alias("codes")
    )
    joined = seen.join(rows, key, "left").join(named, key, "left").select(
        key, "pages", "failed", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("codes", F.lit("")).alias("codes")
    )
    return joined.where("failed > 0 OR observed = 0 OR issues > 0")


def attention(pages: DataFrame, issues: DataFrame, keys: Sequence[str], state: str, settled: Sequence[str]) -> DataFrame:
    """``pages`` with ``open_issues``, without those all of whose issues (by ``keys``) are settled. Pages without issues stay, with 0.

    A null key has no issues. Issues are pre-aggregated to one row a key.
    """
    closed = F.coalesce(F.col(state).isin(list(settled)), F.lit(False))
    per = issues.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(~closed).alias("__open"))
    return pages.join(per, list(keys), "left").where("__n IS NULL OR __open > 0").select(*pages.columns, F.coalesce("__open", F.lit(0)).alias("open_issues"))


def merge_counters(partial: DataFrame, keys: Sequence[str], counters: str, mode: str | None = None) -> DataFrame:
    """``keys, counters[, mode]``: maps of counts summed name by name over the rows of a key; ``mode`` is the one mode of all rows, or ``mixed``.

    Partial maps are exploded and summed where they are, and a final map has as many entries as there are names. A null map counts nothing;
    keys with only such maps have an empty one.
    """
    named = partial.select(*keys, F.explode_outer(counters).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))
    entries = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "n")))
    merged = named.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias(counters))
    if mode is None:
        return merged
    modes = partial.groupBy(*keys).agg(F.when(F.min(mode) == F.max(mode), F.min(mode)).otherwise("mixed").alias("mode"))
    left, right = merged.alias("l"), modes.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return left.join(right, same).select("l.*", "r.mode")


def counters_text(counters: Column) -> Column:
    """A map of counts as one text, ``name=count`` in the order of the names, joined by ``; ``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counters)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")


def refined_identity(previous: DataFrame, current: DataFrame, scope: Sequence[str], base: str, variant: str, name: str = "identity") -> tuple[DataFrame, DataFrame]:
    """Both lists with ``name``: the base identity where it is at most once on either list of a scope, else the base and the variant.

    So items that share a base are told apart by what varies, and an item whose variant alone changed is still the same one. A null base stays
    null, a null variant counts as empty. Only bases that repeat are sent to the join.
    """
    counts = lambda df: df.where(F.col(base).isNotNull()).groupBy(*scope, base).agg(F.count("*").alias("__n")).where("__n > 1")
    repeated = counts(previous).unionAll(counts(current)).select(*scope, base).distinct().withColumn("__several", F.lit(True))

    def named(df: DataFrame) -> DataFrame:
        full = F.concat(F.col(base), F.lit("|"), F.coalesce(F.col(variant).cast("string"), F.lit("")))
        return df.join(repeated, [*scope, base], "left").select(*df.columns, F.when(F.col("__several"), full).otherwise(F.col(base)).alias(name))

    return named(previous), named(current)


def refresh_reason(baseline_known: Column, rules: Column, wanted_rules: Column, valid: Column, last_full: Column, now: Column, days: int, manual: bool = False) -> Column:
    """Why a scope is collected in full, or ``scheduled_incremental``: the first that holds of a full run asked for, no baseline, other rules,
    a baseline that isn't valid, and an interval of ``days`` that has passed since the last full run (or an unknown last run)."""
    due = last_full + F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        F.when(F.lit(manual), "manual_full").when(~F.coalesce(baseline_known, F.lit(False)), "first_run").when(~rules.eqNullSafe(wanted_rules), "rules_changed")
        .when(~F.coalesce(valid, F.lit(False)), "no_valid_baseline").when(due.isNull() | (now >= due), "interval_elapsed").otherwise("scheduled_incremental")
    )


def reuse_decisions(current: DataFrame, saved: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """``current`` with ``decision``: ``reused`` if a saved row of the key agrees in all of ``same`` (nulls agree with nothing), ``changed`` if
    there is a saved row but none agrees, ``new`` without one. Several saved rows of a key are combined first."""
    body = lambda df: df.withColumn("__body", F.when(F.forall(F.array(*[F.col(c).isNotNull() for c in same]), lambda x: x), F.sha2(F.to_json(F.struct(*[F.col(c).cast("string") for c in same])), 256)))
    known = body(saved).groupBy(key, "__body").agg(F.lit(True).alias("__same"))
    keys = saved.groupBy(key).agg(F.lit(True).alias("__known"))
    judged = body(current).join(known, [key, "__body"], "left").join(keys, key, "left")
    return judged.select(*current.columns, F.when(F.col("__same"), "reused").when(F.col("__known"), "changed").otherwise("new").alias("decision"))


def event_states(events: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``key, values, events``: the state of each key after an append-only list of events: the ``values`` of its last one, and how many it had.

    One aggregation: nothing is sorted, a key with any number of events is one running maximum. Null keys are left out.
    """
    last = F.max(F.struct(*order, *[v for v in values if v not in order]))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("__last"), F.count("*").alias("events")).select(key, *[F.col(f"__last.{v}").alias(v) for v in values], "events")


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name`` looked up by ``key``; the key itself where there is none or a null. Of several names the smallest stands."""
    one = names.groupBy(key).agg(F.min(name).alias("__name"))
    return rows.join(broadcast_if_small(one, key), key, "left").select(*rows.columns, F.coalesce("__name", F.col(key).cast("string")).alias(name))


def retry_batches(retries: DataFrame, approved: DataFrame, url: str, position: str, size: int) -> DataFrame:
    """``url, position, batch``: wanted URLs that are approved, with their position (from 1) among all approved ones and the batch of ``size``
    positions in which they stand (from 0). Others are left out; see :func:`not_allowed`."""
    first = approved.groupBy(url).agg(F.min(position).alias(position))
    return retries.select(url).distinct().join(first, url).select(url, position, F.floor((F.col(position) - 1) / size).alias("batch"))


def not_allowed(asked: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct asked keys that aren't allowed; a subset check passes if there are none."""
    return asked.select(*keys).distinct().join(allowed.select(*keys).distinct(), list(keys), "left_anti")
