"""Joins by normalised identifiers, as-of lookups, containment joins and rule selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.windows import carried_forward
from plumbline.session import broadcast_if_small


def normalized(value: Column) -> Column:
    """An identifier for comparison: trimmed, in lower case, missing as the empty string."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def match_identifiers(candidates: DataFrame, entities: DataFrame, identifiers: dict[str, str], entity_id: str) -> DataFrame:
    """Pairs of candidates and entities that agree in all of an entity's identifiers.

    ``identifiers`` maps columns of ``candidates`` to keys of the map column ``identifiers`` of ``entities``. Values
    are compared by :func:`normalized`; a key that the entity lacks (null, missing or blank) asks for nothing. An entity
    without any identifier asks for nothing at all and would match every candidate; such entities are returned by
    :func:`unidentified` instead of being expanded.

    Entities are grouped by the set of identifiers they have; one equality join for each set.
    """
    columns = list(identifiers)
    wanted = entities.select(entity_id, *[normalized(F.try_element_at("identifiers", F.lit(k))).alias(f"__e_{c}") for c, k in identifiers.items()])
    offered = candidates.select("*", *[normalized(F.col(c)).alias(f"__c_{c}") for c in columns])
    result = None
    for mask in range(1, 1 << len(columns)):
        used = [c for i, c in enumerate(columns) if mask >> i & 1]
        has = None
        for c in columns:
            test = (F.col(f"__e_{c}") != "") if c in used else (F.col(f"__e_{c}") == "")
            has = test if has is None else has & test
        side = wanted.where(has).select(entity_id, *[F.col(f"__e_{c}").alias(f"__c_{c}") for c in used])
        pairs = offered.join(side, [f"__c_{c}" for c in used]).select(*candidates.columns, entity_id)
        result = pairs if result is None else result.unionByName(pairs)
    return result


def unidentified(entities: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Entities that have none of the identifiers and so match everything."""
    empty = None
    for k in identifiers:
        test = normalized(F.try_element_at("identifiers", F.lit(k))) == ""
        empty = test if empty is None else empty & test
    return entities.where(empty)


def planned_gaps(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned combinations that were not done, each once."""
    return planned.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")


def last_before(df: DataFrame, key: str, time: str, good: Column, value: str, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """As-of lookup within one table: ``name`` is the ``value`` of the newest strictly earlier row of the same key that is
    ``good``; null if there is none. Rows of the same time don't see each other.

    Values are carried forward in the order of the times instead of a range join of the table with itself; null keys are one key.
    """
    stamp = F.struct(F.col(time), *[F.col(t) for t in tie], F.col(value))
    # The best good row of each moment, then the last one of an earlier moment.
    moments = df.groupBy(F.struct(F.col(key).alias("k")).alias("__k"), F.col(time).alias("__t")).agg(F.max(F.when(good, stamp)).alias("__b"))
    moments = carried_forward(moments, "__k", [F.col("__t")], "__b", "__last", before=True)
    cond = df[key].eqNullSafe(F.col("__k")["k"]) & df[time].eqNullSafe(F.col("__t"))
    return df.join(moments, cond, "left").select(*[df[c] for c in df.columns], F.col(f"__last.{value}").alias(name))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with ``values`` of the newest right row of its key at or before its time; null if there is none.

    Both sides are unioned, sorted once by key and time, and the last right row is carried forward: no pair of rows is
    formed, and a key with any number of rows is many tasks. Of right rows of one moment the greatest ``values`` stand. Null keys and times match nothing.
    """
    lefts = left.withColumns({"__t": F.col(time).cast("timestamp"), "__side": F.lit(1), "__r": F.lit(None).cast(_struct(right, values))})
    rights = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).groupBy(key, F.col(right_time).cast("timestamp").alias("__t")).agg(
        F.max(F.struct(*[F.col(v) for v in values])).alias("__r")
    )
    both = lefts.unionByName(rights.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    timed = both.where(F.col("__t").isNotNull())
    joined = carried_forward(timed, key, [F.col("__t"), F.col("__side")], "__r", "__last").where("__side = 1")
    untimed = lefts.where(F.col("__t").isNull()).withColumn("__last", F.lit(None).cast(_struct(right, values)))
    return joined.select(*left.columns, "__last").unionByName(untimed.select(*left.columns, "__last")).select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def _struct(df: DataFrame, values: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{v}`:{df.schema[v].dataType.simpleString()}" for v in values) + ">"


def containment_pairs(
    left: DataFrame, right: DataFrame, block: Sequence[str], a: str, b: str, least: int = 4, part: int = 6
) -> DataFrame:
    """Pairs within a block whose names are equal (``least`` characters or more) or of which the shorter, of ``part``
    characters or more, is contained in the longer. Columns of both sides must have different names but for ``block``.

    The containment is turned into an equality: the longer name offers every stretch of ``part`` characters in it, the
    shorter asks for one of its own, which by hash is the same for every name that holds it, and with digits if there is
    one. So only names with a telling stretch in common meet. Names are compared as given;
    normalise them first. Null names and null blocks match nothing.
    """
    pieces = F.lit(part)

    def stretches(name: str) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(name) - (part - 1))
        return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(name), i, pieces)))

    def offered(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.char_length(name) >= part).select("*", F.explode(stretches(name)).alias("__g"))

    def asked(df: DataFrame, name: str) -> DataFrame:
        ranked = F.transform(stretches(name), lambda g: F.struct((~g.rlike("[0-9]")).alias("p"), F.xxhash64(g).alias("h"), g.alias("g")))
        return df.where(F.char_length(name) >= part).withColumn("__g", F.array_min(ranked)["g"])

    within_b = asked(left, a).join(offered(right, b), [*block, "__g"]).where(F.contains(F.col(b), F.col(a)))
    within_a = offered(left, a).join(asked(right, b), [*block, "__g"]).where(F.contains(F.col(a), F.col(b)) & (F.col(a) != F.col(b)))
    short = [df.where(F.char_length(n).between(least, part - 1)).withColumn("__g", F.col(n)) for df, n in ((left, a), (right, b))]
    equal = short[0].join(short[1], [*block, "__g"])
    return within_b.unionByName(within_a).unionByName(equal).drop("__g")


def most_specific_rule(rows: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """Each row with the ``rule`` for its URL: an exact one, else the longest matching ``site:<host>/<glob>`` pattern.

    ``rules``: ``pattern, rule``. Patterns are joined on their host, so only rules of a row's own site are compared.
    ``*`` stands for any characters, ``?`` for one. Rows without a rule keep null. Of equal patterns the smallest rule
    stands.
    """
    rules = rules.groupBy("pattern").agg(F.min("rule").alias("rule"))
    exact = rules.where(~F.col("pattern").startswith("site:")).select(F.col("pattern").alias(url), F.col("rule").alias("__exact"))
    sites = rules.where(F.col("pattern").startswith("site:")).select(
        F.lower(F.regexp_extract("pattern", r"^site:([^/]+)", 1)).alias("__host"), F.col("pattern").alias("__p"), F.col("rule").alias("__r"),
        glob_regex(F.regexp_extract("pattern", r"^site:[^/]+/?(.*)$", 1)).alias("__re"),
    )
    urls = rows.select(url).where(F.col(url).isNotNull()).distinct()
    parted = urls.select(url, F.lower(F.parse_url(F.col(url), F.lit("HOST"))).alias("__host"), F.regexp_replace(F.col(url), r"^[a-zA-Z]+://[^/]+/?", "").alias("__path"))
    matched = parted.join(broadcast_if_small(sites, "__host"), "__host").where(F.expr("__path rlike __re")).groupBy(url).agg(
        F.max_by("__r", F.struct(F.char_length("__p"), F.col("__p"))).alias("__site")
    )
    return rows.join(broadcast_if_small(exact, url), url, "left").join(matched, url, "left").select(
        *[rows[c] for c in rows.columns], F.coalesce("__exact", "__site").alias("rule")
    )


def glob_regex(glob: Column) -> Column:
    """A regular expression for a glob: ``*`` any characters, ``?`` one, all others themselves."""
    quoted = F.regexp_replace(glob, r"([.\\+^$()\[\]{}|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit("$"))


def associate(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, details: str | None = None) -> DataFrame:
    """``left_id, right_id, link``: each left row with the one right row that its keys lead to.

    ``link`` is ``linked`` for exactly one candidate, ``ambiguous`` for several (``right_id`` is then null), ``unmatched`` for none.
    With ``details``, a map column of both sides, a candidate is excluded that states another value for a key of the left
    row's map; what one side doesn't state is no conflict. Ids are expected to be unique; a null key matches nothing.

    Candidates are counted, not collected, so a key of any size is one count.
    """
    right_side = right.select(*keys, F.col(right_id).alias("__rid"), *([F.col(details).alias("__rd")] if details else []))
    pairs = left.select(*keys, F.col(left_id).alias("__lid"), *([F.col(details).alias("__ld")] if details else [])).join(right_side, list(keys))
    if details:
        clash = F.exists(F.map_entries("__ld"), lambda e: F.try_element_at(F.col("__rd"), e["key"]) != e["value"])
        pairs = pairs.where(~F.coalesce(clash, F.lit(False)))
    found = pairs.groupBy("__lid").agg(F.min("__rid").alias("__one"), F.count("*").alias("__n"))
    n = F.coalesce("__n", F.lit(0))
    return left.join(found, left[left_id].eqNullSafe(found["__lid"]), "left").select(
        left[left_id],
        F.when(n == 1, F.col("__one")).alias(right_id),
        F.when(n == 1, "linked").when(n > 1, "ambiguous").otherwise("unmatched").alias("link"),
    )
