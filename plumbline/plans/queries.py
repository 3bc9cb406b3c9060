"""Named queries of the core: each takes a session and a table folder and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.amounts import only_amount_column, strict_amount
from plumbline.functions.hashing import canonical_map, stable_id
from plumbline.functions.media import bare_media_type
from plumbline.functions.terms import term_months
from plumbline.functions.text import comparable_column
from plumbline.functions.times import freshness
from plumbline.functions.units import UNITS, fold_spelling
from plumbline.functions.urls import host
from plumbline.operators.aggregates import conflicts, fixed_counts, listed_counts, state_rollup, summary_rows, top_and_rest, with_statistics
from plumbline.operators.conditions import classify, term_match
from plumbline.operators.graph import connected_components, reachable
from plumbline.operators.joins import asof_join, associate, containment_pairs, last_before, match_identifiers, most_specific_rule, planned_gaps
from plumbline.operators.measures import normalize_offers, same_offers
from plumbline.operators.pairing import SEVERITY, item_changes, severity
from plumbline.operators.sets import insert_if_absent, multiset_difference, union_with_provenance, upsert
from plumbline.operators.snapshots import refresh_changes
from plumbline.operators.versions import latest_per_key, newest_rows
from plumbline.operators.windows import batch_slices, deterministic_sample, occurrence_suffix, page, previous_value
from plumbline.session import broadcast_if_small, shared_folder
from plumbline.sources.pages import css_rows, generic_records, links, price_lines, repeated_cards, snapshots
from plumbline.sources.records import url_list
from plumbline.sources.sinks import content_store
from plumbline.sources.tables import stream_table, table
from plumbline.streaming.baselines import advance_baselines, current_baselines, run_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- units and snapshots


_NUM = r"\d[\d.,' \x{a0}\x{202f}]*"


def _sql_quantity(text: str, name: str) -> str:
    """SQL for the numbers and the unit of a quantity: ``<name>_n``, ``<name>_has``, ``<name>_u``."""
    pattern = rf"^\s*(?:({_NUM})\s*[xX×*]\s*)?({_NUM})?\s*(\D*?)\s*(?:[xX×*]\s*({_NUM}))?\s*$".replace("'", "''")
    part = lambda g: f"nullif(regexp_extract({text}, '{pattern}', {g}), '')"
    n = [f"CASE WHEN {part(g)} IS NULL THEN 1.0 ELSE {_sql_number(part(g))} END" for g in (1, 2, 4)]
    return f"{n[0]} * {n[1]} * {n[2]} AS {name}_n, {part(1)} IS NOT NULL OR {part(2)} IS NOT NULL AS {name}_has, nullif({part(3)}, '-') AS {name}_u"


def _sql_number(text: str) -> str:
    bare = f"regexp_replace({text}, '['' \\x{{a0}}\\x{{202f}}]', '', 'g')"
    return f"try_cast(CASE WHEN sep = ',' THEN replace(replace({bare}, '.', ''), ',', '.') ELSE replace({bare}, ',', '') END AS DOUBLE)"


_PRICE_SQL = rf"^\s*(?:KRW|USD|EUR|₩|\$|€)?\s*({_NUM})\s*(만\s?원|천\s?원|원|cents?|c|¢|USD|EUR|KRW|\$|€)?\s*((?:/|per\s).*)?$".replace("'", "''")
_UNIT_ROWS = ", ".join(f"('{a}', '{dim}', {size!r})" for dim, _, size, names in UNITS for a in dict.fromkeys(fold_spelling(x) for x in names))
# Exact spellings only: what the fuzzy mapping adds is tested by itself.
_P2_SQL = rf"""
    u(alias, dim, size) AS (SELECT DISTINCT * FROM (VALUES {_UNIT_ROWS})),
    sep AS (SELECT source_id, max(decimal_separator) AS sep FROM sources GROUP BY source_id),
    priced AS (SELECT *, coalesce(s.sep, '.') AS sep0, nullif(regexp_extract(price, '{_PRICE_SQL}', 3), '') AS stated,
      nullif(regexp_extract(price, '{_PRICE_SQL}', 1), '') AS figure, replace(regexp_extract(price, '{_PRICE_SQL}', 2), ' ', '') AS scale
      FROM catalog_rows LEFT JOIN sep s USING (source_id)),
    read AS (SELECT * REPLACE (sep0 AS sep), regexp_extract(coalesce(stated, price_basis), '^\s*(?:per\s+|/\s*)?(.*?)\s*당?\s*$', 1) AS basis FROM priced),
    parts AS (SELECT row_id, ingested_at, model, currency, {_sql_quantity("unit", "unit")}, {_sql_quantity("pack_quantity", "pack")}, {_sql_quantity("basis", "basis")},
      {_sql_number("figure")} * CASE WHEN scale = '천원' THEN 1e3 WHEN scale = '만원' THEN 1e4 WHEN scale IN ('cent', 'cents', 'c', '¢') THEN 0.01 ELSE 1.0 END AS amount FROM read),
    spelled AS (SELECT DISTINCT unnest([unit_u, pack_u, basis_u]) AS x FROM parts),
    names AS (SELECT x, dim, size FROM spelled JOIN u ON alias = CASE x WHEN '㎏' THEN 'kg' WHEN '㎖' THEN 'ml' WHEN '㎝' THEN 'cm' WHEN 'ℓ' THEN 'l' WHEN 'Pack' THEN 'pack' WHEN 'Each' THEN 'each' ELSE x END),
    joined AS (SELECT p.*, a.dim AS ad, a.size AS az, b.dim AS bd, b.size AS bz, c.dim AS cd, c.size AS cz FROM parts p
      LEFT JOIN names a ON p.unit_u = a.x LEFT JOIN names b ON p.pack_u = b.x LEFT JOIN names c ON p.basis_u = c.x),
    own AS (SELECT *, CASE WHEN ad NOT IN ('package', 'each') THEN ad END AS udim, CASE WHEN ad NOT IN ('package', 'each') THEN unit_n * az END AS usize FROM joined),
    held AS (SELECT *, CASE WHEN pack_u IS NULL THEN udim WHEN bd NOT IN ('package', 'each') THEN bd END AS dim,
      CASE WHEN pack_has THEN CASE WHEN pack_u IS NULL THEN pack_n * usize WHEN bd NOT IN ('package', 'each') THEN pack_n * bz END END AS held FROM own),
    bought AS (SELECT *, CASE WHEN cd = 'package' THEN held WHEN cd = 'each' AND udim = dim THEN usize WHEN cd = dim THEN basis_n * cz END AS buys FROM held),
    valued AS (SELECT row_id, ingested_at, model, currency, dim, held, CASE WHEN buys > 0 THEN amount / buys END AS up FROM bought),
    latest AS (SELECT DISTINCT ON (row_id) * FROM valued ORDER BY row_id, ingested_at DESC, held DESC NULLS LAST),
    offers AS (SELECT row_id, model, currency, CASE WHEN held > 0 AND up > 0 THEN dim END AS dimension, CASE WHEN held > 0 AND up > 0 THEN held END AS content,
      CASE WHEN held > 0 AND up > 0 THEN up END AS unit_price FROM latest)"""


@query(
    f"""WITH {_P2_SQL} SELECT least(a.row_id, b.row_id) AS row_id_a, greatest(a.row_id, b.row_id) AS row_id_b FROM offers a JOIN offers b
    ON a.model = b.model AND a.currency = b.currency AND a.dimension = b.dimension AND a.row_id < b.row_id
    WHERE abs(a.content - b.content) <= 0.001 * greatest(a.content, b.content) AND abs(a.unit_price - b.unit_price) <= 0.001 * greatest(a.unit_price, b.unit_price)"""
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_offers(normalize_offers(table(spark, folder, "catalog_rows"), table(spark, folder, "sources")))


@query(f"WITH {_P2_SQL} SELECT row_id, model, currency, dimension, round(content, 6) AS content, round(unit_price, 9) AS unit_price FROM offers")
def p2_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every catalog row with its content and price in common units."""
    offers = normalize_offers(table(spark, folder, "catalog_rows"), table(spark, folder, "sources"))
    return offers.withColumns({"content": F.round("content", 6), "unit_price": F.round("unit_price", 9)})


@query(
    """
    WITH raw AS (
      SELECT 'pages' AS tbl, plan_key AS k1, url AS k2, snapshot_no AS s, delivered_at AS sent, data FROM catalog_refresh_pages
      UNION ALL SELECT 'baselines', scope_key, '', snapshot_no, delivered_at, data FROM catalog_refresh_baselines),
    one AS (SELECT DISTINCT ON (tbl, k1, k2, s) * FROM raw ORDER BY tbl, k1, k2, s, sent DESC, data),
    cand AS (
      SELECT tbl, k1, k2, s, '' AS u, unnest(from_json(json_extract(data, '$.candidates'), '["JSON"]')) AS c FROM one WHERE tbl = 'pages'
      UNION ALL
      SELECT tbl, k1, k2, s, u, unnest(from_json(json_extract(p, '$.candidates'), '["JSON"]')) FROM (
        SELECT tbl, k1, k2, s, unnest(map_keys(m)) AS u, unnest(map_values(m)) AS p FROM (
          SELECT *, CAST(json_extract(data, '$.pages') AS MAP(VARCHAR, JSON)) AS m
          FROM one WHERE tbl = 'baselines'))),
    text AS (
      SELECT tbl, k1, k2, s, u,
        list_sort(list_transform(map_entries(CAST(json_extract(c, '$.fields') AS MAP(VARCHAR, JSON))), lambda e: e.key || '=' || CAST(e.value AS VARCHAR)))::VARCHAR || '#' ||
        list_sort(list_transform(map_entries(CAST(json_extract(c, '$.specs') AS MAP(VARCHAR, JSON))), lambda e: e.key || '=' || CAST(e.value AS VARCHAR)))::VARCHAR AS t
      FROM cand),
    bag AS (SELECT tbl, k1, k2, s, list_sort(list(u || '|' || t))::VARCHAR AS b FROM text GROUP BY ALL),
    urls AS (SELECT tbl, k1, k2, s, list_sort(json_keys(data, '$.pages'))::VARCHAR AS us FROM one WHERE tbl = 'baselines'),
    body AS (
      SELECT o.tbl, o.k1, o.k2, o.s, coalesce(b, '') || '~' || coalesce(us, '') || '~' ||
        CASE WHEN o.tbl = 'pages' THEN '' ELSE coalesce(json_extract(data, '$.rules_version')::VARCHAR, 'null') || coalesce(json_extract(data, '$.valid')::VARCHAR, 'null') END AS f
      FROM one o LEFT JOIN bag USING (tbl, k1, k2, s) LEFT JOIN urls USING (tbl, k1, k2, s)),
    pairs AS (SELECT tbl, s, lag(s) OVER (PARTITION BY tbl ORDER BY s) AS p FROM (SELECT DISTINCT tbl, s FROM body)),
    now AS (SELECT body.*, p FROM body JOIN pairs USING (tbl, s) WHERE p IS NOT NULL),
    before AS (SELECT body.tbl, k1, k2, pairs.s, f FROM body JOIN pairs ON body.tbl = pairs.tbl AND body.s = pairs.p)
    SELECT tbl, k1, k2, s AS snapshot_no, CASE WHEN before.f IS NULL THEN 'added' WHEN now.f IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM now FULL JOIN before USING (tbl, k1, k2, s) WHERE now.f IS DISTINCT FROM before.f
    """
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return refresh_changes(table(spark, folder, "catalog_refresh_pages"), table(spark, folder, "catalog_refresh_baselines"))


# ---------------------------------------------------------------- latest versions, statistics, conflicts, states


def _offers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_tax", "l_linestatus", "l_returnflag")
    return rows.select(
        F.concat_ws("|", F.col("l_tax").cast("decimal(4,2)").cast("string"), "l_linestatus").alias("comparison"),
        F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("shipped"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.col("l_returnflag").alias("flag"), "l_orderkey", "l_linenumber",
    )


_OFFERS = """offers AS (SELECT CAST(CAST(l_tax AS DECIMAL(4,2)) AS VARCHAR) || '|' || l_linestatus AS comparison, l_partkey AS product, l_suppkey AS source,
  l_shipdate AS shipped, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_returnflag AS flag, l_orderkey, l_linenumber FROM lineitem)"""


@query(
    f"""
    WITH {_OFFERS}, latest AS (
      SELECT * FROM offers WHERE flag <> 'R'
      QUALIFY row_number() OVER (PARTITION BY comparison, product, source ORDER BY shipped DESC, amount DESC, flag DESC, l_orderkey DESC, l_linenumber DESC) = 1)
    SELECT comparison, product, source, amount, count(*) OVER g AS n, min(amount) OVER g AS least, max(amount) OVER g AS most,
      CAST(median(CAST(amount AS DOUBLE)) OVER g AS DECIMAL(18,3)) AS middle
    FROM latest WINDOW g AS (PARTITION BY comparison, product)
    """
)
def price_comparison_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest offer of each source, with count, range and exact median of its group on every row."""
    offers = _offers(spark, folder).where("flag <> 'R'")
    latest = latest_per_key(offers, ["comparison", "product", "source"], ["shipped"])
    stated = with_statistics(latest.select("comparison", "product", "source", "amount"), ["comparison", "product"], "amount")
    return stated.withColumn("middle", F.col("middle").cast("decimal(18,3)"))


@query(
    f"""WITH {_OFFERS} SELECT comparison, product, count(*) AS n, count(DISTINCT amount) AS amounts FROM offers
    GROUP BY comparison, product HAVING count(DISTINCT amount) > 1"""
)
def price_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return conflicts(_offers(spark, folder), ["comparison", "product"], "amount")


@query(
    """SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'F' WHEN bool_and(o_orderstatus = 'O') THEN 'O' ELSE 'review' END AS state,
    array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') AS reasons FROM orders GROUP BY o_custkey"""
)
def task_state_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return state_rollup(table(spark, folder, "orders"), ["o_custkey"], "o_orderstatus", "o_orderpriority", "F", "O")


@query(
    """SELECT source_id, count(*) FILTER (status = 'fetched') AS fetched, count(*) FILTER (status = 'blocked') AS blocked,
    count(*) FILTER (status = 'needs_auth') AS needs_auth, count(*) FILTER (status = 'timeout') AS timeout, count(*) FILTER (status = 'failed') AS failed
    FROM captures GROUP BY source_id"""
)
def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of each source by status, a column for each of the fixed statuses."""
    return fixed_counts(table(spark, folder, "captures", "source_id", "status"), ["source_id"], "status", ["fetched", "blocked", "needs_auth", "timeout", "failed"])


@query(
    """SELECT 'captures' AS measure, CAST(count(*) AS VARCHAR) AS value FROM captures
    UNION ALL SELECT 'with content', CAST(count(*) FILTER (octet_length(content) > 0) AS VARCHAR) FROM captures
    UNION ALL SELECT 'variants', CAST(sum(len(variant_snapshots)) AS VARCHAR) FROM captures
    UNION ALL SELECT 'urls', CAST(count(DISTINCT url) AS VARCHAR) FROM captures"""
)
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary_rows(
        table(spark, folder, "captures", "url", "content", "variant_snapshots"),
        {
            "captures": F.count("*"),
            "with content": F.count_if(F.length("content") > 0),
            "variants": F.sum(F.when(F.col("variant_snapshots").isNotNull(), F.size("variant_snapshots"))),
            "urls": F.countDistinct("url"),
        },
    )


# ---------------------------------------------------------------- joins


@query(
    """SELECT s_suppkey, flag FROM (SELECT s_suppkey, unnest(['A', 'N', 'R']) AS flag FROM supplier)
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = flag AND l_quantity >= 49 AND l_discount >= 0.09)"""
)
def not_planned_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Planned pairs of supplier and flag without a large discounted delivery."""
    planned = table(spark, folder, "supplier", "s_suppkey").select("s_suppkey", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("flag"))
    done = table(spark, folder, "lineitem").where("l_quantity >= 49 AND l_discount >= 0.09").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("flag"))
    return planned_gaps(planned, done, ["s_suppkey", "flag"])


@query(
    """SELECT DISTINCT row_id, product_id FROM (SELECT row_id, lower(trim(split_part(model, '/', 1))) AS m FROM catalog_rows) c
    JOIN (SELECT product_id, lower(trim(identifiers['model'])) AS m FROM products) p ON c.m = p.m AND p.m <> ''"""
)
def identifier_match(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows and the products whose identifiers they agree with."""
    rows = table(spark, folder, "catalog_rows", "row_id", "model").select("row_id", F.substring_index("model", "/", 1).alias("model"))
    entities = table(spark, folder, "products", "product_id", "identifiers")
    return match_identifiers(rows, entities, {"model": "model"}, "product_id").select("row_id", "product_id").distinct()


_CAPTURES = """one AS (SELECT DISTINCT ON (capture_id) capture_id, url, status, fetched_at FROM captures ORDER BY capture_id, ingested_at DESC)"""


def _captures(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "captures", "capture_id", "url", "status", "fetched_at", "ingested_at")
    return latest_per_key(rows, ["capture_id"], ["ingested_at"]).drop("ingested_at")


@query(
    f"""WITH {_CAPTURES}, good AS (SELECT url, fetched_at, max(capture_id) AS last_good FROM one WHERE status = 'fetched' GROUP BY ALL)
    SELECT one.capture_id, last_good FROM one ASOF LEFT JOIN good ON one.url = good.url AND one.fetched_at > good.fetched_at"""
)
def last_good_capture(spark: SparkSession, folder: str) -> DataFrame:
    """For each capture the newest earlier one of its URL that was fetched."""
    rows = _captures(spark, folder)
    return last_before(rows, "url", "fetched_at", F.col("status") == "fetched", "capture_id", "last_good").select("capture_id", "last_good")


@query(
    """WITH v AS (SELECT user_id, ts, max(struct_pack(e := event_id, v := value)) AS m FROM events WHERE event_type = 'view' GROUP BY ALL)
    SELECT p.event_id, m.e AS view_id, m.v AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_last_view(spark: SparkSession, folder: str) -> DataFrame:
    """Each purchase with the user's last view at or before it."""
    events = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type", "value")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof_join(bought, views, "user_id", "ts", "ts", ["view_id", "view_value"]).select("event_id", "view_id", "view_value")


@query(
    """SELECT DISTINCT capture_id FROM captures a WHERE status = 'fetched'
    AND EXISTS (SELECT 1 FROM captures b WHERE b.source_id = a.source_id AND b.status = 'needs_auth')"""
)
def captures_behind_sign_in(spark: SparkSession, folder: str) -> DataFrame:
    """Fetched captures of sources that asked to sign in at another time (a semi join)."""
    rows = table(spark, folder, "captures", "capture_id", "source_id", "status")
    asked = rows.where("status = 'needs_auth'").select("source_id")
    return rows.where("status = 'fetched'").join(asked, "source_id", "left_semi").select("capture_id").distinct()


@query("""SELECT DISTINCT product_id FROM products p WHERE NOT EXISTS (SELECT 1 FROM catalog_rows c WHERE c.product_id = p.product_id)""")
def products_without_offers(spark: SparkSession, folder: str) -> DataFrame:
    products = table(spark, folder, "products", "product_id").distinct()
    return products.join(table(spark, folder, "catalog_rows", "product_id"), "product_id", "left_anti")


@query(
    """WITH p AS (SELECT DISTINCT product_id, identifiers['gtin'] AS g FROM products), n AS (SELECT g, count(*) AS n, min(product_id) AS one FROM p WHERE g <> '' GROUP BY g),
    l AS (SELECT DISTINCT name, identifiers['gtin'] AS g FROM products), one AS (SELECT name, min(g) AS g FROM l GROUP BY name)
    SELECT name, CASE WHEN n = 1 THEN n.one END AS product_id, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS link
    FROM one LEFT JOIN n USING (g)"""
)
def names_linked(spark: SparkSession, folder: str) -> DataFrame:
    """Each product name with the one product that its number leads to, if it is one."""
    gtin = F.nullif(F.try_element_at("identifiers", F.lit("gtin")), F.lit(""))
    products = table(spark, folder, "products", "product_id", "name", "identifiers")
    raw = F.try_element_at("identifiers", F.lit("gtin"))
    names = products.groupBy("name").agg(F.min(raw).alias("g")).withColumn("g", F.nullif("g", F.lit("")))
    return associate(names, products.select("product_id", gtin.alias("g")).distinct(), ["g"], "name", "product_id")


@query(
    """WITH p AS (SELECT DISTINCT p_type, p_brand, lower(p_name) AS n FROM part)
    SELECT DISTINCT a.p_type, a.n AS short_name, b.n AS long_name, a.p_brand AS short_brand, b.p_brand AS long_brand FROM p a JOIN p b ON a.p_type = b.p_type
    WHERE a.n <> b.n AND length(a.n) >= 6 AND contains(b.n, a.n)"""
)
def contained_names(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose whole name is a part of another's, within a type ("old anvil" in "cold anvil")."""
    names = table(spark, folder, "part", "p_type", "p_brand", "p_name").distinct()
    left = names.select("p_type", F.col("p_brand").alias("a_brand"), F.lower("p_name").alias("a_name"))
    right = names.select("p_type", F.col("p_brand").alias("b_brand"), F.lower("p_name").alias("b_name"))
    pairs = containment_pairs(left, right, ["p_type"], "a_name", "b_name").where("a_name <> b_name")
    a_short = F.char_length("a_name") < F.char_length("b_name")
    pick = lambda c: (F.when(a_short, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")), F.when(a_short, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")))
    names_of, brands = pick("name"), pick("brand")
    return pairs.select("p_type", names_of[0].alias("short_name"), names_of[1].alias("long_name"), brands[0].alias("short_brand"), brands[1].alias("long_brand")).distinct()


# Example rules, one exact and several patterns for sites.
RULES = [
    ("site:rent081.example/*", "rent"), ("site:rent081.example/p/00050*", "rent-05"), ("site:store022.example/p/*7", "seven"),
    ("site:store022.example/*", "store"), ("site:parts003.example/p/000000?", "first"), ("https://parts003.example/p/0000001", "exact"),
]


@query(
    "WITH r(pattern, rule) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for p, r in RULES) + """),
    u AS (SELECT DISTINCT url FROM captures),
    hit AS (SELECT url, rule, CASE WHEN pattern = url THEN 100000 ELSE length(pattern) END AS w FROM u LEFT JOIN r
      ON pattern = url OR (starts_with(pattern, 'site:') AND url GLOB ('https://' || substr(pattern, 6))))
    SELECT url, rule FROM hit QUALIFY row_number() OVER (PARTITION BY url ORDER BY w DESC) = 1"""
)
def rule_most_specific(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "captures", "url").distinct()
    return most_specific_rule(urls, spark.createDataFrame(RULES, "pattern string, rule string"), "url")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, 'p:' || product_id AS b FROM catalog_rows WHERE product_id IS NOT NULL
      UNION SELECT DISTINCT 'p:' || product_id, 'm:' || model FROM catalog_rows WHERE product_id IS NOT NULL),
    seen(node) AS (SELECT source_id FROM sources WHERE internal UNION SELECT b FROM e JOIN seen ON e.a = seen.node)
    SELECT node FROM seen"""
)
def reachable_from_internal(spark: SparkSession, folder: str) -> DataFrame:
    """What internal sources lead to: their products and those products' models."""
    rows = table(spark, folder, "catalog_rows", "source_id", "product_id", "model").where("product_id IS NOT NULL")
    product = F.concat(F.lit("p:"), "product_id")
    edges = rows.select(F.col("source_id").alias("src"), product.alias("dst")).unionByName(rows.select(product.alias("src"), F.concat(F.lit("m:"), "model").alias("dst")))
    roots = table(spark, folder, "sources").where("internal").select(F.col("source_id").alias("node"))
    return reachable(edges, roots, "src", "dst")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'p:' || product_id AS a, 'm:' || model AS b FROM catalog_rows WHERE product_id IS NOT NULL),
    l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), seen(node, start) AS (SELECT a, a FROM l UNION SELECT l.b, seen.start FROM seen JOIN l ON l.a = seen.node)
    SELECT node, min(start) AS component FROM seen GROUP BY node"""
)
def product_families(spark: SparkSession, folder: str) -> DataFrame:
    """Connected components of products and models."""
    rows = table(spark, folder, "catalog_rows", "product_id", "model").where("product_id IS NOT NULL").distinct()
    return connected_components(rows.select(F.concat(F.lit("p:"), "product_id").alias("a"), F.concat(F.lit("m:"), "model").alias("b")), "a", "b")


# ---------------------------------------------------------------- changes, sets and multisets

_SPLIT = "2026-06-01"


def _items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Column, Column]:
    rows = latest_per_key(
        table(spark, folder, "catalog_rows", "row_id", "source_id", "model", "price", "currency", "unit", "observed_at", "ingested_at"), ["row_id"], ["ingested_at"]
    )
    before = F.col("observed_at") < F.lit(_SPLIT).cast("timestamp_ntz")
    body = F.concat_ws("|", "model", F.coalesce("price", F.lit("~")), "currency", F.coalesce("unit", F.lit("~")))
    return rows.where(before), rows.where(~before), body, F.concat_ws("|", F.coalesce("price", F.lit("~")), "currency")


_ITEMS = f"""rows AS (SELECT DISTINCT ON (row_id) *, concat_ws('|', model, coalesce(price, '~'), currency, coalesce(unit, '~')) AS body,
    concat_ws('|', coalesce(price, '~'), currency) AS rest FROM catalog_rows ORDER BY row_id, ingested_at DESC),
  old AS (SELECT *, row_number() OVER (PARTITION BY source_id, body) AS k, count(*) OVER (PARTITION BY source_id, model) AS same FROM rows WHERE observed_at < TIMESTAMP '{_SPLIT}'),
  new AS (SELECT *, row_number() OVER (PARTITION BY source_id, body) AS k, count(*) OVER (PARTITION BY source_id, model) AS same FROM rows WHERE observed_at >= TIMESTAMP '{_SPLIT}'),
  equal AS (SELECT source_id, model, body AS before, body AS after, 'unchanged' AS status FROM old JOIN new USING (source_id, model, body, k)),
  o2 AS (SELECT old.* FROM old ANTI JOIN new USING (source_id, body, k)), n2 AS (SELECT new.* FROM new ANTI JOIN old USING (source_id, body, k)),
  moved AS (SELECT source_id, model, o2.body AS before, n2.body AS after, CASE WHEN o2.rest = n2.rest THEN 'conditions_changed' ELSE 'changed' END AS status
    FROM o2 JOIN n2 USING (source_id, model) WHERE o2.same = 1 AND n2.same = 1),
  items AS (SELECT * FROM equal UNION ALL SELECT * FROM moved
    UNION ALL SELECT source_id, model, NULL, body, 'added' FROM n2 ANTI JOIN (SELECT source_id, model FROM moved) m USING (source_id, model)
    UNION ALL SELECT source_id, model, body, NULL, 'unavailable' FROM o2 ANTI JOIN (SELECT source_id, model FROM moved) m USING (source_id, model))"""


@query(f"WITH {_ITEMS} SELECT source_id, model AS identity, before, after, status, count(*) AS n FROM items GROUP BY ALL")
def item_changes_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Item changes of each source's list between two halves of the year."""
    old, new, body, rest = _items(spark, folder)
    return item_changes(old, new, ["source_id"], "model", body, name_only=rest)


@query(
    f"""WITH {_ITEMS}, s(value, position) AS (VALUES {", ".join(f"('{s}', {i})" for i, s in enumerate(SEVERITY))})
    SELECT value, CAST(position AS INTEGER) AS position, CAST(count(items.status) AS BIGINT) AS n FROM s LEFT JOIN items ON status = value GROUP BY ALL"""
)
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of items by change, all changes listed."""
    changes = item_changes_by_source(spark, folder)
    per = changes.groupBy("status").agg(F.sum("n").alias("n"))
    listed = listed_counts(per.limit(0), "status", SEVERITY).drop("n")
    return listed.join(per.withColumnRenamed("status", "value"), "value", "left").select("value", "position", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH {_ITEMS}, r AS (SELECT source_id, model AS identity, status, count(*) AS n,
      CASE status {" ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(SEVERITY))} END AS rank FROM items GROUP BY source_id, model, before, after, status)
    SELECT source_id, identity, status, n, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 70 AS has_more FROM r
    ORDER BY rank, source_id, identity, n LIMIT 50 OFFSET 20"""
)
def changes_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of the change listing, gravest first."""
    rows = item_changes_by_source(spark, folder).select("source_id", "identity", "status", "n")
    return page(rows, [severity(F.col("status")), F.col("source_id"), F.col("identity"), F.col("n")], offset=20, limit=50)


@query(
    """WITH a AS (SELECT l_returnflag, l_quantity, l_discount, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
    b AS (SELECT l_returnflag, l_quantity, l_discount, count(*) AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY ALL)
    SELECT l_returnflag, l_quantity, l_discount, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'missing' ELSE 'extra' END AS side,
      CAST(abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS BIGINT) AS n
    FROM a FULL JOIN b USING (l_returnflag, l_quantity, l_discount) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""
)
def multiset_diff(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem", "l_linestatus", "l_returnflag", "l_quantity", "l_discount")
    return multiset_difference(rows.where("l_linestatus = 'F'"), rows.where("l_linestatus <> 'F'"), ["l_returnflag", "l_quantity", "l_discount"])


@query(
    """SELECT 'documents' AS origin, doc_id AS id, lang FROM documents UNION ALL SELECT 'eval_items', item_id, lang FROM eval_items"""
)
def union_provenance(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "lang")
    return union_with_provenance({"documents": docs, "eval_items": items})


@query(
    """WITH c AS (SELECT row_id, source_id, model, ingested_at FROM catalog_rows)
    SELECT row_id, source_id, model, ingested_at FROM c QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at DESC, source_id DESC, model DESC) = 1"""
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the first half upserted with those of the second; the newest delivery of each row stands."""
    rows = table(spark, folder, "catalog_rows", "row_id", "source_id", "model", "ingested_at")
    cut = F.lit(_SPLIT).cast("timestamp_ntz")
    return upsert(rows.where(F.col("ingested_at") < cut), rows.where(F.col("ingested_at") >= cut), ["row_id"], "ingested_at")


@query(
    f"""WITH a AS (SELECT url, count(*) AS n FROM captures WHERE fetched_at < TIMESTAMP '{_SPLIT}' GROUP BY url),
    b AS (SELECT url, min(fetched_at) AS seen FROM captures WHERE fetched_at >= TIMESTAMP '{_SPLIT}' GROUP BY url)
    SELECT url, seen FROM (SELECT url, min(fetched_at) AS seen FROM captures WHERE fetched_at < TIMESTAMP '{_SPLIT}' GROUP BY url)
    UNION ALL SELECT url, seen FROM b ANTI JOIN a USING (url)"""
)
def insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    """First sight of each URL: known ones stay, new ones are added."""
    rows = table(spark, folder, "captures", "url", "fetched_at").withColumnRenamed("fetched_at", "seen")
    cut = F.lit(_SPLIT).cast("timestamp_ntz")
    known = rows.where(F.col("seen") < cut).groupBy("url").agg(F.min("seen").alias("seen"))
    return insert_if_absent(known, rows.where(F.col("seen") >= cut), ["url"], ["seen"])


# ---------------------------------------------------------------- windows, samples, pages


@query(
    """SELECT row_id, ingested_at, CASE WHEN k = 1 THEN model ELSE model || '#' || k END AS item FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY row_id, ingested_at) AS k FROM catalog_rows)"""
)
def occurrence_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "catalog_rows", "row_id", "model", "ingested_at")
    return occurrence_suffix(rows, "model", [F.col("row_id"), F.col("ingested_at")], "item").select("row_id", "ingested_at", "item")


@query(
    f"""WITH {_CAPTURES} SELECT before, status, count(*) AS n FROM (
    SELECT status, lag(status) OVER (PARTITION BY url ORDER BY fetched_at, capture_id) AS before FROM one) GROUP BY ALL"""
)
def status_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """How often a URL's status followed another."""
    rows = previous_value(_captures(spark, folder), "url", [F.col("fetched_at"), F.col("capture_id")], "status", "before")
    return rows.groupBy("before", "status").agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT DISTINCT url FROM captures), r AS (SELECT url, sha256('plan-7' || chr(10) || url) AS sample_hash FROM u)
    SELECT url, sample_hash FROM r ORDER BY sample_hash, url LIMIT (SELECT greatest(5, ceil(0.05 * count(*))) FROM u)"""
)
def deterministic_sample_urls(spark: SparkSession, folder: str) -> DataFrame:
    return deterministic_sample(table(spark, folder, "captures", "url").distinct(), "url", "plan-7", 0.05)


@query(
    """SELECT CAST(floor((k - 1) / 500) AS BIGINT) AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) GROUP BY batch"""
)
def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in slices of 500 by id."""
    sliced = batch_slices(table(spark, folder, "documents", "doc_id"), [F.col("doc_id")], 500)
    return sliced.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(
    """SELECT doc_id, lang, n_chars, (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents) > 150 AS has_more
    FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100"""
)
def document_page(spark: SparkSession, folder: str) -> DataFrame:
    return page(table(spark, folder, "documents", "doc_id", "lang", "n_chars"), [F.col("doc_id")], offset=100, limit=50)


@query(
    """WITH h AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS key, count(*) AS n FROM captures GROUP BY 1),
    t AS (SELECT * FROM h ORDER BY n DESC, key LIMIT 10)
    SELECT key, n FROM t UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM h ANTI JOIN t USING (key) HAVING sum(n) IS NOT NULL"""
)
def host_counts_top(spark: SparkSession, folder: str) -> DataFrame:
    return top_and_rest(table(spark, folder, "captures", "url"), host(F.col("url")), 10)


@query(
    """SELECT row_number() OVER (ORDER BY capture_id, ingested_at) AS position, url AS entry, url,
    CASE WHEN row_number() OVER (PARTITION BY url ORDER BY capture_id, ingested_at) = 1 THEN 'accepted' ELSE 'duplicate' END AS status FROM captures"""
)
def url_list_status(spark: SparkSession, folder: str) -> DataFrame:
    """The captures' URLs as an imported list: accepted or repeated."""
    from plumbline.operators.windows import global_rank

    rows = table(spark, folder, "captures", "capture_id", "ingested_at", "url")
    ranked = global_rank(rows, [F.col("capture_id"), F.col("ingested_at")], "position")
    return url_list(ranked.select("position", "url"), "url").select("position", "entry", "url", "status")


@query("SELECT url, max(fetched_at) AS fetched_at FROM captures WHERE status = 'fetched' GROUP BY url")
def stream_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """The newest fetched capture of each URL, kept by a stream that takes the files of the table one batch after another."""
    place = shared_folder(spark, "stream")
    stream = stream_table(spark, folder, "captures")
    rows = stream.select("url", "fetched_at", "status")
    writer = advance_baselines(rows, f"{place}/table", f"{place}/progress", ["url"], "fetched_at", F.col("status") == "fetched")
    return run_available(writer, lambda: current_baselines(spark, f"{place}/table")).select("url", "fetched_at")


# ---------------------------------------------------------------- JSON, text and scalar functions


@query(
    """SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
    FROM events GROUP BY ALL"""
)
def json_property_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.groupBy(k.alias("k"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


@query(
    """SELECT json_extract_string(t, '$.event') AS event, count(*) AS n, CAST(sum(CAST(json_extract_string(t, '$.n') AS BIGINT)) AS BIGINT) AS total
    FROM (SELECT unnest(trace) AS t FROM captures) GROUP BY ALL"""
)
def trace_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all traces with their sums."""
    events = table(spark, folder, "captures", "trace").select(F.explode("trace").alias("t")).select(F.from_json("t", "event string, n bigint").alias("t"))
    return events.groupBy("t.event").agg(F.count("*").alias("n"), F.sum("t.n").alias("total"))


@query(
    """SELECT doc_id FROM documents WHERE (contains(lower(coalesce(text, '')), 'contract') OR contains(lower(coalesce(text, '')), 'vertrag') OR contains(lower(coalesce(text, '')), '계약'))
    AND NOT contains(lower(coalesce(text, '')), 'pallet')"""
)
def term_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.where(term_match(F.lower("text"), ["contract", "vertrag", "계약"], ["pallet"])).select("doc_id")


# Classes of gaps by words, in the order in which they are tried.
GAPS = [
    ("policy", ["policy_denied", "robots"]), ("sign_in", ["needs_auth", "login"]), ("handoff", ["blocked", "captcha"]),
    ("environment", ["tool_unavailable"]), ("transient", ["timeout", "failed", "429"]),
]


@query(
    "SELECT gap, source_id, count(*) AS n FROM (SELECT source_id, CASE "
    + " ".join(f"WHEN {' OR '.join(f'''contains(status, '{w}')''' for w in words)} THEN '{label}'" for label, words in GAPS)
    + " ELSE 'none' END AS gap FROM captures) GROUP BY ALL"
)
def gap_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "captures", "source_id", "status")
    return rows.groupBy(classify(F.col("status"), GAPS, "none").alias("gap"), "source_id").agg(F.count("*").alias("n"))


@query(
    r"""WITH t AS (SELECT row_id, ingested_at, decimal_separator AS sep,
      regexp_replace(trim(price), '^([A-Z]{3}\s+|[$₩€£¥]\s*)|\s*([A-Z]{3}|원)$', '', 'g') AS b FROM catalog_rows LEFT JOIN sources USING (source_id))
    SELECT row_id, ingested_at, CAST(CASE
      WHEN sep = '.' AND regexp_full_match(b, '(\d+|\d{1,3}(,\d{3})+)(\.\d+)?') THEN try_cast(replace(b, ',', '') AS DECIMAL(38,10))
      WHEN sep = ',' AND regexp_full_match(b, '(\d+|\d{1,3}(\.\d{3})+)(,\d+)?') THEN try_cast(replace(replace(b, '.', ''), ',', '.') AS DECIMAL(38,10)) END AS DOUBLE) AS amount
    FROM t"""
)
def strict_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Prices that are one plain amount in their source's number format."""
    rows = table(spark, folder, "catalog_rows", "row_id", "ingested_at", "source_id", "price")
    formats = broadcast_if_small(table(spark, folder, "sources", "source_id", "decimal_separator"), "source_id")
    return rows.join(formats, "source_id", "left").select("row_id", "ingested_at", strict_amount(F.col("price"), F.col("decimal_separator")).cast("double").alias("amount"))


@query()
def only_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """The one amount each document shows, or why there is none."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", only_amount_column(F.col("text")).alias("a")).select("doc_id", "a.value", "a.reason")


@query(
    r"""WITH d AS (SELECT doc_id, text,
      list_transform(regexp_extract_all(text, '(^|[^\d~∼〜–-])(\d{1,3})\s?-?(개월|months?\b|mois\b|Monate?n?\b|か月|ヶ月)', 2), lambda x: CAST(x AS INTEGER)) AS m,
      list_transform(regexp_extract_all(text, '(^|[^\d~∼〜–-])(\d{1,2})\s?-?(년|years?\b|ans?\b|Jahre?n?\b|年間)', 2), lambda x: CAST(x AS INTEGER) * 12) AS y FROM documents)
    SELECT doc_id, CASE WHEN NOT regexp_matches(text, '\d\s?[~∼〜–-]\s?\d{1,3}\s?(개월|months?\b|mois\b|Monate?n?\b|か月|ヶ月|년|years?\b|ans?\b|Jahre?n?\b|年間)')
      AND len(list_distinct(list_concat(m, y))) = 1 THEN list_distinct(list_concat(m, y))[1] END AS months FROM d"""
)
def document_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The contract term of each document that names one."""
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", term_months(F.col("text")).alias("months"))


@query()
def comparable_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "products", "product_id", "name")
    return names.withColumn("comparable", comparable_column(F.col("name")))


@query(
    """SELECT doc_id, CASE WHEN source IS NULL THEN NULL ELSE substr(sha256('["' || source || '", "' || doc_id || '", ' || coalesce('"' || product_id || '"', 'null') || ']'), 1, 24) END AS id FROM documents"""
)
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "product_id")
    made = stable_id(F.col("source"), F.col("doc_id"), F.col("product_id"))
    return docs.select("doc_id", F.when(F.col("source").isNotNull(), made).alias("id"))


@query(
    """SELECT product_id, '{' || array_to_string(list_sort(list_transform(map_entries(identifiers),
    lambda e: '"' || e.key || '":' || coalesce('"' || replace(replace(e.value, '\\', '\\\\'), '"', '\\"') || '"', 'null'))), ',') || '}' AS identifiers FROM products""".replace("\\\\", "\\")
)
def canonical_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "products", "product_id", "identifiers").select("product_id", canonical_map(F.col("identifiers")).alias("identifiers"))


@query(
    """SELECT source_id, CASE WHEN fetched_at > TIMESTAMP '2026-08-01' + INTERVAL 5 MINUTES THEN 'unknown'
      WHEN fetched_at < TIMESTAMP '2026-08-01' - INTERVAL 720 HOURS THEN 'stale' ELSE 'observed' END AS freshness, count(*) AS n FROM captures GROUP BY ALL"""
)
def freshness_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "captures", "source_id", "fetched_at")
    now = F.lit("2026-08-01").cast("timestamp_ntz")
    return rows.groupBy("source_id", freshness(F.col("fetched_at"), now, F.lit(720)).alias("freshness")).agg(F.count("*").alias("n"))


@query("""SELECT nullif(lower(trim(split_part(media_type, ';', 1))), '') AS kind, count(*) AS n FROM captures GROUP BY ALL""")
def media_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "captures", "media_type").groupBy(bare_media_type(F.col("media_type")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """SELECT source_id, field, count(*) AS n FROM (UNPIVOT (SELECT source_id, unit, tax, price_type, price_basis FROM catalog_rows)
    ON unit, tax, price_type, price_basis INTO NAME field VALUE v) WHERE v <> '' GROUP BY ALL"""
)
def stated_fields(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source states each of four fields (an unpivot)."""
    rows = table(spark, folder, "catalog_rows", "source_id", "unit", "tax", "price_type", "price_basis")
    long = rows.unpivot("source_id", ["unit", "tax", "price_type", "price_basis"], "field", "v")
    return long.where("v <> ''").groupBy("source_id", "field").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- captures: snapshots, stores and page scans


@query(
    """WITH s AS (SELECT capture_id, 0 AS snapshot_no, content AS c FROM captures UNION ALL
      SELECT capture_id, CAST(generate_subscripts(variant_snapshots, 1) AS INTEGER), unnest(variant_snapshots).content FROM captures)
    SELECT capture_id, snapshot_no, sha256(c) AS digest, count(*) AS deliveries FROM s WHERE octet_length(c) > 0 GROUP BY ALL"""
)
def capture_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Every state of every captured page with its digest, and how often it was delivered."""
    states = snapshots(table(spark, folder, "captures", "capture_id", "url", "content", "media_type", "variant_snapshots"))
    return states.groupBy("capture_id", "snapshot_no", F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("deliveries"))


@query("""SELECT sha256(content) AS digest, octet_length(content) AS size FROM captures WHERE content IS NOT NULL GROUP BY ALL""".replace("octet_length(content)", "CAST(octet_length(content) AS INTEGER)"))
def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct contents of all captures, as a store keeps them."""
    return content_store(table(spark, folder, "captures", "content"), "content").select("digest", "size")


@query("""SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL""")
def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def _page_states(spark: SparkSession, folder: str) -> DataFrame:
    """Every state of every captured page in its latest delivery, as the page scans read them."""
    rows = table(spark, folder, "captures", "capture_id", "url", "content", "media_type", "variant_snapshots", "ingested_at")
    return snapshots(newest_rows(rows, "capture_id", "ingested_at"))


@query()
def page_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The displayed price of every state of a page that marks one, by a CSS rule."""
    return css_rows(_page_states(spark, folder), "main, div", {"price": "> span.price", "title": "> h1"}).where("fields['price'] IS NOT NULL")


@query()
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    return links(_page_states(spark, folder))


@query()
def page_price_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled amounts of states of pages that list several."""
    return price_lines(_page_states(spark, folder))


@query()
def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of every state of every page by the generic chain of scans."""
    return generic_records(_page_states(spark, folder))


@query()
def page_cards(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_cards(_page_states(spark, folder))
