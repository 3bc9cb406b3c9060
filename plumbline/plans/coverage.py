"""Named queries of coverage, gaps, listings and decisions, each with its SQL. They join the other core queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.amounts import only_amount_column
from plumbline.functions.evidence import literal_price, proven_value
from plumbline.operators.coverage import (
    attention, counters_text, event_states, gap_items, locator_gaps, merge_counters, newest_before, not_allowed, page_status, refined_identity, refresh_reason,
    retry_batches, reuse_decisions, run_state, with_names,
)
from plumbline.operators.pairing import item_changes
from plumbline.operators.versions import latest_per_key
from plumbline.operators.windows import global_rank, page
from plumbline.plans.queries import query
from plumbline.sources.tables import table

_ONE = "one AS (SELECT DISTINCT ON (capture_id) * FROM captures ORDER BY capture_id, ingested_at DESC)"


def _one(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "captures", "capture_id", "ingested_at", *columns)
    return latest_per_key(rows, ["capture_id"], ["ingested_at"]).drop("ingested_at")


@query(
    f"""WITH {_ONE}, runs AS (SELECT source_id, CAST(date_trunc('day', fetched_at) AS TIMESTAMP) AS started, source_id || '@' || strftime(fetched_at, '%Y-%m-%d') AS run FROM one GROUP BY ALL),
    h AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started, run) AS no FROM runs)
    SELECT a.source_id, a.started, a.run, b.run AS earlier_run, CAST(a.no - b.no + 1 AS INTEGER) AS place FROM h a JOIN h b ON a.source_id = b.source_id AND b.no BETWEEN a.no - 2 AND a.no"""
)
def prior_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Each run (a source's captures of a day) with its three newest runs that started no later."""
    rows = _one(spark, folder, "source_id", "fetched_at").select("source_id", F.date_trunc("day", "fetched_at").cast("timestamp_ntz").alias("started"))
    runs = rows.distinct().withColumn("run", F.concat("source_id", F.lit("@"), F.date_format("started", "yyyy-MM-dd")))
    return newest_before(runs, runs, "source_id", "started", "run", 3)


_STATUS_SQL = """CASE WHEN len(s) = 0 THEN 'empty' WHEN len(list_filter(s, lambda x: x IN ('retry'))) = len(s) THEN 'failed' WHEN len(list_filter(s, lambda x: x IN ('settle', 'goto'))) = len(s) THEN 'complete'
    WHEN len(list_filter(s, lambda x: x IN ('retry'))) > 0 THEN 'review' ELSE 'partial' END"""


@query(
    f"""WITH {_ONE}, p AS (SELECT source_id, list_transform(coalesce(trace, []), lambda t: json_extract_string(t, '$.event')) AS s FROM one)
    SELECT source_id, {_STATUS_SQL} AS status, count(*) AS pages, CAST(sum(len(s)) AS BIGINT) AS sections FROM p GROUP BY ALL"""
)
def coverage_by_status(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and their sections (the steps of a trace) by the status that the sections give a page."""
    sections = F.transform(F.coalesce("trace", F.array()), lambda t: F.get_json_object(t, "$.event"))
    rows = _one(spark, folder, "source_id", "trace").select("source_id", sections.alias("s"))
    return rows.groupBy("source_id", page_status(F.col("s"), ["settle", "goto"], ["retry"]).alias("status")).agg(F.count("*").alias("pages"), F.sum(F.size("s")).cast("long").alias("sections"))


@query(
    f"""WITH {_ONE} SELECT source_id, CASE WHEN bool_or(status IN ('needs_auth')) THEN 'paused' WHEN bool_and(status IN ('fetched')) THEN 'completed' ELSE 'partial' END AS state
    FROM (SELECT source_id || '@' || strftime(fetched_at, '%Y-%m') AS source_id, coalesce(status, '') AS status FROM one) GROUP BY source_id"""
)
def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """State of each run, a source's captures of a month."""
    rows = _one(spark, folder, "source_id", "fetched_at", "status")
    return run_state(rows.select(F.concat("source_id", F.lit("@"), F.date_format("fetched_at", "yyyy-MM")).alias("source_id"), "status"), ["source_id"], "status", ["fetched"], ["needs_auth"])


@query(
    """SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.03"""
)
def missing_locators(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that were extracted, but neither retained (flag N) nor excluded (low discount)."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_discount")
    return locator_gaps(rows, rows.where("l_returnflag = 'N'"), rows.where("l_discount < 0.03"), ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH {_ONE}, s AS (SELECT source_id, count(*) AS pages, count(*) FILTER (coalesce(status, '') <> 'fetched') AS failed FROM one GROUP BY source_id),
    o AS (SELECT source_id, count(*) AS observed FROM catalog_rows WHERE price_type = 'quote' GROUP BY source_id),
    i AS (SELECT source_id, count(*) AS issues, array_to_string(list_sort(list(DISTINCT status)), '; ') AS codes FROM one WHERE status IN ('timeout', 'failed') GROUP BY source_id)
    SELECT source_id, pages, failed, coalesce(observed, 0) AS observed, coalesce(issues, 0) AS issues, coalesce(codes, '') AS codes
    FROM s LEFT JOIN o USING (source_id) LEFT JOIN i USING (source_id) WHERE failed > 0 OR observed IS NULL OR issues > 0"""
)
def gaps_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with failed pages, without observations or with issues."""
    pages = _one(spark, folder, "source_id", "status")
    rows = table(spark, folder, "catalog_rows", "source_id", "price_type").where("price_type = 'quote'")
    return gap_items(pages, rows, pages.where("status IN ('timeout', 'failed')"), "source_id", "status", ["fetched"], "status")


@query(
    f"""WITH {_ONE}, i AS (SELECT a.url, a.status AS category, CASE WHEN EXISTS (SELECT 1 FROM one b WHERE b.url = a.url AND b.status = 'fetched' AND b.fetched_at > a.fetched_at) THEN 'resolved' ELSE 'open' END AS state
      FROM one a WHERE status <> 'fetched'),
    per AS (SELECT url, category, count(*) FILTER (state <> 'resolved') AS open_issues FROM i GROUP BY url, category)
    SELECT p.capture_id, p.url, p.category, coalesce(open_issues, 0) AS open_issues FROM (SELECT capture_id, url, status AS category FROM one WHERE status <> 'fetched' OR source_id = 'src_007') p
    LEFT JOIN per USING (url, category) WHERE open_issues IS NULL OR open_issues > 0"""
)
def attention_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Captures that need attention: those all of whose issues of their URL and status were resolved by a later fetch are left out."""
    rows = _one(spark, folder, "source_id", "url", "status", "fetched_at")
    good = rows.where("status = 'fetched'").groupBy("url").agg(F.max("fetched_at").alias("__good"))
    issues = rows.where("status <> 'fetched'").join(good, "url", "left").select(
        "url", F.col("status").alias("category"), F.when(F.col("__good") > F.col("fetched_at"), "resolved").otherwise("open").alias("state")
    )
    pages = rows.where("status <> 'fetched' OR source_id = 'src_007'").select("capture_id", "url", F.col("status").alias("category"))
    return attention(pages, issues, ["url", "category"], "state", ["resolved", "ignored"])


@query(
    """WITH b AS (SELECT source, (doc_id // 500) AS batch, coalesce(lang, '?') AS name, count(*) AS n, CASE WHEN doc_id // 500 % 2 = 0 THEN 'full' ELSE 'incremental' END AS m FROM documents GROUP BY ALL),
    t AS (SELECT source, name, sum(n) AS n FROM b GROUP BY ALL),
    c AS (SELECT source, array_to_string(list(name || '=' || CAST(n AS BIGINT) ORDER BY name), '; ') AS counters FROM t GROUP BY source),
    m AS (SELECT source, CASE WHEN min(m) = max(m) THEN min(m) ELSE 'mixed' END AS mode FROM b GROUP BY source)
    SELECT source, counters, mode FROM c JOIN m USING (source)"""
)
def journal_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of batches (documents by language, each batch with its map and mode) merged to one map and mode for each source."""
    docs = table(spark, folder, "documents", "doc_id", "source", "lang").select("source", F.floor(F.col("doc_id") / 500).alias("batch"), F.coalesce("lang", F.lit("?")).alias("name"))
    counted = docs.groupBy("source", "batch", "name").agg(F.count("*").alias("n"))
    partial = counted.groupBy("source", "batch").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("counters"))
    partial = partial.withColumn("mode", F.when(F.col("batch") % 2 == 0, "full").otherwise("incremental"))
    return merge_counters(partial, ["source"], "counters", "mode").withColumn("counters", counters_text(F.col("counters")))


@query(
    """SELECT plan_key, snapshot_no, count(*) AS pages, CAST(sum(json_array_length(data, '$.candidates')) AS BIGINT) AS candidates,
    count(*) FILTER (json_extract_string(data, '$.http.sha256') IS NOT NULL) AS with_http,
    count(*) FILTER (json_extract_string(data, '$.candidates[0].fields.price') IS NOT NULL) AS priced FROM catalog_refresh_pages GROUP BY plan_key, snapshot_no"""
)
def observation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, candidates, pages with HTTP evidence and with a priced first candidate of each plan and snapshot, read from JSON paths."""
    rows = table(spark, folder, "catalog_refresh_pages", "plan_key", "snapshot_no", "data")
    at = lambda path: F.get_json_object("data", path)
    return rows.groupBy("plan_key", "snapshot_no").agg(
        F.count("*").alias("pages"), F.sum(F.json_array_length(at("$.candidates"))).cast("long").alias("candidates"), F.count_if(at("$.http.sha256").isNotNull()).alias("with_http"),
        F.count_if(at("$.candidates[0].fields.price").isNotNull()).alias("priced"),
    )


_REFINED = """rows AS (SELECT DISTINCT ON (row_id) source_id, model, unit, price, observed_at < TIMESTAMP '2026-06-01' AS before FROM catalog_rows ORDER BY row_id, ingested_at DESC),
    rep AS (SELECT DISTINCT source_id, model FROM (SELECT source_id, model, before FROM rows GROUP BY ALL HAVING count(*) > 1)),
    named AS (SELECT r.*, CASE WHEN rep.model IS NULL THEN r.model ELSE r.model || '|' || coalesce(unit, '') END AS identity FROM rows r LEFT JOIN rep USING (source_id, model))"""


@query(
    f"""WITH {_REFINED}, l AS (SELECT source_id, identity, coalesce(price, '~') AS body, before, count(*) AS n FROM named GROUP BY ALL),
    b AS (SELECT source_id, identity, body, coalesce(sum(n) FILTER (before), 0) AS o, coalesce(sum(n) FILTER (NOT before), 0) AS c FROM l GROUP BY ALL),
    u AS (SELECT *, sum(o) OVER w = 1 AND sum(c) OVER w = 1 AS u FROM b WINDOW w AS (PARTITION BY source_id, identity)),
    k AS (SELECT source_id, 'unchanged' AS status, least(o, c) AS n FROM u
      UNION ALL SELECT source_id, 'changed', 1 FROM u WHERE u AND o = 0 AND c = 1
      UNION ALL SELECT source_id, 'added', c - o FROM u WHERE NOT (u AND o = 0 AND c = 1) AND c > o
      UNION ALL SELECT source_id, 'unavailable', o - c FROM u WHERE NOT (u AND o = 1 AND c = 0) AND o > c)
    SELECT source_id, status, CAST(sum(n) AS BIGINT) AS n FROM k WHERE n > 0 GROUP BY ALL"""
)
def refined_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Item changes of each source where repeated models are told apart by their unit."""
    rows = latest_per_key(table(spark, folder, "catalog_rows", "row_id", "source_id", "model", "unit", "price", "observed_at", "ingested_at"), ["row_id"], ["ingested_at"])
    before = F.col("observed_at") < F.lit("2026-06-01").cast("timestamp_ntz")
    old, new = refined_identity(rows.where(before), rows.where(~before), ["source_id"], "model", "unit")
    changes = item_changes(old, new, ["source_id"], "identity", F.coalesce("price", F.lit("~")))
    return changes.groupBy("source_id", "status").agg(F.sum("n").alias("n"))


@query(
    """WITH b AS (SELECT DISTINCT ON (scope_key, snapshot_no) * FROM catalog_refresh_baselines ORDER BY scope_key, snapshot_no, delivered_at DESC, data DESC)
    SELECT scope_key, snapshot_no, CASE WHEN json_extract_string(data, '$.rules_version') IS DISTINCT FROM 'r5' THEN 'rules_changed' WHEN NOT coalesce(CAST(json_extract_string(data, '$.valid') AS BOOLEAN), false) THEN 'no_valid_baseline'
      WHEN TIMESTAMP '2026-04-01' >= CAST(left(json_extract_string(data, '$.last_full_at'), 19) AS TIMESTAMP) + INTERVAL 14 DAYS OR json_extract_string(data, '$.last_full_at') IS NULL THEN 'interval_elapsed'
      ELSE 'scheduled_incremental' END AS reason FROM b"""
)
def refresh_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Why each scope would be collected in full on the first of April, or that it is not."""
    rows = latest_per_key(table(spark, folder, "catalog_refresh_baselines"), ["scope_key", "snapshot_no"], ["delivered_at", "data"])
    at = lambda path: F.get_json_object("data", path)
    last = F.substring(at("$.last_full_at"), 1, 19).try_cast("timestamp_ntz")
    reason = refresh_reason(F.lit(True), at("$.rules_version"), F.lit("r5"), at("$.valid").try_cast("boolean"), last, F.lit("2026-04-01").cast("timestamp_ntz"), 14)
    return rows.select("scope_key", "snapshot_no", reason.alias("reason"))


@query(
    f"""WITH {_ONE}, c AS (SELECT capture_id, url, sha256(content) AS digest, media_type FROM one WHERE fetched_at >= TIMESTAMP '2026-06-01'),
    s AS (SELECT url, sha256(content) AS digest, media_type FROM one WHERE fetched_at < TIMESTAMP '2026-06-01')
    SELECT capture_id, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.url = c.url AND s.digest = c.digest AND s.media_type = c.media_type) THEN 'reused'
      WHEN EXISTS (SELECT 1 FROM s WHERE s.url = c.url) THEN 'changed' ELSE 'new' END AS decision FROM c"""
)
def conditional_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a later capture may reuse what was extracted from an earlier one of its URL."""
    rows = _one(spark, folder, "url", "fetched_at", "content", "media_type").select("capture_id", "url", "fetched_at", F.sha2("content", 256).alias("digest"), "media_type")
    cut = F.lit("2026-06-01").cast("timestamp_ntz")
    return reuse_decisions(rows.where(F.col("fetched_at") >= cut), rows.where(F.col("fetched_at") < cut), "url", ["digest", "media_type"]).select("capture_id", "decision")


@query(
    """SELECT user_id, event_type, event_id, n AS events FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND user_id IS NOT NULL"""
)
def latest_event_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each user after an append-only list of events."""
    return event_states(table(spark, folder, "events", "event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@query(
    """SELECT source_id, coalesce(name, source_id) AS name, kind, count(*) AS n FROM (SELECT source_id, currency AS kind FROM catalog_rows) LEFT JOIN (SELECT source_id, min(name) AS name FROM sources WHERE kind = 'web' GROUP BY source_id) USING (source_id) GROUP BY ALL"""
)
def named_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by the name of their source, its id where it has no name."""
    names = table(spark, folder, "sources", "source_id", "name", "kind").where("kind = 'web'")
    counted = table(spark, folder, "catalog_rows", "source_id", "currency").groupBy("source_id", F.col("currency").alias("kind")).agg(F.count("*").alias("n"))
    return with_names(counted, names, "source_id", "name").select("source_id", "name", "kind", "n")


@query(
    """WITH a AS (SELECT url, row_number() OVER (ORDER BY url) AS position FROM (SELECT DISTINCT url FROM captures WHERE status <> 'policy_denied'))
    SELECT url, position, CAST((position - 1) // 20 AS BIGINT) AS batch FROM a WHERE url IN (SELECT url FROM captures WHERE status IN ('timeout', 'failed'))"""
)
def retry_positions(spark: SparkSession, folder: str) -> DataFrame:
    """URLs to try again with their place and batch in the approved list."""
    rows = table(spark, folder, "captures", "url", "status")
    approved = global_rank(rows.where("status <> 'policy_denied'").select("url").distinct(), [F.col("url")], "position")
    return retry_batches(rows.where("status IN ('timeout', 'failed')"), approved, "url", "position", 20)


@query("SELECT DISTINCT url FROM captures WHERE status IN ('timeout', 'failed') AND url NOT IN (SELECT url FROM captures WHERE status = 'fetched')")
def retries_not_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """URLs to try again that were never fetched and so are in no approved list."""
    rows = table(spark, folder, "captures", "url", "status")
    return not_allowed(rows.where("status IN ('timeout', 'failed')"), rows.where("status = 'fetched'"), ["url"])


@query(
    f"""WITH {_ONE}, i AS (SELECT capture_id, source_id, status, fetched_at FROM one WHERE status <> 'fetched' AND starts_with(source_id, 'src_0'))
    SELECT capture_id, source_id, status, (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM i) > 60 AS has_more FROM i ORDER BY fetched_at DESC, capture_id LIMIT 50 OFFSET 10"""
)
def issues_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the issues of several runs, the newest first."""
    rows = _one(spark, folder, "source_id", "status", "fetched_at").where("status <> 'fetched'").where(F.col("source_id").startswith("src_0"))
    return page(rows, [F.desc("fetched_at"), F.col("capture_id")], offset=10, limit=50).select("capture_id", "source_id", "status", "total", "has_more")


@query(
    r"""SELECT row_id, ingested_at, CASE WHEN NOT regexp_matches(p, '\d') OR p IS NULL THEN 'no_amount' WHEN regexp_full_match(p, '(KRW|USD|EUR) \d+') THEN NULL END AS reason,
    CASE WHEN regexp_full_match(p, '(KRW|USD|EUR) \d+') THEN regexp_replace(substr(p, 5), '^0+(\d)', '\1') END AS value
    FROM (SELECT row_id, ingested_at, replace(currency || ' ' || price, ',', ';') AS p FROM catalog_rows) WHERE p IS NULL OR NOT regexp_matches(p, '\d') OR regexp_full_match(p, '(KRW|USD|EUR) \d+')"""
)
def plain_prices(spark: SparkSession, folder: str) -> DataFrame:
    """What the reader of free text says of prices that are a currency and plain digits, or hold no digit."""
    rows = table(spark, folder, "catalog_rows", "row_id", "ingested_at", "currency", "price").withColumn("p", F.concat("currency", F.lit(" "), F.translate("price", ",", ";")))
    rows = rows.where(F.col("p").isNull() | ~F.col("p").rlike(r"[0-9]") | F.col("p").rlike(r"^(KRW|USD|EUR) [0-9]+$"))
    return rows.select("row_id", "ingested_at", only_amount_column(F.col("p")).alias("a")).select("row_id", "ingested_at", "a.reason", "a.value")


@query(
    r"""WITH r AS (SELECT row_id, ingested_at, trim(price) AS p, trim(tax) AS t, decimal_separator FROM catalog_rows LEFT JOIN sources USING (source_id))
    SELECT row_id, ingested_at, CASE WHEN regexp_full_match(p, '(\d{1,3}(,\d{3})+|\d+)\s*원') THEN replace(regexp_extract(p, '^([\d,]+)', 1), ',', '') END AS price,
      CASE WHEN t = '부가세 포함' THEN 'included' END AS tax,
      CASE WHEN regexp_full_match(p, '(월\s*)?(₩\s*)?(\d{1,3}(,\d{3})+|\d+)\s*(원|KRW)?\s*(~|～|부터)?') THEN CASE WHEN regexp_matches(p, '(~|～|부터)$') THEN 'from' ELSE 'listed' END END AS kind FROM r"""
)
def proven_offers(spark: SparkSession, folder: str) -> DataFrame:
    """What the texts of catalog rows prove by declared rules, and how their prices are displayed."""
    rows = table(spark, folder, "catalog_rows", "row_id", "ingested_at", "price", "tax")
    rules = ("korean_won_amount", "korean_vat_included")
    proven = lambda field, rule, raw: proven_value(F.lit(field), F.lit(rule), F.col(raw), rules).alias(field)
    return rows.select("row_id", "ingested_at", proven("price", "korean_won_amount", "price"), proven("tax", "korean_vat_included", "tax"), literal_price(F.col("price"))["kind"].alias("kind"))
