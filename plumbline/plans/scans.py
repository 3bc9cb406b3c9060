"""Named queries of the scans: pages and files are made of whole tables, scanned, and compared with the tables they were made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.queries import _page_states, query
from plumbline.session import shared_folder
from plumbline.sources.pages import (
    by_adapter, css_rows, embedded_records, frontier, generic_records, json_ld, links, microdata, pagination_links, pattern_rows, platform_cards, repeated_cards, table_cells,
)
from plumbline.sources.records import read_csv, read_json, read_xlsx
from plumbline.sources.sinks import workbook
from plumbline.sources.tables import table


def _pages(rows: DataFrame, key: Column, body: Column, url: Column | None = None) -> DataFrame:
    """Rows as captured pages: ``capture_id, url, content, media_type``."""
    return rows.select(
        key.cast("string").alias("capture_id"), (url if url is not None else F.concat(F.lit("https://made.example/p/"), key.cast("string"))).alias("url"),
        F.encode(body, "utf-8").alias("content"), F.lit("text/html; charset=utf-8").alias("media_type"),
    )


def _quoted(text: Column) -> Column:
    """Text as it stands in HTML."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], text)


_ROWS = "(SELECT row_id, max(model) AS model, max(price) AS price, max(currency) AS currency FROM catalog_rows GROUP BY row_id)"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "catalog_rows", "row_id", "model", "price", "currency")
    return rows.groupBy("row_id").agg(F.max("model").alias("model"), F.max("price").alias("price"), F.max("currency").alias("currency"))


@query(f"""SELECT CAST(row_id AS VARCHAR) AS capture_id, trim(model) AS name, nullif(trim(price), '') AS price, currency FROM {_ROWS}""")
def scan_json_ld(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows as products with offers in JSON-LD."""
    offer = F.struct(F.lit("Offer").alias("@type"), F.col("price"), F.col("currency").alias("priceCurrency"))
    product = F.to_json(F.struct(F.array(F.struct(F.lit("Product").alias("@type"), F.col("model").alias("name"), F.array(offer).alias("offers"))).alias("@graph")))
    pages = _pages(_rows(spark, folder), F.col("row_id"), F.concat(F.lit('<html><script type="application/ld+json">'), product, F.lit("</script></html>")))
    return json_ld(pages).select("capture_id", "name", "price", "currency")


@query(f"""SELECT CAST(row_id AS VARCHAR) AS capture_id, model AS name, price, currency FROM {_ROWS} WHERE trim(price) <> ''""")
def scan_microdata(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows as items in microdata; the generic chain takes those with a price."""
    item = F.format_string(
        '<div itemscope itemtype="https://schema.org/Offer"><span itemprop="name">%s</span><meta itemprop="price" content="%s"><meta itemprop="priceCurrency" content="%s"></div>',
        _quoted(F.col("model")), _quoted(F.coalesce("price", F.lit(""))), F.col("currency"),
    )
    found = microdata(_pages(_rows(spark, folder), F.col("row_id"), item)).select("capture_id", *[F.try_element_at("properties", F.lit(k)).alias(n) for k, n in (("name", "name"), ("price", "price"), ("priceCurrency", "currency"))])
    return found.where(F.trim("price") != "")


@query(f"""SELECT CAST(row_id AS VARCHAR) AS capture_id, trim(model) AS name, trim(price) AS value FROM {_ROWS} WHERE trim(price) <> ''""")
def scan_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog rows deep in the JSON of a script."""
    data = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("model").alias("Name"), F.struct(F.col("price").alias("value")).alias("PRICE"))).alias("items")).alias("props")))
    return embedded_records(_pages(_rows(spark, folder), F.col("row_id"), F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>")))).select("capture_id", "name", "value")


@query(
    """SELECT CAST(r_regionkey AS VARCHAR) AS capture_id, n_name AS label, 'key' AS header, CAST(n_nationkey AS VARCHAR) AS cell FROM region JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT CAST(r_regionkey AS VARCHAR), n_name, 'region', r_name FROM region JOIN nation ON n_regionkey = r_regionkey"""
)
def scan_table_cells(spark: SparkSession, folder: str) -> DataFrame:
    """A table of nations on the page of each region; the region is one cell that spans all rows."""
    nations = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    lists = nations.groupBy("r_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("ns"))
    lines = F.transform("ns", lambda n, i: F.concat(F.lit("<tr><td>"), n["n_name"], F.lit("</td><td>"), n["n_nationkey"].cast("string"), F.lit("</td>"), F.when(i == 0, F.concat(F.lit("<td rowspan="), F.size("ns").cast("string"), F.lit(">"), F.col("r_name"), F.lit("</td>"))).otherwise(""), F.lit("</tr>")))
    body = F.concat(F.lit("<table><tr><th>nation</th><th>key</th><th>region</th></tr>"), F.array_join(lines, ""), F.lit("</table>"))
    return table_cells(_pages(lists, F.col("r_regionkey"), body)).select("capture_id", "label", "header", "cell")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS capture_id, 'https://made.example/list?page=' || (s_suppkey + 1) AS link FROM supplier
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'https://made.example/list?page=' || (s_suppkey + 2) FROM supplier""")
def scan_pagination(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a link to the next one, a pager with a figure, and a link that is none of a pager."""
    k = F.col("s_suppkey")
    body = F.concat(F.lit('<a href="?page='), (k + 1).cast("string"), F.lit('">Next</a><div class="pager"><a href="/list?page='), (k + 2).cast("string"), F.lit('">'), (k + 2).cast("string"), F.lit('</a></div><a href="/other">Other</a>'))
    pages = _pages(table(spark, folder, "supplier", "s_suppkey"), k, body, F.lit("https://made.example/list"))
    return pagination_links(pages).select("capture_id", "link")


@query(
    """WITH u AS (SELECT source_id, url, min(CASE WHEN status = 'fetched' THEN 1 ELSE 2 END) AS rank FROM captures GROUP BY ALL)
    SELECT source_id, url, k AS place, n > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank, url) AS k, count(*) OVER (PARTITION BY source_id) AS n FROM u) WHERE k <= 20"""
)
def frontier_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """For each source the twenty URLs to visit first, and whether there are more."""
    urls = table(spark, folder, "captures", "source_id", "url", "status").groupBy("source_id", "url").agg(F.min(F.when(F.col("status") == "fetched", 1).otherwise(2)).alias("rank"))
    return frontier(urls, "rank", "url", "source_id", 20).select("source_id", "url", "place", "truncated")


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''),
    m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Z]{3}-[0-9]{5}')) AS code FROM l WHERE regexp_matches(line, '[A-Z]{3}-[0-9]{5}'))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, code FROM m"""
)
def scan_pattern_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All product codes of all documents with their lines."""
    found = pattern_rows(table(spark, folder, "documents", "doc_id", "text"), "text", r"(?P<code>[A-Z]{3}-[0-9]{5})", ("doc_id",))
    return found.where("fields IS NOT NULL").select("doc_id", "line_no", F.try_element_at("fields", F.lit("code")).alias("code"))


@query(f"""SELECT CASE WHEN row_id % 2 = 0 THEN 'json_ld' ELSE 'embedded' END AS adapter, currency, count(*) AS n FROM {_ROWS} WHERE trim(price) <> '' GROUP BY ALL""")
def scan_by_adapter(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of two hosts, each read by the adapter of its host."""
    rows = _rows(spark, folder).where(F.trim("price") != "")
    data = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("model").alias("name"), F.struct("price", F.col("currency").alias("priceCurrency")).alias("offers")))
    deep = F.to_json(F.struct(F.col("currency").alias("name"), F.col("price")))
    even = F.col("row_id") % 2 == 0
    body = F.when(even, F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))).otherwise(F.concat(F.lit('<script type="application/json">'), deep, F.lit("</script>")))
    pages = _pages(rows, F.col("row_id"), body, F.concat(F.lit("https://"), F.when(even, "even").otherwise("odd"), F.lit(".example/p")))
    found = by_adapter(pages, {"even.example": "json_ld", "odd.example": "embedded"}, "generic")
    both = found["json_ld"].select(F.lit("json_ld").alias("adapter"), "currency").unionByName(found["embedded"].select(F.lit("embedded").alias("adapter"), F.col("name").alias("currency")))
    return both.groupBy("adapter", "currency").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT product_id, max(name) AS name FROM products GROUP BY product_id)
    SELECT product_id, 'cards' AS method, CAST(k AS INTEGER) AS position, CAST(1000 * k AS VARCHAR) AS amount FROM p, (SELECT unnest([1, 2, 3]) AS k)"""
)
def scan_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with three cards each of which shows a former and a current price; the current one is the record's."""
    products = table(spark, folder, "products", "product_id", "name").groupBy("product_id").agg(F.max("name").alias("name"))
    card = lambda k: F.concat(F.lit(f'<li class="item"><a href="/p/{k}">'), F.lit("Item "), F.lit(str(k)), F.lit(f"</a><del>{2000 * k:,}원</del> <b>{1000 * k:,}원</b></li>"))
    body = F.concat(F.lit("<ul>"), *[card(k) for k in (1, 2, 3)], F.lit("</ul>"))
    found = generic_records(_pages(products, F.col("product_id"), body))
    return found.select(F.col("capture_id").alias("product_id"), "method", (F.col("position") + 1).alias("position"), "amount")


@query("""SELECT product_id, 'li.item' AS signature, 3 AS cards FROM products GROUP BY product_id""")
def scan_card_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of repeated cards on the pages of all products."""
    products = table(spark, folder, "products", "product_id").distinct()
    body = F.lit("<ul>" + "".join(f'<li class="item">Item {k}: {1000 * k}원</li>' for k in (1, 2, 3)) + "</ul>")
    return repeated_cards(_pages(products, F.col("product_id"), body)).select(F.col("capture_id").alias("product_id"), "signature", "cards")


@query("""SELECT product_id, 'woocommerce' AS platform, 'Drum ' || product_id AS name, '49.5' AS amount FROM products GROUP BY product_id
    UNION ALL SELECT product_id, 'cafe24', 'Reel ' || product_id, '12900' FROM products GROUP BY product_id""")
def scan_platform_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of two shop platforms, one page of each for every product."""
    products = table(spark, folder, "products", "product_id").distinct()
    first = F.format_string('<ul class="products"><li class="product type-product"><a href="/p/1"><h2 class="woocommerce-loop-product__title">Drum %s</h2><span class="price"><del>€60.00</del> <ins>€49.50</ins></span></a></li></ul>', F.col("product_id"))
    second = F.format_string('<ul class="prdList"><li id="anchorBoxId_7"><strong class="name"><a href="/p/2">Reel %s</a></strong><ul class="spec"><li>판매가 : <span>12,900원</span></li></ul></li></ul>', F.col("product_id"))
    pages = _pages(products, F.col("product_id"), first).unionByName(_pages(products, F.col("product_id"), second))
    return platform_cards(pages).select(F.col("capture_id").alias("product_id"), "platform", "name", "amount")


_STATES = """one AS (SELECT DISTINCT ON (capture_id) * FROM captures ORDER BY capture_id, ingested_at DESC),
    s AS (SELECT capture_id, 0 AS snapshot_no, url, content AS c FROM one UNION ALL
    SELECT capture_id, CAST(generate_subscripts(variant_snapshots, 1) AS INTEGER), coalesce(unnest(variant_snapshots).final_url, url), unnest(variant_snapshots).content FROM one),
    t AS (SELECT capture_id, snapshot_no, url, replace(CAST(c AS VARCHAR), chr(92) || 'x22', chr(34)) AS shown FROM s WHERE octet_length(c) > 0)"""


@query(
    rf"""WITH {_STATES}, h AS (SELECT *, unnest(regexp_extract_all(shown, '<a href="([^"]*)"', 1)) AS href FROM t)
    SELECT DISTINCT capture_id, snapshot_no, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^https?://[^/]+') || href END AS link FROM h"""
)
def page_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Where the links of every state of every page lead to, each target once."""
    return links(_page_states(spark, folder)).select("capture_id", "snapshot_no", "link").distinct()


@query(rf"""WITH {_STATES} SELECT DISTINCT capture_id, snapshot_no FROM t WHERE contains(shown, '<span class="price">')""")
def pages_with_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The states of pages on which a CSS rule finds a displayed price."""
    return css_rows(_page_states(spark, folder), "span.price", {"price": "."}).where("fields['price'] IS NOT NULL").select("capture_id", "snapshot_no").distinct()


def _files(rows: DataFrame, name: str) -> str:
    """A new folder in the shared one for files that a query writes and reads."""
    return f"{shared_folder(rows.sparkSession, 'files')}/{name}"


@query("SELECT product_id, name, count(*) AS n FROM products GROUP BY ALL")
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The products as CSV files with headers, read with renamed columns."""
    rows = table(spark, folder, "products", "product_id", "name")
    place = _files(rows, "csv")
    rows.select(F.col("product_id").alias("코드"), F.col("name").alias("이름")).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(place)
    back = read_csv(spark, place, {"코드": "product_id", "이름": "name"})
    fields = back.select(F.try_element_at("fields", F.lit("product_id")).alias("product_id"), F.try_element_at("fields", F.lit("name")).alias("name"))
    return fields.groupBy("product_id", "name").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def scan_json(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file for each region with its nations under ``items``; the region's name is a spec."""
    nations = table(spark, folder, "nation").join(F.broadcast(table(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    items = F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("r_name").alias("region")))
    place = _files(nations, "json")
    nations.groupBy("r_regionkey").agg(F.to_json(F.struct(items.alias("items"))).alias("value")).repartition(5, "r_regionkey").select("value", "r_regionkey").write.partitionBy("r_regionkey").text(place)
    back = read_json(spark, f"{place}/*/*.txt", {"key": "nation", "region": "spec:region"})
    return back.select(*[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("nation", "name")], F.try_element_at("specs", F.lit("region")).alias("region"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name AS name FROM nation")
def scan_xlsx(spark: SparkSession, folder: str) -> DataFrame:
    """A workbook of the nations, a fixed table of 25 rows, read back."""
    rows = table(spark, folder, "nation", "n_nationkey", "n_name")
    book = workbook({"Nations": (["nation", "name"], [tuple(r) for r in rows.collect()])})
    place = f"{_files(rows, 'xlsx')}/nations.xlsx"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)  # noqa: SLF001
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)  # noqa: SLF001
    stream.write(bytearray(book))
    stream.close()
    back = read_xlsx(spark, place)
    return back.select(*[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("nation", "name")])
