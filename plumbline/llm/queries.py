"""Named queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.boilerplate import main_body, main_text
from plumbline.llm.garbled import garbled_captures
from plumbline.llm.leaks import leaked_items
from plumbline.llm.looks import canonical_column, look_alikes
from plumbline.llm.spans import SharedSpans
from plumbline.llm.tokens import encode_documents
from plumbline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alikes(table(spark, folder, "products"), table(spark, folder, "captures"))


def p1_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every product row with the canonical form of its name."""
    products = table(spark, folder, "products", "product_id", "name")
    return products.withColumn("canonical", canonical_column(products["name"]))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_body(table(spark, folder, "captures"))


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The main body of every state of every page as text."""
    return main_text(table(spark, folder, "captures"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_captures(table(spark, folder, "captures"), restored=False).select("capture_id")


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_captures(table(spark, folder, "captures"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents")).pairs()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents")).shares()


def p8_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents")).clusters()


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_names": p1_names,
    "p3_found": p3_found,
    "p3_texts": p3_texts,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_clusters": p8_clusters,
}
# White space of any kind, and characters that don't count in a word, as regular expressions.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SILENT = r"[\p{P}\p{S}\p{Cf}]|[\x{00}-\x{08}\x{0e}-\x{1b}\x{7f}-\x{84}\x{86}-\x{9f}]"
_RUNS = f"""SELECT id, array_to_string(list_slice(w, i, i + 11), ' ') AS run FROM (
  SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM (
    SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(nfc_normalize(text)), '{_SILENT}', '', 'g'), '{_SPACE}'), lambda x: x <> '') AS w FROM (%s)))"""
_WINDOWS = """w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (
    SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))"""

ORACLE: dict[str, str] = {
    "p7_found": f"""WITH d AS ({_RUNS % "SELECT doc_id AS id, text FROM documents"}), e AS ({_RUNS % "SELECT item_id AS id, text FROM eval_items"})
    SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d JOIN e USING (run)""",
    "p8_found": f"""WITH {_WINDOWS}, u AS (SELECT DISTINCT doc_id, h FROM w)
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_clusters": f"""WITH RECURSIVE {_WINDOWS}, u AS (SELECT DISTINCT doc_id, h FROM w),
    l AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id),
    seen(node, start) AS (SELECT a, a FROM l UNION SELECT l.b, seen.start FROM seen JOIN l ON l.a = seen.node)
    SELECT node AS doc_id, min(start) AS cluster, node = min(start) AS keep FROM seen GROUP BY node""",
    "p8_shares": f"""WITH {_WINDOWS}, several AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
    starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM w SEMI JOIN several USING (h)),
    sums AS (SELECT doc_id, CAST(sum(least(300, coalesce(n - i, 300))) AS BIGINT) AS s FROM starts GROUP BY doc_id)
    SELECT doc_id, length(text) AS n_chars, coalesce(s, 0) AS shared_chars, coalesce(round(CAST(s AS DOUBLE) / length(text), 6), 0.0) AS share
    FROM documents LEFT JOIN sums USING (doc_id)""",
}
