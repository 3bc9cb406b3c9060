"""Identities by hash of canonical JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """A JSON string with characters beyond ASCII as they are; ``null`` for null."""
    escaped = text
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(shown))
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def stable_id(*parts: Column, length: int = 24) -> Column:
    """First hex digits of the SHA-256 of the JSON list of string parts, elements separated by a comma and a space."""
    listed = F.concat(F.lit("["), F.concat_ws(", ", *[json_string(p.cast("string")) for p in parts]), F.lit("]"))
    return F.substring(F.sha2(listed, 256), 1, length)


def canonical_map(column: Column) -> Column:
    """Compact JSON of a string map with sorted keys, so that equal maps are equal texts; null for null."""
    pairs = F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"])))
    return F.when(column.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def content_digest(content: Column) -> Column:
    """SHA-256 of bytes or text in hex."""
    return F.sha2(content, 256)
