"""Media types of captures: their charset, their kind, and decoded content."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.IGNORECASE)


@lru_cache(maxsize=4096)
def charset_of(media_type: str | None) -> str:
    """The Python codec that a media type declares; ``utf-8`` if it names none or an unknown one."""
    named = _CHARSET.search(media_type or "")
    if named:
        try:
            return codecs.lookup(named.group(1)).name
        except LookupError:
            pass
    return "utf-8"


def decode(content: bytes | None, media_type: str | None) -> str | None:
    """Content as its media type declares it; bytes that are not of the charset become U+FFFD."""
    return None if content is None else content.decode(charset_of(media_type), "replace")


def bare_media_type(media_type: Column) -> Column:
    """``type/subtype`` in lower case without parameters; null for null and blank."""
    return F.nullif(F.lower(F.trim(F.substring_index(media_type, ";", 1))), F.lit(""))


# Media types by file extension.
EXTENSIONS = {
    "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
    "txt": "text/plain", "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}


def media_type_of_path(path: Column, fallback: str = "application/octet-stream") -> Column:
    """Media type by the extension of a path or URL, query and fragment aside."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), F.lit(fallback))
