"""URLs: one canonical form, hosts, identities of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL = 2048
# Query keys that name an item, in the order in which they are looked for.
ITEM_KEYS = (
    "product_no", "productno", "goods_no", "goodsno", "goodscd", "item_id", "itemid", "product_id", "productid", "prdno", "pid", "gno", "idx", "no", "id", "sku",
)
# IPv4 blocks that are not public (RFC 6890): the block's first address and the number of its bits.
PRIVATE_BLOCKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24),
    ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)

# An absolute URL in its parts: scheme, authority, path, query.
_URL = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
_HOST_AND_PORT = r"^(\[[0-9A-Fa-f:]+\]|[^:@\[\]]+)(?::(\d*))?$"


def _address(dotted: str) -> int:
    return reduce(lambda n, part: n * 256 + int(part), dotted.split("."), 0)


def _public_ipv4(name: Column) -> Column:
    """The address if it is a public one; null for private, malformed and ambiguous ones (leading zeros)."""
    octets = F.transform(F.split(name, r"\."), lambda x: x.try_cast("bigint"))
    valid = name.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & ~F.exists(octets, lambda x: x > 255)
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x)
    private = F.lit(False)
    for first, bits in PRIVATE_BLOCKS:
        low = _address(first)
        private = private | value.between(low, low + 2 ** (32 - bits) - 1)
    return F.when(valid & ~private, name)


def _public_name(name: Column) -> Column:
    """A domain name in its ASCII form, in lower case; null unless it has two labels or more and is not a local one."""
    ascii_form = F.when(name.rlike(r"^[\x00-\x7f]*$"), name).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), name))
    lower = F.regexp_replace(F.lower(ascii_form), r"\.$", "")
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return F.when(lower.rlike(rf"^(?:{label}\.)+{label}$") & ~lower.rlike(r"\.(?:local|localhost|\d+)$"), lower)


def canonical_url_column(url: Column) -> Column:
    """The one form of a public web address; null for anything else. JVM expressions only.

    As the URL standard has it: scheme and host in lower case, international hosts in their ASCII form, no default port, no
    fragment, ``/`` for an empty path. Addresses with credentials, white space, controls, backslashes or more than ``MAX_URL``
    characters, and hosts that are local, private or an IPv6 address outside of 2000::/3 are none.
    """
    part = lambda text, pattern, g: F.regexp_extract(text, pattern, g)
    scheme = F.lower(part(url, _URL, 1))
    authority = part(url, _URL, 2)
    name, port = part(authority, _HOST_AND_PORT, 1), part(authority, _HOST_AND_PORT, 2).try_cast("int")
    place = (
        F.when(name.startswith("["), F.when(name.rlike(r"^\[[23][0-9A-Fa-f]{3}:[0-9A-Fa-f:]*\]$"), F.lower(name)))
        .when(name.rlike(r"^[0-9.]+$"), _public_ipv4(name)).otherwise(_public_name(name))
    )
    usual = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    shown_port = F.when(port.isNull() | usual, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
    path = part(url, _URL, 3)
    fits = (F.length(url) <= MAX_URL) & ~url.rlike(r"[\s\\\x00-\x20\x7f]") & scheme.isin("http", "https") & (port.isNull() | port.between(1, 65535))
    return F.when(fits, F.concat(scheme, F.lit("://"), place, shown_port, F.when(path == "", "/").otherwise(path), part(url, _URL, 4)))


def host(url: Column) -> Column:
    """Host of a URL in lower case; null for what is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def without_secrets(url: Column) -> Column:
    """Scheme, host, port and path: no credentials, query or fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


def host_allowed(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    at = host(url)
    test = F.lit(False)
    for d in domains:
        test = test | (at == d.lower()) | at.endswith("." + d.lower())
    return F.coalesce(test, F.lit(False))


def item_identity(url: Column) -> Column:
    """``key=value`` of the first query key that names an item, else ``path:`` and the path."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    found = [F.nullif(F.regexp_extract(query, rf"(?i)(?:^|&){k}=([^&]{{1,80}})", 1), F.lit("")) for k in ITEM_KEYS]
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"/+$", "")
    named = F.coalesce(*[F.concat(F.lit(k + "="), v) for k, v in zip(ITEM_KEYS, found, strict=True)])
    return F.coalesce(named, F.concat(F.lit("path:"), F.when(path == "", "/").otherwise(path)))
