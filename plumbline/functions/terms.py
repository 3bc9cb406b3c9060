"""Terms in text: contract months, the basis of a recurring price, a market's currency, waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How months, years and recurring bases are written.
MONTHS = r"개월|months?\b|mois\b|Monate?n?\b|か月|ヶ月"
YEARS = r"년|years?\b|ans?\b|Jahre?n?\b|年間"
BASES = {"monthly": r"월|/\s?month|per month|monthly", "yearly": r"연|/\s?year|per year|yearly|annual", "weekly": r"주당|/\s?week|per week|weekly", "daily": r"일당|/\s?day|per day|daily"}

# Currencies by ISO 3166 country code, and names by which countries are called.
CURRENCY_OF = {
    "AT": "EUR", "AU": "AUD", "BE": "EUR", "CA": "CAD", "CH": "CHF", "CN": "CNY", "DE": "EUR", "ES": "EUR", "FR": "EUR", "GB": "GBP", "HK": "HKD",
    "IE": "EUR", "IT": "EUR", "JP": "JPY", "KR": "KRW", "NL": "EUR", "NZ": "NZD", "PT": "EUR", "SG": "SGD", "TW": "TWD", "UK": "GBP", "US": "USD",
}
COUNTRY_OF = {
    "australia": "AU", "호주": "AU", "canada": "CA", "캐나다": "CA", "switzerland": "CH", "스위스": "CH", "china": "CN", "중국": "CN", "germany": "DE", "독일": "DE",
    "spain": "ES", "스페인": "ES", "france": "FR", "프랑스": "FR", "united kingdom": "GB", "great britain": "GB", "영국": "GB", "hong kong": "HK", "홍콩": "HK",
    "italy": "IT", "이탈리아": "IT", "japan": "JP", "일본": "JP", "korea": "KR", "south korea": "KR", "republic of korea": "KR", "한국": "KR", "대한민국": "KR",
    "new zealand": "NZ", "뉴질랜드": "NZ", "singapore": "SG", "싱가포르": "SG", "taiwan": "TW", "대만": "TW", "united states": "US", "united states of america": "US",
    "usa": "US", "america": "US", "미국": "US",
}


def term_months(text: Column) -> Column:
    """The one contract term that a text names, in months; null for none, for several different ones and for ranges."""
    months = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![\d~∼〜–-])(\d{{1,3}})\s?-?(?:{MONTHS})"), F.lit(1)), lambda x: x.cast("int"))
    years = F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![\d~∼〜–-])(\d{{1,2}})\s?-?(?:{YEARS})"), F.lit(1)), lambda x: x.cast("int") * 12)
    ranged = text.rlike(rf"\d\s?[~∼〜–-]\s?\d{{1,3}}\s?(?:{MONTHS}|{YEARS})")
    found = F.array_distinct(F.concat(months, years))
    return F.when(~ranged & (F.size(found) == 1), F.get(found, F.lit(0)))


def recurring_basis(text: Column) -> Column:
    """The one recurring basis that a text names: monthly, yearly, weekly or daily; null for none or several."""
    named = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){pattern}"), F.lit(k)) for k, pattern in BASES.items()]))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def market_currency(market: Column) -> Column:
    """The currency of a market named by its country (code or name) or by a currency code; null for others."""
    shown = F.regexp_replace(F.lower(F.trim(market)), r"[\s-]+", " ")
    known = {code.lower(): currency for code, currency in CURRENCY_OF.items()} | {name: CURRENCY_OF[code] for name, code in COUNTRY_OF.items()}
    known |= {currency.lower(): currency for currency in CURRENCY_OF.values()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), shown)


def retry_delay(retry_after: Column, attempt: Column, now: Column) -> Column:
    """Seconds to wait: those of a Retry-After header (a number or an HTTP date), else half a second an attempt, up to two."""
    seconds = F.when(retry_after.rlike(r"^\s*\d+\s*$"), F.trim(retry_after).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(retry_after, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d) GMT", 1), F.lit("d MMM yyyy HH:mm:ss"))
    until = F.unix_timestamp(date).cast("double") - F.unix_timestamp(now).cast("double")
    return F.greatest(F.lit(0.0), F.coalesce(seconds, until, F.least(F.lit(2.0), attempt * 0.5)))
