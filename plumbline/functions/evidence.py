"""What a piece of source text proves of a field: declared rules that can be replayed, values for comparison, and literal offers.

All but the reader of displayed amounts are JVM expressions over whole texts: a rule that holds for a part of a text proves nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.amounts import hinted_currency, plain_decimal, replayed_amount
from plumbline.functions.terms import BASES, MONTHS, YEARS

_DIGITS = r"(?:\d{1,3}(?:,\d{3})+|\d+)"


def _number_with(text: Column, unit: str, digits: str = _DIGITS) -> Column:
    """The digits of a text that is one number with a unit behind it, without their grouping; null for all else."""
    return F.translate(F.nullif(F.regexp_extract(text, rf"(?i)^({digits})\s*(?:{unit})$", 1), F.lit("")), ",", "")


def _named(text: Column, value: str, *words: str) -> Column:
    return F.when(text.isin(list(words)), F.lit(value))


def _term(text: Column) -> Column:
    months = F.nullif(F.regexp_extract(text, rf"^([1-9]\d{{0,2}})\s?-?(?:{MONTHS})$", 1), F.lit(""))
    years = F.regexp_extract(text, rf"^([1-9]\d?)\s?-?(?:{YEARS})$", 1).try_cast("int") * 12
    return F.coalesce(months, years.cast("string"))


def _basis(text: Column) -> Column:
    value = F.lit(None).cast("string")
    for name, pattern in BASES.items():
        value = F.when(text.rlike(rf"(?i)^(?:{pattern})$"), F.lit(name)).otherwise(value)
    return value


_MONEY = ("price", "deposit_amount", "advance_amount", "upfront_deposit_amount", "deposit_installment_amount", "vehicle_value")
_MONTH = ("term_months", "deposit_installment_months")
# The names of the rules and the fields that each may prove; beside them what each reads.
RULES: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {
    "korean_won_amount": (_MONEY, lambda t: _number_with(t, "원")),
    "korean_months": (_MONTH, lambda t: _number_with(t, "개월", r"[1-9]\d*")),
    "korean_won_currency": (("currency",), lambda t: _named(t, "KRW", "원", "₩", "KRW")),
    "korean_vat_included": (("tax",), lambda t: _named(t, "included", "부가세 포함")),
    "korean_vat_excluded": (("tax",), lambda t: _named(t, "excluded", "부가세 별도")),
    "kilometers": (("annual_mileage_km",), lambda t: _number_with(t, "km")),
    "displayed_amount": ((*_MONEY, "reference_price"), lambda t: F.udf(replayed_amount, "string", useArrow=True)(t)),
    "currency_marker": (("currency",), lambda t: hinted_currency(t, F.lit(None).cast("string"))),
    "contract_term": (_MONTH, _term),
    "recurring_marker": (("price_basis",), _basis),
}


def proven_value(field: Column, rule: Column, raw: Column, rules: tuple[str, ...] = tuple(RULES)) -> Column:
    """The one value that ``raw`` proves of ``field`` by ``rule``; null for an unknown rule, a field that the rule may not prove, and text that
    it doesn't hold for. A field may be named below ``rental_conditions.``. With fewer ``rules`` only those are known."""
    name = F.regexp_replace(field, r"^rental_conditions\.", "")
    text = F.trim(raw)
    value = F.lit(None).cast("string")
    for r in rules:
        fields, read = RULES[r]
        value = F.when((rule == r) & name.isin(list(fields)), read(text)).otherwise(value)
    return value


def attests(field: Column, rule: Column, raw: Column, value: Column, rules: tuple[str, ...] = tuple(RULES)) -> Column:
    """Whether ``raw`` proves ``value``: the same text if no rule is declared, else the rule's result. Nulls prove nothing."""
    same = F.when(rule.isNull(), F.trim(raw)).otherwise(proven_value(field, rule, raw, rules)) == F.trim(value)
    return F.coalesce(same, F.lit(False))


def comparable_value(field: Column, value: Column) -> Column:
    """A value as fields of its kind are compared: months and plain amounts (``만`` for ten thousands) by their number, all else in lower case
    with single spaces."""
    text = F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))
    months = F.nullif(F.regexp_extract(text, r"^(\d+)\s*(?:개월|months?|か月)?$", 1), F.lit(""))
    figure = F.translate(F.regexp_extract(text, r"^([\d,.]+)\s*만?\s*(?:원|krw|km)?$", 1), ",", "").try_cast("decimal(30,6)")
    amount = figure * F.when(text.rlike(r"만"), 10_000).otherwise(1)
    shown = plain_decimal(amount)
    return F.when(field.isin(*_MONTH), F.coalesce(months, text)).when(field.isin("price", "deposit_amount", "annual_mileage_km"), F.coalesce(shown, text)).otherwise(text)


def literal_price(price: Column) -> Column:
    """``struct<price, kind, basis, currency>`` of a price as a Korean shop displays it: ``월 12,000원부터`` is 12000, ``from``, monthly, KRW. All null
    for other text; ``kind`` is ``listed`` without a sign of a starting price."""
    pattern = rf"(?i)^(월\s*)?(₩\s*)?({_DIGITS})\s*(원|KRW)?\s*(~|～|부터)?$"
    text = F.trim(price)
    part = lambda g: F.regexp_extract(text, pattern, g)
    holds = text.rlike(pattern)
    return F.struct(
        F.when(holds, F.translate(part(3), ",", "")).alias("price"), F.when(holds, F.when(part(5) != "", "from").otherwise("listed")).alias("kind"),
        F.when(holds & (part(1) != ""), "monthly").alias("basis"), F.when(holds & ((part(2) != "") | (part(4) != "")), "KRW").alias("currency"),
    )
