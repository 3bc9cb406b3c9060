"""Pack contents and prices in common units, and rows that state the same offer.

Texts are taken apart with JVM expressions, each distinct text of a unit, pack or basis once. The spellings found in them are mapped to
units as a dictionary of the distinct spellings (see :mod:`plumbline.functions.units`); both are joined to all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.units import alias_dictionary
from plumbline.operators.versions import latest_per_key
from plumbline.session import broadcast_if_small, cut_lineage

_NUMBER = r"\d[\d.,' \u00a0\u202f]*"
#: number x number unit x number; the unit is text without digits.
_QUANTITY = rf"^\s*(?:({_NUMBER})\s*[xX×*]\s*)?({_NUMBER})?\s*(\D*?)\s*(?:[xX×*]\s*({_NUMBER}))?\s*$"
#: currency number scale basis
_PRICE = rf"^\s*(?:KRW|USD|EUR|₩|\$|€)?\s*({_NUMBER})\s*(만\s?원|천\s?원|백만\s?원|억\s?원|원|cents?|c(?![a-z])|ct|¢|USD|EUR|KRW|\$|€)?\s*((?:/|per\s).*)?$"
#: The spelling in a basis text: after "per" or a slash, or before the Korean suffix for "per".
_BASIS = r"^\s*(?:per\s+|/\s*)?(.*?)\s*당?\s*$"

# What one unit of a price text is worth in the currency.
SCALES = {"천원": 1e3, "만원": 1e4, "백만원": 1e6, "억원": 1e8, "cent": 0.01, "cents": 0.01, "c": 0.01, "ct": 0.01, "¢": 0.01}

#: Relative difference up to which two contents or two prices agree.
TOLERANCE = 0.001
#: Width of a cell in tolerances. A row is sent to two cells of an axis only if it lies within a tolerance of a border.
CELL = 16


def parse_number(text: Column, separator: Column) -> Column:
    """The number that ``text`` writes with the decimal ``separator`` (``.`` or ``,``; the other one groups digits).

    Null for text that is no such number (``1.2.3`` with ``.``), and for null; a null separator is ``.``.
    """
    bare = F.translate(text, "' \u00a0\u202f", "")
    plain = F.when(separator == ",", F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", ""))
    return plain.try_cast("double")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern that matches the whole text, as an array, from one match; null if it doesn't match."""
    parts = F.split(F.regexp_replace(text, pattern, "\x01".join(f"${g}" for g in range(1, n + 1))), "\x01")
    return F.when(F.size(parts) == n, parts)


def _group(parts: str, g: int) -> Column:
    return F.nullif(F.col(parts)[g - 1], F.lit(""))


def _plain(text: Column) -> Column:
    """Whether a text is nothing but a number: then no pattern has to be matched."""
    return (F.translate(text, "0123456789.,", "") == "") & F.translate(text, ".,", "").between("0", ":")


def _stated_basis(price: Column, basis: Column) -> Column:
    """The text of the basis: what stands behind the price after a slash or "per", else the column's."""
    in_price = F.when(price.contains("/") | price.contains("per"), F.nullif(F.regexp_extract(price, _PRICE, 3), F.lit("")))
    return F.coalesce(in_price, basis)


def quantity_dictionary(offers: DataFrame) -> DataFrame:
    """``text, basis, n_point, n_comma, has, spelled, dimension, size``: the distinct texts of units, packs and bases, each matched once.

    ``n`` is the product of the numbers in a text, as either decimal separator reads it (null if one can't be read), ``has`` whether
    there are numbers, ``spelled`` whether there is a unit, ``dimension`` and ``size`` what unit that is. Packs that are plain numbers
    are left out. As many rows as there are ways to write a unit with its numbers.
    """
    part = lambda text, basis: F.struct(text.alias("text"), F.lit(basis).alias("basis"))
    pack = F.when(~_plain(F.col("pack_quantity")), F.col("pack_quantity"))
    parts = F.array(part(F.col("unit"), False), part(pack, False), part(_stated_basis(F.col("price"), F.col("price_basis")), True))
    texts = offers.select(F.inline(parts)).where("text IS NOT NULL").distinct()
    matched = texts.select("*", _groups(F.when(F.col("basis"), F.regexp_extract("text", _BASIS, 1)).otherwise(F.col("text")), _QUANTITY, 4).alias("q"))
    numbers = [_group("q", g) for g in (1, 2, 4)]

    def product(separator: str) -> Column:
        return reduce(lambda a, b: a * b, [F.when(n.isNull(), F.lit(1.0)).otherwise(parse_number(n, F.lit(separator))) for n in numbers])

    # Cut off from the rows: it is used for the spellings and three times for the rows, and must be made once.
    parsed = cut_lineage(
        matched.select(
            "text", "basis", product(".").alias("n_point"), product(",").alias("n_comma"), (numbers[0].isNotNull() | numbers[1].isNotNull()).alias("has"),
            F.nullif(_group("q", 3), F.lit("-")).alias("spelling"),
        )
    )
    units = alias_dictionary(parsed.select("spelling").distinct()).select("spelling", "dimension", "size")
    return cut_lineage(
        parsed.join(broadcast_if_small(cut_lineage(units), "spelling"), "spelling", "left").select(
            "text", "basis", "n_point", "n_comma", F.coalesce("has", F.lit(False)).alias("has"), F.col("spelling").isNotNull().alias("spelled"), "dimension", "size"
        )
    )


def normalize_offers(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``row_id, model, currency, dimension, content, unit_price``, one row for each ``row_id``.

    ``content`` is the whole pack in g, ml, mm or pieces, ``unit_price`` the price of one of those. Where the content or
    the price can't be told, ``dimension``, ``content`` and ``unit_price`` are null:

    * the quantity or its unit is missing or unreadable (a package word such as ``box`` is no unit);
    * the price is missing, no number, not positive, or its basis is missing or of another dimension;
    * the basis is one ``each`` and no unit is stated.

    A source without a row in ``sources`` writes ``.`` for decimals. Of repeated deliveries the one with the latest
    ``ingested_at`` stands. Further columns are ignored. Unit spellings are mapped over all rows; a unit nobody knows leaves its
    rows unknown rather than guessed.

    Building it runs jobs: texts of units, packs and bases are matched once each as a dictionary of the distinct ones
    (:func:`quantity_dictionary`) that is joined to the rows; only prices are matched row by row.
    """
    separators = sources.groupBy("source_id").agg(F.max("decimal_separator").alias("__sep"))
    offers = rows.select("row_id", "source_id", "model", "currency", "ingested_at", "unit", "pack_quantity", "price", "price_basis")
    known = broadcast_if_small(quantity_dictionary(offers), "text")
    comma = F.coalesce(F.col("__sep") == ",", F.lit(False))
    parts = offers.join(broadcast_if_small(separators, "source_id"), "source_id", "left").select(
        "row_id", "ingested_at", "model", "currency", "__sep", "unit", _plain(F.col("pack_quantity")).alias("plain"), "pack_quantity",
        _stated_basis(F.col("price"), F.col("price_basis")).alias("stated"), _groups(F.col("price"), _PRICE, 3).alias("priced"),
    )
    for name, key, basis in (("unit", F.col("unit"), False), ("pack", F.when(~F.col("plain"), F.col("pack_quantity")), False), ("basis", F.col("stated"), True)):
        side = known.where(F.col("basis") == basis).select(
            F.col("text").alias(f"{name}_text"), *[F.col(c).alias(f"{name}_{c}") for c in ("n_point", "n_comma", "has", "spelled", "dimension", "size")]
        )
        parts = parts.withColumn("__key", key).join(side, F.col("__key") == F.col(f"{name}_text"), "left").drop("__key", f"{name}_text")
    number = lambda name: F.when(comma, F.col(f"{name}_n_comma")).otherwise(F.col(f"{name}_n_point"))
    pack_n = F.when(F.col("plain"), parse_number(F.col("pack_quantity"), F.col("__sep"))).otherwise(number("pack"))
    pack_has, pack_spelled = F.coalesce("plain", F.lit(False)) | F.coalesce("pack_has", F.lit(False)), F.coalesce("pack_spelled", F.lit(False))
    scale = F.translate(_group("priced", 2), " \t", "")
    worth = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), scale), F.lit(1.0))
    amount = parse_number(_group("priced", 1), F.col("__sep")) * worth

    measured = ~F.col("unit_dimension").isin("package", "each")
    unit_dim = F.when(measured, F.col("unit_dimension"))
    unit_size = F.when(measured, number("unit") * F.col("unit_size"))
    own = ~F.col("pack_dimension").isin("package", "each")
    dimension = F.when(~pack_spelled, unit_dim).when(own, F.col("pack_dimension"))
    content = F.when(pack_has, F.when(~pack_spelled, pack_n * unit_size).when(own, pack_n * F.col("pack_size")))
    # What the price buys, in the base unit of the content's dimension.
    buys = (
        F.when(F.col("basis_dimension") == "package", content)
        .when((F.col("basis_dimension") == "each") & (unit_dim == dimension), unit_size)
        .when(F.col("basis_dimension") == dimension, number("basis") * F.col("basis_size"))
    )
    priced = parts.select(
        "row_id", "ingested_at", "model", "currency", dimension.alias("dimension"), content.alias("content"),
        F.when(buys > 0, amount / buys).alias("unit_price"),
    )
    told = F.coalesce((F.col("content") > 0) & (F.col("unit_price") > 0), F.lit(False))
    return latest_per_key(priced, ["row_id"], ["ingested_at"]).select(
        "row_id", "model", "currency", *[F.when(told, F.col(c)).alias(c) for c in ("dimension", "content", "unit_price")]
    )


def same_offers(normalized: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``row_id_a, row_id_b`` (a < b): rows of one model, currency and dimension whose content and unit price both agree
    within ``tolerance`` of the larger value. Rows with a null model, currency, content or price are in no pair.

    A band join as an equality join: rows are keyed by cells of the logarithms of content and price. One side is also
    sent to the neighbouring cell where it lies within a tolerance of the border, so that every pair meets exactly
    once, and a model with any number of rows is split into as many keys as it has different offers.
    """
    width = CELL * tolerance
    df = normalized.where(F.col("model").isNotNull() & F.col("currency").isNotNull() & F.col("content").isNotNull())
    key = ["model", "currency", "dimension"]

    def cells(column: str, slack: float) -> Column:
        at = F.log(F.col(column))
        low, high = F.floor((at - slack) / width), F.floor((at + slack) / width)
        return F.array_distinct(F.array(low, high))

    # ln(1 / (1 - t)) is the largest distance of two logarithms that agree; the rest is room for rounding.
    slack = tolerance * 1.001
    home = df.select(
        *key, F.floor(F.log("content") / width).alias("__c"), F.floor(F.log("unit_price") / width).alias("__p"),
        F.col("row_id").alias("row_id_b"), F.col("content").alias("__cb"), F.col("unit_price").alias("__pb"),
    )
    probe = df.select(
        *key, F.col("row_id").alias("row_id_a"), F.col("content").alias("__ca"), F.col("unit_price").alias("__pa"),
        F.explode(cells("content", slack)).alias("__c"),
    ).select("*", F.explode(cells("__pa", slack)).alias("__p"))

    def agree(a: str, b: str) -> Column:
        return F.abs(F.col(a) - F.col(b)) <= tolerance * F.greatest(a, b)

    return (
        probe.join(home, [*key, "__c", "__p"])
        .where((F.col("row_id_a") < F.col("row_id_b")) & agree("__ca", "__cb") & agree("__pa", "__pb"))
        .select("row_id_a", "row_id_b")
    )
