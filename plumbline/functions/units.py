"""Units of measure: the lexicon, and the fuzzy mapping of spellings to it.

Distinct spellings are compared with the lexicon through an inverted index of character n-grams; candidates are verified
by a weighted edit distance. The result is a dictionary from spelling to unit, which is joined to all rows.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of each unit in the base unit of its dimension (g, ml, mm, one piece) and its usual spellings.
# ``package`` is the pack as a whole, ``each`` one of the stated unit; they have no size of their own.
UNITS: list[tuple[str, str, float, tuple[str, ...]]] = [
    ("mass", "mg", 0.001, ("mg", "milligram", "밀리그램")),
    ("mass", "g", 1.0, ("g", "G", "gr", "gram", "grams", "gramme", "그램")),
    ("mass", "kg", 1000.0, ("kg", "KG", "Kg", "kilogram", "kilograms", "kilo", "킬로그램", "킬로")),
    ("mass", "t", 1_000_000.0, ("t", "ton", "tonne", "톤")),
    ("mass", "oz", 28.349523125, ("oz", "OZ", "ounce", "ounces", "온스")),
    ("mass", "lb", 453.59237, ("lb", "LB", "lbs", "pound", "pounds", "파운드")),
    ("volume", "ml", 1.0, ("ml", "mL", "ML", "cc", "millilitre", "milliliter", "밀리리터")),
    ("volume", "cl", 10.0, ("cl", "cL", "centilitre", "센티리터")),
    ("volume", "dl", 100.0, ("dl", "dL", "decilitre", "데시리터")),
    ("volume", "l", 1000.0, ("l", "L", "litre", "liter", "litres", "liters", "ltr", "리터")),
    ("volume", "fl oz", 29.5735295625, ("fl oz", "fl. oz", "fl.oz.", "floz", "fluid ounce", "액량온스")),
    ("volume", "gal", 3785.411784, ("gal", "gallon", "gallons", "갤런")),
    ("length", "mm", 1.0, ("mm", "MM", "millimetre", "millimeter", "밀리미터")),
    ("length", "cm", 10.0, ("cm", "CM", "centimetre", "centimeter", "센티미터", "센티")),
    ("length", "m", 1000.0, ("m", "M", "metre", "meter", "metres", "meters", "미터")),
    ("length", "in", 25.4, ("in", "inch", "inches", "인치")),
    ("length", "ft", 304.8, ("ft", "foot", "feet", "피트")),
    ("length", "yd", 914.4, ("yd", "yard", "yards", "야드")),
    ("count", "ea", 1.0, ("ea", "EA", "pc", "pcs", "piece", "pieces", "개", "입", "매", "장", "병")),
    ("count", "dz", 12.0, ("dz", "doz", "dozen", "다스")),
    ("count", "gross", 144.0, ("gross", "그로스")),
    ("package", "pack", 1.0, ("pack", "packs", "pkg", "package", "box", "boxes", "carton", "팩", "박스", "상자", "묶음", "세트")),
    ("each", "each", 1.0, ("each", "unit", "개당가", "낱개")),
]

#: Costs of the weighted edit distance. Differences that carry no meaning are cheap.
LETTER, CASE, SEPARATOR, REPEATED, SWAPPED = 1.0, 0.1, 0.1, 0.4, 0.7
#: A spelling is accepted up to this distance for each letter of the unit's spelling, and only if every other unit is
#: farther by the margin.
ACCEPT, MARGIN, GRAM = 0.2, 0.3, 2


def fold_spelling(text: str) -> str:
    """Compatibility form of a unit sign (``㎏`` is kg, ``ℓ`` is l), without outer white space."""
    return unicodedata.normalize("NFKC", text).strip()


def grams(text: str, n: int = GRAM) -> list[str]:
    """Distinct character n-grams of the padded, case-folded spelling, without separators."""
    bare = "^" + "".join(c for c in fold_spelling(text).casefold() if c.isalnum()) + "$"
    return sorted({bare[i : i + n] for i in range(max(1, len(bare) - n + 1))})


def edit_distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein distance of two spellings; case, separators and doubled letters cost little."""

    def drop(text: str, i: int) -> float:
        if not text[i].isalnum():
            return SEPARATOR
        return REPEATED if i and text[i] == text[i - 1] else LETTER

    def change(x: str, y: str) -> float:
        return 0.0 if x == y else CASE if x.casefold() == y.casefold() else LETTER

    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        rows[i + 1][0] = rows[i][0] + drop(a, i)
    for j in range(len(b)):
        rows[0][j + 1] = rows[0][j] + drop(b, j)
    for i in range(len(a)):
        for j in range(len(b)):
            best = min(rows[i][j + 1] + drop(a, i), rows[i + 1][j] + drop(b, j), rows[i][j] + change(a[i], b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                best = min(best, rows[i - 1][j - 1] + SWAPPED)
            rows[i + 1][j + 1] = best
    return rows[-1][-1]


def lexicon(spark: SparkSession) -> DataFrame:
    """``alias, dimension, unit, size`` of the fixed lexicon, some hundred rows."""
    rows = [(fold_spelling(a), dim, unit, size) for dim, unit, size, names in UNITS for a in names]
    return spark.createDataFrame(list(dict.fromkeys(rows)), "alias string, dimension string, unit string, size double")


def alias_dictionary(spellings: DataFrame) -> DataFrame:
    """``spelling, dimension, unit, size``: the unit of each distinct spelling that has one.

    ``spellings`` has one string column ``spelling``; repeated, null and blank ones are allowed. A spelling that equals a
    lexicon entry is that unit. Others are mapped if they are near to one unit and clearly farther from all others;
    the rest are left out: an unknown unit stays unknown. Of lexicon entries of one unit the nearest counts.

    Only spellings that share an n-gram are compared. The index has some hundred rows, whatever the data.
    """
    spark = spellings.sparkSession
    known = lexicon(spark)
    split = F.udf(grams, "array<string>", useArrow=True)
    fold = F.udf(fold_spelling, "string", useArrow=True)
    distance = F.udf(edit_distance, "double", useArrow=True)
    index = known.select("*", F.explode(split("alias")).alias("gram"))
    distinct = spellings.where(F.col("spelling").isNotNull() & (F.trim("spelling") != "")).distinct()
    folded = distinct.select("spelling", fold("spelling").alias("folded"))
    candidates = (
        folded.select("*", F.explode(split("folded")).alias("gram"))
        .join(F.broadcast(index), "gram")  # fixed size
        .groupBy("spelling", "folded", "alias", "dimension", "unit", "size")
        .agg(F.count("*").alias("shared"))
    )
    verified = candidates.select("*", distance("folded", "alias").alias("cost")).where(
        F.col("cost") <= ACCEPT * F.length("alias")
    )
    of_unit = verified.groupBy("spelling", "dimension", "unit", "size").agg(F.min("cost").alias("cost"))
    ranked = of_unit.groupBy("spelling").agg(F.array_sort(F.collect_list(F.struct("cost", "unit", "dimension", "size"))).alias("near"))
    best, second = F.col("near")[0], F.get("near", F.lit(1))
    clear = (best["cost"] == 0) | second.isNull() | (second["cost"] - best["cost"] >= MARGIN)
    return ranked.where(clear).select(
        "spelling", best["dimension"].alias("dimension"), best["unit"].alias("unit"), best["size"].alias("size")
    )

