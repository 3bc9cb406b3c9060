"""Term filters, ordered classifiers and conditions with three outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_match(text: Column, includes: Sequence[str], excludes: Sequence[str]) -> Column:
    """Whether a text holds any of the terms to include (all do if there are none) and none of those to exclude.

    ``text`` and terms are compared as given; normalise them first. A null text holds nothing.
    """
    shown = F.coalesce(text, F.lit(""))
    some = F.lit(not includes)
    for t in includes:
        some = some | shown.contains(t)
    none = F.lit(True)
    for t in excludes:
        none = none & ~shown.contains(t)
    return some & none


def classify(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule of which any word occurs in the text in lower case; ``default`` if none does."""
    shown = F.lower(F.coalesce(text, F.lit("")))
    result = None
    for label, words in rules:
        test = F.lit(False)
        for w in words:
            test = test | shown.contains(w)
        result = F.when(test, label) if result is None else result.when(test, label)
    return F.lit(default) if result is None else result.otherwise(default)


def outcome(value: Column, operator: str, wanted: Sequence[str]) -> Column:
    """``matched``, ``excluded`` or, for a null or blank value, ``unknown``.

    Operators: ``equals``, ``not_equals``, ``contains``, ``one_of``. Values are compared as given.
    """
    tests = {
        "equals": value == F.lit(wanted[0]),
        "not_equals": value != F.lit(wanted[0]),
        "contains": value.contains(wanted[0]),
        "one_of": value.isin(list(wanted)),
    }
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "unknown").when(tests[operator], "matched").otherwise("excluded")


def combined(*outcomes: Column) -> Column:
    """The outcome of several conditions: excluded if any is, else unknown if any is, else matched."""
    listed = F.array(*outcomes)
    return F.when(F.array_contains(listed, "excluded"), "excluded").when(F.array_contains(listed, "unknown"), "unknown").otherwise("matched")
