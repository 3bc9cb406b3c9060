"""Text for comparison, and text that fits into a sheet."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UTF-16 units that a sheet's cell holds, and the sign put behind text that is cut there.
CELL_UNITS, CUT = 32_767, "… [cut]"


def comparable(text: str | None) -> str | None:
    """Compatibility form, case-folded, white space collapsed."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def comparable_column(text: Column) -> Column:
    return F.udf(comparable, "string", useArrow=True)(text)


def bare_name(text: Column) -> Column:
    """A name without punctuation, signs and spaces, in lower case."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]|_", "")


def scripts(text: Column) -> Column:
    """The kinds of letters in a text, sorted: hangul, cjk (ideographs and kana), latin."""
    kinds = {"cjk": r"[\u3040-\u30FF\u4E00-\u9FFF]", "hangul": r"[\uAC00-\uD7AF]", "latin": r"[A-Za-z\u00C0-\u024F]"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in kinds.items()]))


def cell_text(text: str | None) -> str | None:
    """Text for a sheet: characters that XML forbids are written as ``_xHHHH_``, too long text is cut visibly."""
    if text is None:
        return None
    out = "".join(c if c in "\t\n\r" or " " <= c < "\ufffe" or c > "\uffff" else f"_x{ord(c):04X}_" for c in text)
    units = len(out.encode("utf-16-le", "surrogatepass")) // 2
    if units <= CELL_UNITS:
        return out
    cut = out.encode("utf-16-le", "surrogatepass")[: 2 * (CELL_UNITS - len(CUT))]
    return cut.decode("utf-16-le", "ignore") + CUT


def sheet_number(amount: Column) -> Column:
    """A decimal as double where 15 significant digits hold it exactly, else null."""
    shown = amount.cast("string")
    digits = F.regexp_replace(F.regexp_replace(shown, r"[-.]", ""), r"^0+", "")
    trimmed = F.when(shown.contains("."), F.regexp_replace(digits, r"0+$", "")).otherwise(digits)
    return F.when(F.length(trimmed) <= 15, amount.cast("double"))
