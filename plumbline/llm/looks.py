"""One form for texts that look the same.

Most of a text is stable: normalising it changes nothing. Quick-check properties tell the other characters; each run of
them is normalised together with the character before it, with which it may compose, and spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.media import decode
from plumbline.session import cut_lineage

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I",
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "κ": "k",
    "υ": "u",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O", "Ս": "U",
    # Greek and Cyrillic forms of other times
    "γ": "y", "ϒ": "Y", "Ѵ": "V", "Ϝ": "F", "ϕ": "φ",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V",
    "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Coptic
    "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲏ": "H", "Ⲧ": "T",
    # small capitals that are drawn as the small letter
    "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
    # others
    "ɡ": "g", "ɑ": "a", "ı": "i", "µ": "μ",
}
# Hyphens, dots, quotes, slashes and colons that are drawn alike. The en dash is longer than a hyphen and curly double quotes
# are drawn unlike straight ones: both stay.
SIGNS = {"∕": "/", "⁄": "/", "∶": ":", "‧": "·", "ꞏ": "·", "⋅": "·", "∙": "·", "′": "'", "ʹ": "'", "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "⁃": "-", "․": ".", "‥": "..", "…": "...", "’": "'", "‘": "'", "ʼ": "'", "＇": "'"}

#: Format characters that are drawn; all others of category Cf are invisible.
_DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
#: Kinds of compatibility mappings that keep the look. Raised, lowered, circled, squared and fraction forms don't.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<small>")
#: Ligatures, digraphs and Roman numerals: drawn as the letters they stand for.
_SPELLED = {*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)}


def _look(char: str) -> str:
    """What one canonically decomposed character looks like."""
    code = ord(char)
    if code in _INVISIBLE or unicodedata.category(char) == "Cf" and code not in _DRAWN:
        return ""
    if unicodedata.category(char) == "Zs":
        return " "
    if char in SIGNS:
        return SIGNS[char]
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    mapping = unicodedata.decomposition(char)
    if mapping.startswith(_SAME_LOOK) or mapping.startswith("<compat>") and code in _SPELLED:
        return "".join(_look(chr(int(x, 16))) for x in mapping.split()[1:])
    return char


@cache
def _properties() -> tuple[dict[str, str], re.Pattern[str]]:
    """The looks of characters that don't look like themselves, and a pattern of runs of unstable characters.

    Unstable is a character with another look, a canonical normal form other than itself (quick check "no"), a combining
    class, or the ability to compose with a character before it (quick check "maybe").
    """
    looks: dict[str, str] = {}
    unstable: set[int] = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for code in range(sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0x4E00 <= code <= 0x9FFF or 0x20000 <= code <= 0x2A6DF or 0xD800 <= code <= 0xF8FF or 0x30000 <= code < 0xE0000:
            continue  # Hangul, ideographs, surrogates and private use are stable
        char = chr(code)
        if unicodedata.combining(char):
            unstable.add(code)
        parts = unicodedata.normalize("NFD", char)
        look = unicodedata.normalize("NFC", "".join(map(_look, parts)))
        if look != char:
            looks[char] = look
            unstable.add(code)
        elif len(parts) > 1:
            unstable.add(ord(parts[-1]))
    codes, ranges = sorted(unstable), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return looks, re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]+")


@lru_cache(maxsize=65536)
def _canonical_segment(segment: str) -> str:
    """A boundary character and a run of unstable characters, normalised. Looks may name further ones: until it settles."""
    looks = _properties()[0]
    seen = {segment}
    while True:
        segment = unicodedata.normalize("NFC", "".join(looks.get(c, c) for c in unicodedata.normalize("NFC", segment)))
        if segment in seen:
            return segment
        seen.add(segment)


def canonical_text(text: str | None) -> str | None:
    """The one form of all texts that look like ``text``; null stays null.

    Full- and half-width forms, ligatures, canonical equivalents, kinds of spaces and hyphens, invisible characters and
    look-alike letters of other scripts are brought to one form. Case, accents, digits, raised and lowered signs, line
    breaks and the number of spaces stay as they are. The form of a form is itself.
    """
    if text is None or text.isascii():
        return text
    out, at = [], 0
    for run in _properties()[1].finditer(text):
        start = run.start()
        if start > at:
            out.append(text[at : start - 1])
            out.append(_canonical_segment(text[start - 1 : run.end()]))
        else:
            out.append(_canonical_segment(run.group()))
        at = run.end()
    if not at:
        return text
    out.append(text[at:])
    return "".join(out)


def canonical_column(text: Column) -> Column:
    """:func:`canonical_text` of a string column, in Arrow batches."""
    return F.udf(canonical_text, "string", useArrow=True)(text)


def look_keys(
    rows: DataFrame, id_col: str, text_col: str, media_col: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``id_col``, ``keep``, ``form`` and ``raw``: 128-bit hashes of a text's canonical form and of the text itself.

    Binary text is decoded as ``media_col`` declares. Rows with a null id or text are left out, columns
    not named are ignored. No shuffle: only the hashes leave the scan.
    """
    wanted = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    keep = [id_col, *keep]
    wanted = wanted.select(*keep, text_col, *([media_col] if media_col else []))
    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in keep)
    width = len(keep)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, media = batch.column(width), batch.column(width + 1) if media_col else None
            forms, raws = [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                if media is not None:
                    text = decode(text, media[k].as_py())
                raw = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                form = canonical_text(text)
                raws.append(raw)
                forms.append(raw if form is text else xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(width)], pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], [*keep, "form", "raw"]
            )

    return wanted.mapInArrow(hashes, f"{kinds}, form binary, raw binary")


def same_looks(keys: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """``kinds, id_a, id_b`` (a < b): different ids whose texts look the same but are not the same string.

    ``keys``: ``id, form, raw`` and the columns ``kinds``, one row or more for each text; only texts of one kind are paired.
    Equal strings are one class; classes of one form are paired, and then their members. So a page that was fetched a million times
    unchanged and once with another space gives a million rows and no comparison among the million. Repeated rows count once.
    """
    by = [*kinds, "form"]
    # Read five times below; the hashes are small, the texts behind them are not read again.
    keys = cut_lineage(keys.select("id", *by, "raw").distinct())
    classes = keys.select(*by, "raw").distinct()
    varied = classes.groupBy(*by).agg(F.min("raw").alias("low"), F.max("raw").alias("high")).where("low < high").select(*by)
    several = classes.join(varied, by)
    ties = several.select(*by, F.col("raw").alias("ra")).join(several.select(*by, F.col("raw").alias("rb")), by).where("ra < rb")
    sides = ties.join(keys.select(*by, F.col("raw").alias("ra"), F.col("id").alias("x")), [*by, "ra"]).join(
        keys.select(*by, F.col("raw").alias("rb"), F.col("id").alias("y")), [*by, "rb"]
    )
    return sides.where("x <> y").select(*kinds, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def look_alikes(products: DataFrame, captures: DataFrame) -> DataFrame:
    """``kind, id_a, id_b`` of products by name and of captures by their whole content; see :func:`same_looks`.

    Of repeated deliveries of a capture the one with the latest ``ingested_at`` stands. Null names and contents look like
    nothing. Building it runs one job, which reads both tables and writes the hashes; both kinds are joined together.
    """
    names = look_keys(products, "product_id", "name")
    pages = look_keys(captures, "capture_id", "content", "media_type", ["ingested_at"])
    latest = pages.groupBy("capture_id").agg(F.max(F.struct("ingested_at", "form", "raw")).alias("v"))
    keys = names.select(F.lit("product").alias("kind"), F.col("product_id").alias("id"), "form", "raw").unionByName(
        latest.select(F.lit("capture").alias("kind"), F.col("capture_id").alias("id"), "v.form", "v.raw")
    )
    return same_looks(keys, ["kind"]).select("kind", "id_a", "id_b")
