"""Record files: CSV with row numbers, JSON with numbers as written, XLSX without a library, URL lists."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Mapping
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.urls import canonical_url_column

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def project(values: Column, columns: Mapping[str, str] | None = None) -> list[Column]:
    """``fields`` and ``specs`` of a string map: keys renamed by ``columns``; keys behind ``spec:`` are specs, nulls dropped."""
    named = values
    if columns:
        known = F.create_map(*[F.lit(x) for pair in columns.items() for x in pair])
        named = F.transform_keys(values, lambda k, v: F.coalesce(F.try_element_at(known, k), k))  # noqa: ARG005
    kept = F.map_filter(named, lambda k, v: v.isNotNull())  # noqa: ARG005
    fields = F.map_filter(kept, lambda k, v: ~k.startswith("spec:"))  # noqa: ARG005
    specs = F.transform_keys(F.map_filter(kept, lambda k, v: k.startswith("spec:")), lambda k, v: F.substr(k, F.lit(6)))  # noqa: ARG005
    return [fields.alias("fields"), specs.alias("specs")]


def read_csv(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, by_line: bool = True) -> DataFrame:
    """``path, locator, fields, specs`` of CSV files with a header, all values text, a byte order mark removed.

    With ``by_line`` files are parsed whole, one task each, so that quoted line breaks are right and rows have numbers
    (``csv:row:2`` is the first). Without, Spark splits large files and rows have no number.
    """
    if not by_line:
        df = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
        values = F.create_map(*[x for c in df.columns for x in (F.lit(c.lstrip("﻿")), F.col(f"`{c}`"))])
        return df.select(F.input_file_name().alias("path"), F.lit(None).cast("string").alias("locator"), *project(values, columns))

    def rows(content: bytes) -> list[tuple[int, dict[str, str]]]:
        import csv

        reader = csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
        return [(n, {k: v for k, v in row.items() if k is not None and isinstance(v, str)}) for n, row in enumerate(reader, 2)]

    parsed = F.udf(rows, "array<struct<n:int,row:map<string,string>>>", useArrow=True)("content")
    files = spark.read.format("binaryFile").load(path).select("path", F.inline(parsed))
    return files.select("path", F.concat(F.lit("csv:row:"), "n").alias("locator"), *project(F.col("row"), columns))


def read_json(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """``path, locator, fields, specs`` of JSON files: a list, the list under ``items`` or ``products``, or one object.

    Numbers are kept as they are written; values that are no scalars are left out.
    """
    def rows(content: bytes) -> list[tuple[int, dict[str, str]]]:
        import json

        try:
            data = json.loads(content.decode("utf-8-sig"), parse_float=str, parse_int=str)
        except ValueError:
            return []
        if isinstance(data, dict):
            data = next((data[k] for k in ("items", "products") if isinstance(data.get(k), list)), [data])
        text = lambda v: v if isinstance(v, str) else "true" if v is True else "false"
        return [(n, {k: text(v) for k, v in row.items() if isinstance(v, (str, bool))}) for n, row in enumerate(data) if isinstance(row, dict)]

    parsed = F.udf(rows, "array<struct<n:int,row:map<string,string>>>", useArrow=True)("content")
    files = spark.read.format("binaryFile").load(path).select("path", F.inline(parsed))
    return files.select("path", F.concat(F.lit("json:item:"), "n").alias("locator"), *project(F.col("row"), columns))


def xlsx_rows(content: bytes) -> list[tuple[str, int, list[str | None], list[bool]]]:
    """(sheet, row number, cell texts, formula without a cached value) of a workbook; an unreadable file has none."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out = []
    for name, target in sheets:
        tree = ElementTree.fromstring(book.read("xl/" + target.lstrip("/").removeprefix("xl/")))
        for row in tree.iter(f"{_NS}row"):
            cells: list[str | None] = []
            missing: list[bool] = []
            for c in row.iter(f"{_NS}c"):
                letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                at = 0
                for ch in letters:
                    at = at * 26 + ord(ch) - 64
                while len(cells) < at - 1:
                    cells.append(None)
                    missing.append(False)
                v, kind = c.find(f"{_NS}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif kind == "s" and v is not None:
                    text = shared[int(v.text)]
                else:
                    text = None if v is None else v.text
                cells.append(text)
                missing.append(c.find(f"{_NS}f") is not None and v is None)
            out.append((name, int(row.get("r") or len(out) + 1), cells, missing))
    return out


def read_xlsx(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """``path, locator, fields, specs, uncached`` of workbooks: the first row of a sheet names the columns.

    ``uncached`` lists the columns with a formula that has no stored value; they have no field.
    """
    def rows(content: bytes) -> list[tuple[str, dict[str, str], list[str]]]:
        out, header, sheet = [], [], None
        for name, n, cells, missing in xlsx_rows(content):
            if name != sheet:
                sheet, header = name, [c or "" for c in cells]
                continue
            values = {h: c for h, c in zip(header, cells, strict=False) if h and c is not None}
            lost = [h for h, m in zip(header, missing, strict=False) if h and m]
            if values or lost:
                out.append((f"xlsx:{name}:{n}", values, lost))
        return out

    parsed = F.udf(rows, "array<struct<locator:string,row:map<string,string>,uncached:array<string>>>", useArrow=True)("content")
    files = spark.read.format("binaryFile").load(path).select("path", F.inline(parsed))
    return files.select("path", "locator", *project(F.col("row"), columns), "uncached")


def url_list(entries: DataFrame, entry: str = "entry", position: str = "position") -> DataFrame:
    """``position, entry, url, status``: each entry with its canonical URL and whether it is ``accepted``, a ``duplicate`` of an
    earlier one, or ``invalid``. Blank entries and comments (``#``) are left out."""
    from pyspark.sql.window import Window

    kept = entries.select(position, F.trim(entry).alias("entry")).where((F.col("entry") != "") & ~F.col("entry").startswith("#"))
    named = kept.withColumn("url", canonical_url_column(F.col("entry")))
    first = F.row_number().over(Window.partitionBy("url").orderBy(position)) == 1
    status = F.when(F.col("url").isNull(), "invalid").when(first, "accepted").otherwise("duplicate")
    # Invalid entries have no URL in common; they are kept out of the window so that they are no one key.
    good = named.where(F.col("url").isNotNull()).withColumn("status", status)
    return good.unionByName(named.where(F.col("url").isNull()).withColumn("status", F.lit("invalid"))).select(position, "entry", "url", "status")
