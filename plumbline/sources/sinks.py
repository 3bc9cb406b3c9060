"""Sinks: content-addressed stores, keyed overwrites, sheets, and a check of what was written."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import cell_text
from plumbline.operators.sets import multiset_equal


def content_store(rows: DataFrame, content: str) -> DataFrame:
    """``digest, size, payload``: each distinct content once, by SHA-256. Null contents are left out.

    Equal contents are combined where they are read; the digest alone decides, so only one payload each is shuffled.
    """
    keyed = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), F.col(content).cast("binary").alias("payload"))
    return keyed.groupBy("digest").agg(F.first("payload").alias("payload")).select("digest", F.length("payload").alias("size"), "payload")


def write_store(rows: DataFrame, content: str, path: str, digits: int = 2) -> None:
    """Append the contents that a store at ``path`` lacks, in folders by the first digits of the digest."""
    spark = rows.sparkSession
    new = content_store(rows, content).withColumn("prefix", F.substring("digest", 1, digits))
    try:
        known = spark.read.parquet(path).select("digest")
        new = new.join(known, "digest", "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
    new.write.mode("append").partitionBy("prefix").parquet(path)


def replace_keys(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrite only those partitions of a table that ``rows`` holds (delete and insert by key)."""
    spark = rows.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy(partition).parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def write_checked(rows: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write rows as parquet, read them back, and compare both as multisets; the written table, or an error."""
    rows.write.mode(mode).parquet(path)
    back = rows.sparkSession.read.parquet(path)
    if not multiset_equal(rows, back, rows.columns):
        raise RuntimeError(f"what {path} holds differs from what was written")
    return back


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def workbook(sheets: Mapping[str, tuple[Sequence[str], Sequence[Sequence[object]]]]) -> bytes:
    """An XLSX file of sheets of (header, rows), for reports that are small by definition. Numbers stay numbers, null is an
    empty cell, all else is text (see :func:`plumbline.functions.text.cell_text`)."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rels = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        overrides = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{part}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}.sheet.main+xml"/>{overrides}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{kinds}/relationships">{links}</Relationships>')
        for i, (header, rows) in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate([header, *rows], 1):
                cells = []
                for c, v in enumerate(row):
                    at = f"{_letters(c)}{r}"
                    if v is None:
                        continue
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
                    else:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(cell_text(str(v)))}</t></is></c>')
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def dashboard(title: str, tables: Mapping[str, DataFrame], most: int = 200) -> str:
    """An HTML page of small result tables; each shows its first ``most`` rows and says so if there are more."""
    parts = [f"<!doctype html>\n<html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body>\n<h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "\n".join("<tr>" + "".join(f"<td>{'' if v is None else escape(str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
        more = f"<p>Only the first {most} rows are shown.</p>" if len(rows) > most else ""
        parts.append(f"<h2>{escape(name)}</h2>\n<table><tr>{head}</tr>\n{body}\n</table>{more}")
    return "\n".join([*parts, "</body></html>"])


def read_back(content: bytes, sheets: Mapping[str, tuple[Sequence[str], Sequence[Sequence[object]]]]) -> list[str]:
    """What differs between a workbook and the sheets it was made from, cell by cell; empty if nothing does."""
    from plumbline.sources.records import xlsx_rows

    have: dict[tuple[str, int, int], str] = {}
    for sheet, row, cells, _ in xlsx_rows(content):
        have |= {(sheet, row, c): v for c, v in enumerate(cells) if v is not None}
    want = {
        (name[:31], r, c): (repr(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else cell_text(str(v)))
        for name, (header, rows) in sheets.items() for r, row in enumerate([header, *rows], 1) for c, v in enumerate(row) if v is not None
    }
    return [f"{k[0]}!{_letters(k[2])}{k[1]}: {want.get(k)!r} != {have.get(k)!r}" for k in sorted(want.keys() | have.keys()) if want.get(k) != have.get(k)]
