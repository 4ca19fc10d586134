"""Downloaded files as observations: what they really are, their cells as rows, and header and titles found over those.

Spark's binaryFile source reads the bytes. Workbooks are zips of XML: a small reader in the task streams the rows of each sheet
out of them, and so does the csv module for delimited text; rows leave the task as they are read, never a whole sheet. All that
follows (the header, the titles above it, fields, observations) is aggregates and joins over rows.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import Element, iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions.strings import slug
from gleanspark.sources.jsonlists import record_fields, record_lists

# Endings that are read, rows that are searched for a header, characters of titles.
EXTRACTABLE = ("csv", "tsv", "json", "geojson", "xlsx", "xlsm")
HEADER_WITHIN, TITLES = 30, 240
FORMATS = r"[?&](?:format|fmt|type|output)=([A-Za-z]+)"
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])  # built-in number formats that are dates
_BATCH = 1024
_ROW = "file string, sheet int, sheet_name string, row int, cells array<string>"


def extension_of(path: Column) -> Column:
    """The ending of an address's path, or the format that its query names; empty if neither is one that is read."""
    asked = F.lower(F.regexp_extract(path, FORMATS, 1))
    ending = F.lower(F.regexp_extract(F.regexp_replace(path, "[?#].*$", ""), r"\.([A-Za-z0-9]{2,7})$", 1))
    return F.when(asked.isin(*EXTRACTABLE, "pdf"), asked).otherwise(ending)


def refusal(extension: Column, content: Column) -> Column:
    """Why a file isn't read: its ending, or first bytes that belong to something else. Null if it is."""
    start = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^\s+", ""))
    return (
        F.when(~extension.isin(*EXTRACTABLE), "not supported")
        .when(content.isNull() | (F.length(content) == 0), "empty")
        .when(start.rlike("^(?:<!doctype html|<html)"), "a web page")
        .when(extension.isin("xlsx", "xlsm") & (F.hex(F.substring(content, 1, 2)) != "504B"), "not a workbook")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, extension, content, modified, refusal) of the files under a path; globs are allowed, files without a byte are not listed."""
    found = spark.read.format("binaryFile").load(path)
    of = extension_of(F.col("path"))
    return found.select(F.col("path").alias("file"), of.alias("extension"), "content", F.col("modificationTime").alias("modified"), refusal(of, F.col("content")).alias("refusal"))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 with or without a mark, UTF-16 with one, else Latin-1."""
    mark = F.hex(F.substring(content, 1, 2))
    plain = F.regexp_replace(content.cast("string"), "^﻿", "")
    return F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), plain).otherwise(F.decode(content, "ISO-8859-1"))


# --- workbooks


def _local(e: Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in iterparse(f):
            if _local(e) == "si":
                out.append("".join(t.text or "" for t in e.iter() if _local(t) == "t"))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    own, styles = {}, []
    with book.open("xl/styles.xml") as f:
        for _, e in iterparse(f):
            if _local(e) == "numFmt":
                own[int(e.get("numFmtId", 0))] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
            elif _local(e) == "cellXfs":
                styles = [int(x.get("numFmtId", 0)) for x in e if _local(x) == "xf"]
    return [s in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(s, ""), re.I)) for s in styles]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in their order."""
    names, parts = [], {}
    with book.open("xl/workbook.xml") as f:
        for _, e in iterparse(f):
            if _local(e) == "sheet":
                names.append((e.get("name", ""), next((v for k, v in e.attrib.items() if k.endswith("}id")), "")))
    with book.open("xl/_rels/workbook.xml.rels") as f:
        for _, e in iterparse(f):
            if _local(e) == "Relationship":
                parts[e.get("Id")] = e.get("Target", "").lstrip("/")
    found = ((n, parts.get(i, "")) for n, i in names)
    return [(n, p if p.startswith("xl/") else f"xl/{p}") for n, p in found if p]


def _place(ref: str, after: int) -> int:
    letters = re.match("[A-Z]*", ref or "")[0]
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1 if letters else after


def _value(cell: Element, texts: list[str], dates: list[bool]) -> str:
    kind, v = cell.get("t", "n"), next((x.text for x in cell if _local(x) == "v"), None)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t) == "t").strip()
    if v is None or kind == "e":
        return (v or "").strip()
    if kind == "s":
        return texts[int(v)].strip() if int(v) < len(texts) else ""
    if kind == "b":
        return str(v == "1")
    if kind == "n":
        style, number = int(cell.get("s", 0)), float(v)
        if style < len(dates) and dates[style]:
            return str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400)))
        return str(int(number)) if number == int(number) and abs(number) < 1e15 and "." not in v else repr(number)
    return v.strip()


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet, its name, row, cells) of the filled rows of a workbook, as they are read."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts, dates = _texts(book), _date_styles(book)
        for sheet, (name, part) in enumerate(_sheets(book)):
            if part not in book.namelist():
                continue
            with book.open(part) as f:
                n = 0
                for _, e in iterparse(f):
                    if _local(e) != "row":
                        continue
                    n = int(e.get("r", n + 1))
                    cells: list[str] = []
                    for c in e:
                        at = _place(c.get("r", ""), len(cells))
                        cells += [""] * (at - len(cells)) + [_value(c, texts, dates)]
                    if any(cells):
                        yield sheet, name, n, cells
                    e.clear()


def workbook_facts(files: DataFrame) -> DataFrame:
    """(file, title, created, modified_in) of workbooks, as their properties say."""

    @F.arrow_udf("struct<title:string,created:string,modified:string>")
    def of(contents: pa.Array) -> pa.Array:
        out = []
        for c in contents:
            found = {}
            try:
                with zipfile.ZipFile(io.BytesIO(c.as_py())) as book:
                    if "docProps/core.xml" in book.namelist():
                        with book.open("docProps/core.xml") as f:
                            found = {_local(e): (e.text or "").strip() or None for _, e in iterparse(f)}
            except zipfile.BadZipFile:
                pass
            out.append({k: found.get(k) for k in ("title", "created", "modified")})
        return pa.array(out, pa.struct([(k, pa.string()) for k in ("title", "created", "modified")]))

    books = files.where("refusal IS NULL AND extension IN ('xlsx', 'xlsm')")
    return books.select("file", of("content").alias("p")).select("file", "p.title", F.to_date(F.substring("p.created", 1, 10)).alias("created"), F.to_date(F.substring("p.modified", 1, 10)).alias("modified_in"))


# --- rows of files


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "sheet", "sheet_name", "row", "cells"])


def file_rows(files: DataFrame) -> DataFrame:
    """(file, sheet, sheet_name, row, cells) of the filled rows of workbooks and delimited files that aren't refused.

    A broken workbook has the rows that could be read before the fault. The separator of delimited text is the tab of a tsv,
    else whichever of comma, semicolon and tab is most frequent in the first line.
    """

    def books(batches):
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):

                def rows(name=name, content=content):
                    try:
                        yield from ((name, *r) for r in workbook_rows(content.as_py()))
                    except (zipfile.BadZipFile, KeyError, ValueError, SyntaxError):
                        return

                yield from _batches(rows())

    def texts(batches):
        for batch in batches:
            for name, kind, text in zip(*(batch.column(c).to_pylist() for c in ("file", "extension", "text")), strict=True):
                first = text.split("\n", 1)[0]
                mark = "\t" if kind == "tsv" else max(",;\t", key=first.count)
                read = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
                yield from _batches((name, 0, "", i, [c.strip() for c in r]) for i, r in enumerate(read, 1) if any(c.strip() for c in r))

    good = files.where("refusal IS NULL")
    sheets = good.where("extension IN ('xlsx', 'xlsm')").select("file", "content").mapInArrow(books, _ROW)
    plain = good.where("extension IN ('csv', 'tsv')").select("file", "extension", decoded(F.col("content")).alias("text")).mapInArrow(texts, _ROW)
    return sheets.unionByName(plain)


def file_observations(files: DataFrame) -> DataFrame:
    """(file, method, place, fields, context) of tabular files and lists of records in JSON.

    The header of a sheet is its first row with two cells, of the first 30 filled ones, or else the first; single cells above
    it are its titles, and with the sheet's name the context. Columns without a name are column_n, empty cells are left out.
    JSON gives the records of its longest list at any place. Refused files have no rows, nor have sheets of one row.
    """
    rows = file_rows(files)
    filled = F.filter("cells", lambda c: c != "")
    sheet = ["file", "sheet"]
    first = rows.groupBy(*sheet).agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("row") <= 4 * HEADER_WITHIN, F.struct("row", "cells")))), 1, HEADER_WITHIN).alias("top"), F.count("*").alias("rows"), F.min("row").alias("least"))
    full = lambda r: F.filter(r["cells"], lambda c: c != "")
    at = F.coalesce(F.element_at(F.concat(F.transform(F.filter("top", lambda r: F.size(full(r)) >= 2), lambda r: r["row"]), F.array(F.lit(None).cast("int"))), 1), F.col("least"))
    heads = first.where("rows >= 2").select(*sheet, at.alias("header_row"), "top")
    names = F.element_at(F.transform(F.filter("top", lambda r: r["row"] == F.col("header_row")), lambda r: r["cells"]), 1)
    titles = F.substring(F.array_join(F.transform(F.filter("top", lambda r: (r["row"] < F.col("header_row")) & (F.size(full(r)) == 1)), lambda r: full(r)[0]), " "), 1, TITLES)
    heads = heads.select(*sheet, "header_row", names.alias("names"), titles.alias("titles"))
    body = rows.withColumn("filled", filled).join(heads, sheet).where("row > header_row")
    named = F.transform("cells", lambda c, i: F.struct(F.coalesce(F.nullif(slug(F.try_element_at("names", i + 1)), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("name"), c.alias("value")))
    fields = F.filter(named, lambda f: f["value"] != "")
    context = F.array_join(F.filter(F.array("titles", "sheet_name"), lambda x: F.coalesce(x, F.lit("")) != ""), " · ")
    method = F.when(F.col("file").isNotNull() & F.col("sheet_name").isNotNull() & (F.col("sheet_name") != ""), "spreadsheet").otherwise("linked_dataset")
    tabular = body.select("file", method.alias("method"), F.struct(F.col("sheet"), F.col("row")).alias("at"), fields.alias("fields"), context.alias("context"))

    texts = files.where("refusal IS NULL AND extension IN ('json', 'geojson')").select("file", decoded(F.col("content")).alias("json"))
    told = record_fields(record_lists(texts, "file", through_lists=True, least=1, common=1), "file")
    records = told.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("fields"))
    listed = records.select("file", F.lit("structured_data").alias("method"), F.struct(F.lit(0).alias("sheet"), F.col("item").alias("row")).alias("at"), "fields", F.lit("").alias("context"))
    every = tabular.unionByName(listed).where(F.size("fields") > 0)
    return every.select("file", "method", F.col("at.sheet").alias("sheet"), F.col("at.row").alias("place"), "fields", "context")
