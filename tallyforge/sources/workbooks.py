"""Workbooks and documents as rows. Containers are opened inside tasks, one file each."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes that a part of a container may unpack to.
PART_BYTES = 64 << 20


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > PART_BYTES:
        raise ValueError("part too large")
    return ElementTree.fromstring(z.read(name))


def _cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every filled cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in _part(z, "xl/sharedStrings.xml").iter(f"{_SHEET}si")] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for c in _part(z, name).iter(f"{_SHEET}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                value = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                if text is not None:
                    yield name.rsplit("/", 1)[1], int(row), column, shared[int(text)] if c.get("t") == "s" else text


def workbook_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, col, text, problem) of every filled cell of XLSX files (path, content); an unreadable file gives one row with its problem."""
    schema = "path string, sheet string, row int, col int, text string, problem string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(path, *cell, None) for cell in _cells(content)]
                except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, ElementTree.ParseError) as e:
                    rows = [(path, None, None, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "text", "problem"]).astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(read, schema)


def headed_rows(cells: DataFrame, aliases: dict[str, list[str]], required: int = 2) -> DataFrame:
    """Table rows under header rows: a row with ``required`` header names starts a table, whose columns hold until the next one.

    ``aliases`` lists the spellings of each field. Returns path, sheet, row and one column a field.
    """
    names = {a.lower(): f for f, spellings in aliases.items() for a in (f, *spellings)}
    known = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    marked = cells.where("problem is null").withColumn("field", known[F.lower(F.trim("text"))])
    headers = marked.where("field is not null").groupBy("path", "sheet", F.col("row").alias("head")).agg(F.count("*").alias("n")).where(F.col("n") >= required)
    spans = headers.withColumn("until", F.lead("head").over(Window.partitionBy("path", "sheet").orderBy("head")))
    named = marked.where("field is not null").select("path", "sheet", F.col("row").alias("head"), "col", "field")
    columns = named.join(spans.drop("n"), ["path", "sheet", "head"])
    body = marked.drop("field").join(columns, ["path", "sheet", "col"]).where("row > head and (until is null or row < until)")
    return body.groupBy("path", "sheet", "row").agg(*[F.max(F.when(F.col("field") == f, F.trim("text"))).alias(f) for f in aliases])


def price_book(rows: DataFrame) -> DataFrame:
    """Price rows with the book's version and approval: it is approved if it has entries and all of them are, its version the distinct ones joined by +."""
    book = rows.groupBy("path").agg(F.bool_and(F.coalesce(F.lower("approved").isin("true", "yes", "1"), F.lit(False))).alias("book_approved"), F.array_join(F.array_sort(F.collect_set("version")), "+").alias("book_version"))
    return rows.join(book, "path")


def document_blocks(files: DataFrame) -> DataFrame:
    """(path, block, kind, text): paragraphs and table rows (cells joined by tabs) of DOCX files, in order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        body = _part(z, "word/document.xml").find(f"{_WORD}body")
                    n = 0
                    for child in body:
                        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
                        found = [("row", "\t".join(text(c) for c in r.iter(f"{_WORD}tc"))) for r in child.iter(f"{_WORD}tr")] if child.tag == f"{_WORD}tbl" else [("paragraph", text(child))]
                        for kind, t in found:
                            rows.append((path, n, kind, t))
                            n += 1
                except (zipfile.BadZipFile, KeyError, ValueError, AttributeError, ElementTree.ParseError) as e:
                    rows.append((path, None, "problem", type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "block", "kind", "text"]).astype({"block": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path string, block int, kind string, text string")


def merged_specs(specs: DataFrame, identity: list[str], locator: str) -> DataFrame:
    """One spec for each identity, nulls being values, with all its locators."""
    return specs.groupBy(*identity).agg(F.array_sort(F.collect_set(locator)).alias("locators"), F.count("*").alias("mentions"))


def row_associations(texts: DataFrame, scope: list[str], code_pattern: str) -> DataFrame:
    """Texts on the baseline of a code: |dy| within max(.5, min(2 median height, 2.5 of the code's height)), right of it, nearest first.

    Texts have id, x, y, h and text. A text belongs to the nearest code on its left on the same baseline. They meet in bands of y as high as the
    greatest reach: a text in its own, a code in three.
    """
    heights = texts.groupBy(*scope).agg(F.median("h").alias("mh"))
    banded = texts.join(heights, scope).withColumn("__band", F.floor(F.col("y") / F.greatest(F.lit(0.5), 2 * F.col("mh"))))
    steps = F.explode(F.array(*[F.col("__band") + i for i in (-1, 0, 1)]))
    seeds = banded.where(F.col("text").rlike(code_pattern)).select(*scope, F.col("id").alias("seed"), F.col("text").alias("code"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("h").alias("sh"), steps.alias("__band"))
    pairs = banded.join(seeds, [*scope, "__band"])
    near = (F.abs(F.col("y") - F.col("sy")) <= F.greatest(F.lit(0.5), F.least(2 * F.col("mh"), 2.5 * F.col("sh")))) & (F.col("x") > F.col("sx"))
    best = pairs.where(near).groupBy(*scope, "id", "text", "x").agg(F.min(F.struct((F.col("x") - F.col("sx")).alias("d"), "seed", "code")).alias("b"))
    order = Window.partitionBy(*scope, "b.seed").orderBy("x", "id")
    return best.select(*scope, F.col("b.seed").alias("seed"), F.col("b.code").alias("code"), "id", "text", F.row_number().over(order).alias("position"))


def text_repairs(texts: DataFrame, file: str, text: str, reading: str) -> DataFrame:
    """Texts with ``repaired``: in files with at least 3 non-ASCII texts, of which max(3, 70 %) have a UTF-8 reading, that reading; elsewhere the text.

    ``reading`` is the column with the strict reading or null (see ``utf8_reading``).
    """
    foreign = F.col(text).rlike(r"[^\x00-\x7F]")
    counts = texts.groupBy(file).agg(F.count_if(foreign).alias("__n"), F.count_if(foreign & F.col(reading).isNotNull()).alias("__good"))
    active = (F.col("__n") >= 3) & (F.col("__good") >= F.greatest(F.lit(3), F.ceil(F.col("__n") * 0.7)))
    return texts.join(counts, file).withColumn("repaired", F.when(active, F.coalesce(reading, text)).otherwise(F.col(text))).drop("__n", "__good")


def image_assets(files: DataFrame) -> DataFrame:
    """(path, member, bytes, sha256) of the images in workbooks; the table of assets is keyed by the digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, n, z.getinfo(n).file_size, hashlib.sha256(z.read(n)).hexdigest()) for n in z.namelist() if n.startswith("xl/media/")]
                except zipfile.BadZipFile:
                    rows.append((path, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "member", "bytes", "sha256"])

    return files.select("path", "content").mapInPandas(read, "path string, member string, bytes long, sha256 string")
