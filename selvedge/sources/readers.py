"""Inputs: uploaded files, page texts, templates; and the sink of sheets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import known_supplier
from ..operators.pages import kind, needs_ocr

PAGES = "doc_id string, page_number int, raw_text string"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: doc_id (their path), content; only PDF names (any case) and files that aren't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").endswith(".pdf") & (F.col("length") > 0)).select(F.col("path").alias("doc_id"), "content")


def parsed_pages(files: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages of uploaded files by a parser (content to one text for each page). A file that it can't read has no pages. No PDF library is part of this package."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                try:
                    texts = parser(bytes(content))
                except Exception:  # noqa: BLE001  any failure of a foreign parser costs that file only
                    texts = []
                rows += [(doc_id, n, text or "") for n, text in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "raw_text"])

    return files.mapInPandas(run, PAGES)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from text files with a form feed between pages; doc_id is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return split_pages(files)


def split_pages(files: DataFrame) -> DataFrame:
    pages = files.select("doc_id", F.posexplode(F.split("value", "\f")).alias("n", "raw_text"))
    return pages.select("doc_id", (F.col("n") + 1).alias("page_number"), "raw_text")


def classified(pages: DataFrame) -> DataFrame:
    """Pages with needs_ocr and page_type; scanned pages lose their scraps of text. Takes has_tables where the frame has it."""
    has_tables = F.col("has_tables") if "has_tables" in pages.columns else F.lit(False)
    scanned = needs_ocr(F.col("raw_text"))
    return pages.withColumn("page_type", kind(F.coalesce("raw_text", F.lit("")), has_tables)).withColumn("needs_ocr", scanned).withColumn("raw_text", F.when(scanned, F.lit("")).otherwise(F.col("raw_text")))


def with_supplier(docs: DataFrame, name: str = "supplier_name") -> DataFrame:
    """Blank suppliers become "unknown"."""
    return docs.withColumn(name, F.when(known_supplier(F.col(name)), F.trim(name)).otherwise(F.lit("unknown")))


SHEET = ("lot_no", "po", "shade", "roll_no", "length_mts", "length_yds", "points_per_roll", "points_per_100m2", "weight_gross", "weight_nett")
HEADINGS = ("LOT No", "PO #", "Shade", "Roll No", "Length (mts)", "Length (yds)", "Total Points /Roll", "Points / 100m2", "Weight (Gross kgs)", "Weight (Nett kgs)")


def workbook_parts() -> tuple[dict[str, str], tuple[str, str]]:
    """The files of a workbook of one sheet, without the sheet, and what stands before and after the sheet's rows."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    space = "http://schemas.openxmlformats.org"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets><sheet name="Packing List" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    return parts, (f'{head}<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>")


def workbook(rows: list[tuple[int, dict[str, str]]]) -> bytes:
    """A workbook of one sheet: rows of (number, cells by column letter, in order), all as text."""

    def cell(column: str, number: int, value: str) -> str:
        return f'<c r="{column}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    sheet = "".join(f'<row r="{n}">{"".join(cell(c, n, v) for c, v in cells.items())}</row>' for n, cells in rows)
    parts, (before, after) = workbook_parts()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in (parts | {"xl/worksheets/sheet1.xml": f"{before}{sheet}{after}"}).items():
            archive.writestr(name, content)
    return out.getvalue()


def workbooks(rows: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """doc_id and content (a workbook) of each document from its sheet rows (doc_id, row, and the columns of SHEET) and the cells above them (doc_id, cell, value), if given. A document is one group: it has as many rows as it has rolls."""
    letters = "ABCDEFGHIJ"
    both = rows.select("doc_id", "row", F.create_map(*[F.lit(letter) if k == 0 else F.col(column) for letter, column in zip(letters, SHEET, strict=True) for k in (0, 1)]).alias("cells"))
    if header is not None:
        entry = F.struct(F.substring("cell", 1, 1).alias("letter"), "value")
        both = both.unionByName(header.groupBy("doc_id", F.expr("int(substring(cell, 2))").alias("row")).agg(F.map_from_entries(F.collect_list(entry)).alias("cells")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lines = [(8, dict(zip(letters, HEADINGS, strict=True))), *((int(n), dict(sorted(cells.items()))) for n, cells in zip(frame["row"], frame["cells"], strict=True))]
        return pd.DataFrame({"doc_id": [str(frame["doc_id"].iloc[0])], "content": [workbook(sorted(lines, key=lambda line: line[0]))]})

    return both.groupBy("doc_id").applyInPandas(run, "doc_id string, content binary")
