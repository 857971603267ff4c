"""Workbooks as a sink: rows in order stream into one archive for each document, and files get their names when the whole write commits.

    spark.dataSource.register(SheetSink)
    ordered(rows).write.format("sheets").option("path", folder).mode("append").save()

A task holds one open archive and a buffer. It writes under _pending; commit moves what all tasks have written to its place, abort removes it, so a write that fails leaves no workbook. Folders may be in any store that Arrow's file systems reach (a local or mounted path, or a URI).
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .readers import HEADINGS, SHEET, workbook_parts

LETTERS = "ABCDEFGHIJ"
ROWS = "doc_id string, row int, cells map<string,string>"
#: Characters of a sheet that are compressed at once.
BUFFER = 1 << 16


def ordered(rows: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Sheet rows (doc_id, row, and the columns of readers.SHEET) and the cells above them (doc_id, cell, value) as ROWS: a document's rows in one task, in order, its headings among them (row 8)."""
    body = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("row").cast("int").alias("row"), F.create_map(*[F.lit(letter) if k == 0 else F.col(column).cast("string") for letter, column in zip(LETTERS, SHEET, strict=True) for k in (0, 1)]).alias("cells"))
    heads = body.select("doc_id").distinct().select("doc_id", F.lit(8).alias("row"), F.create_map(*[F.lit(x) for pair in zip(LETTERS, HEADINGS, strict=True) for x in pair]).alias("cells"))
    both = body.unionByName(heads)
    if header is not None:
        entry = F.struct(F.substring("cell", 1, 1).alias("letter"), "value")
        both = both.unionByName(header.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.expr("int(substring(cell, 2))").alias("row")).agg(F.map_from_entries(F.collect_list(entry)).alias("cells")))
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "row")


def located(path: str):
    """An Arrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A task's workbooks: where each waits and how it will be called."""

    files: list[tuple[str, str]]


class Archive:
    """A workbook of one sheet that is written row by row."""

    def __init__(self, stream):
        self.stream, self.zip, self.buffer = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), []
        self.size = 0
        before, self.after = workbook_parts()
        for name, content in before.items():
            self.zip.writestr(name, content)
        head, self.tail = self.after
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(head.encode())

    def row(self, number: int, cells: dict[str, str]) -> None:
        text = "".join(f'<c r="{c}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for c, v in sorted(cells.items()))
        self.buffer.append(f'<row r="{number}">{text}</row>')
        self.size += len(text)
        if self.size > BUFFER:
            self.flush()

    def flush(self) -> None:
        self.sheet.write("".join(self.buffer).encode())
        self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.sheet.write(self.tail.encode())
        self.sheet.close()
        self.zip.close()
        self.stream.close()


class SheetWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.pending = path, f"{path.rstrip('/')}/_pending/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, folder = located(self.pending)
        store.create_dir(folder, recursive=True)
        files, archive, current = [], None, None
        for doc_id, number, cells in iterator:
            if archive is None or doc_id != current:
                if archive is not None:
                    archive.close()
                current, waiting = doc_id, f"{folder}/{uuid.uuid4().hex}"
                files.append((waiting, f"{quoted(doc_id)}.xlsx"))
                archive = Archive(store.open_output_stream(waiting))
            archive.row(number, cells)
        if archive is not None:
            archive.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = located(self.path)
        for message in messages:
            for waiting, name in message.files if message else ():
                store.move(waiting, f"{folder.rstrip('/')}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = located(self.pending)
        if store.get_file_info(folder).type.name != "NotFound":
            store.delete_dir(folder)


def quoted(doc_id: str | None) -> str:
    """A document's id as a file's name."""
    from urllib.parse import quote

    return quote(doc_id if doc_id is not None else "null", safe=" ")


class SheetSink(DataSource):
    """The format "sheets" for writing rows of ROWS in order of doc_id and row; option path: the folder of the workbooks."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        if overwrite:
            raise ValueError("workbooks are replaced one by one: use mode append")
        return SheetWriter(self.options["path"])
