"""Uploaded papers as a data source: pages in batch and as a stream, from files of any number and size.

    spark.dataSource.register(Scans)
    spark.read.format("scans").option("path", folder).load()
    spark.readStream.format("scans").option("path", folder).load()

Partitions are runs of files of PARTITION bytes, about. A stream's offset is the place of the newest file by (time, path), so a batch that is run again reads the same files. A file that can't be read, or has no text, gives one empty page and never an error. Pages are parted by form feeds; a subclass with another `pages` reads other formats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .sheets import located

PAGES = "doc_id string, page_number int, raw_text string"
#: Bytes of the files of one partition, about.
PARTITION = 32 << 20
FIRST = {"time": -1, "path": ""}


@dataclass
class Files(InputPartition):
    paths: list[str]


def pages(content: bytes) -> list[str]:
    """The pages of a text file; what is no text is one empty page."""
    try:
        return content.decode("utf-8").split("\f")
    except UnicodeDecodeError:
        return [""]


class Folder:
    """The files of a folder in order of (time, path)."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix.lower()

    def files(self) -> list[tuple[int, str, int]]:
        from pyarrow import fs

        store, folder = located(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return sorted((x.mtime_ns or 0, x.path, x.size or 0) for x in found if x.is_file and x.path.lower().endswith(self.suffix) and not x.base_name.startswith((".", "_")))

    def parts(self, files: list[tuple[int, str, int]], most: int = PARTITION) -> list[Files]:
        out, size = [], 0
        for _, path, n in files:
            if not out or size + n > most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out

    def read(self, partition: Files, parse) -> Iterator[tuple[str, int, str]]:
        store, _ = located(self.path)
        for path in partition.paths:
            try:
                with store.open_input_stream(path) as stream:
                    texts = parse(stream.read())
            except Exception:  # noqa: BLE001  any failure of one file costs that file only
                texts = []
            yield from ((path, n, text or "") for n, text in enumerate(texts or [""], 1))


class ScanReader(DataSourceReader):
    def __init__(self, folder: Folder, parse, most: int):
        self.folder, self.parse, self.most = folder, parse, most

    def partitions(self) -> list[Files]:
        return self.folder.parts(self.folder.files(), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        return self.folder.read(partition, self.parse)


class ScanStream(DataSourceStreamReader):
    def __init__(self, folder: Folder, parse, most: int):
        self.folder, self.parse, self.most = folder, parse, most

    def initialOffset(self) -> dict:  # noqa: N802
        return FIRST

    def latestOffset(self) -> dict:  # noqa: N802
        files = self.folder.files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else FIRST

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.folder.parts([f for f in self.folder.files() if low < f[:2] <= high], self.most)

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        return self.folder.read(partition, self.parse)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class Scans(DataSource):
    """The format "scans"; options: path, suffix (of the files' names, in any case; all files without it), partition_bytes."""

    pages = staticmethod(pages)

    @classmethod
    def name(cls) -> str:
        return "scans"

    def schema(self) -> str:
        return PAGES

    def _parts(self) -> tuple:
        return Folder(self.options["path"], self.options.get("suffix", "")), type(self).pages, int(self.options.get("partition_bytes", PARTITION))

    def reader(self, schema) -> ScanReader:
        return ScanReader(*self._parts())

    def streamReader(self, schema) -> ScanStream:  # noqa: N802
        return ScanStream(*self._parts())
