"""Data sources: scans in batch and as a stream, workbooks that are there whole or not at all."""

import os
import re
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from selvedge.sources import readers, scans, sheets


@pytest.fixture(scope="module", autouse=True)
def _sources(spark):
    spark.dataSource.register(scans.Scans)
    spark.dataSource.register(sheets.SheetSink)


def write_files(folder, names):
    folder.mkdir(exist_ok=True)
    for k, (name, content) in enumerate(names.items()):
        (folder / name).write_bytes(content)
        os.utime(folder / name, ns=(10**18 + k * 10**9, 10**18 + k * 10**9))


FILES = {"a.txt": b"one\ftwo", "b.TXT": b"\xff\xfe", "c.txt": b"", "d.pdf": b"no", "_e.txt": b"hidden", "f.txt": "été".encode()}
PAGES = {("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.TXT", 1, ""), ("c.txt", 1, ""), ("f.txt", 1, "été")}


def pages_of(frame):
    return {(r.doc_id.rsplit("/", 1)[1], r.page_number, r.raw_text) for r in frame.collect()}


def test_batch_and_stream_agree(spark, tmp_path):
    folder = tmp_path / "in"
    write_files(folder, dict(list(FILES.items())[:3]))
    source = lambda reader: reader.format("scans").options(path=str(folder), suffix=".txt", partition_bytes="8").load()
    stream = lambda: source(spark.readStream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    stream()
    write_files(folder, FILES)
    stream()
    stream()
    assert source(spark.read).rdd.getNumPartitions() > 1
    got = spark.read.parquet(str(tmp_path / "out"))
    assert pages_of(source(spark.read)) == pages_of(got) == PAGES and got.count() == len(PAGES)
    assert spark.read.format("scans").option("path", str(tmp_path / "nowhere")).load().count() == 0


def rows_of(spark, docs, n):
    return spark.range(docs * n).select((F.col("id") % docs).cast("string").alias("doc_id"), (F.col("id") / docs + 9).cast("int").alias("row"), *[F.concat(F.lit(f"{c} <"), "id").alias(c) for c in readers.SHEET])


def test_workbooks_by_the_sink(spark, tmp_path):
    header = spark.createDataFrame([("0", "A3", "No:"), ("0", "B3", "7")], "doc_id string, cell string, value string")
    sheets.ordered(rows_of(spark, 3, 50), header).write.format("sheets").option("path", str(tmp_path)).mode("append").save()
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_file()) == ["0.xlsx", "1.xlsx", "2.xlsx"] and not any((tmp_path / "_pending").iterdir())
    expected = {r.doc_id: bytes(r.content) for r in readers.workbooks(rows_of(spark, 3, 50), header).collect()}
    for doc_id, content in expected.items():
        (tmp_path / "other.zip").write_bytes(content)
        ours, theirs = zipfile.ZipFile(tmp_path / f"{doc_id}.xlsx"), zipfile.ZipFile(tmp_path / "other.zip")
        assert {n: ours.read(n) for n in ours.namelist()} == {n: theirs.read(n) for n in theirs.namelist()}


def test_failed_write_leaves_no_file(spark, tmp_path):
    rows = rows_of(spark, 4, 20).withColumn("row", F.when((F.col("doc_id") == "2") & (F.col("row") == 25), F.raise_error(F.lit("broken"))).otherwise(F.col("row")))
    with pytest.raises(Exception, match="broken"):
        sheets.ordered(rows).write.format("sheets").option("path", str(tmp_path)).mode("append").save()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_long_sheets_take_little_memory(tmp_path):
    """A sheet of a million rows, by one task's writer."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    cells = {c: "some text" for c in sheets.LETTERS}
    writer = sheets.SheetWriter(str(tmp_path))
    message = writer.write(("d/1", k, cells) for k in range(9, 1_000_009))
    writer.commit([message, None])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB
    with zipfile.ZipFile(tmp_path / "d%2F1.xlsx") as archive, archive.open("xl/worksheets/sheet1.xml") as sheet:
        count = 0
        while block := sheet.read(1 << 22):
            count += len(re.findall(rb"<row ", block))
        assert 999_990 <= count <= 1_000_000  # a mark may be cut by a block
