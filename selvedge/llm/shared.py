"""Reading tables, the cluster's shared folder, and small helpers that several operators use."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch, in place of the session's default of 64 MB: what a task holds outside its heap, and its Python worker.
ARROW_BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once for each application, so that their Python workers can import it; and where the session has the default size of Arrow batches, make it ARROW_BATCH."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH))
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "selvedge"), "zip", root, "selvedge")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a local one is set on a single machine, as in tests; on a cluster that is an error. What is written there is scratch, to be deleted with the folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: cuts the lineage, and survives lost executors. Zstandard works on the heap, where Snappy's buffers outside of it wait for the collector."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, removed by Spark when no frame refers to it. What earlier rounds have shuffled goes too: Spark drops it when the driver's collector finds it unused, so the collector is asked to look."""
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


#: Ids that may be sent to every task: 8 bytes each.
BROADCAST_IDS = 1_000_000


def ids_for_join(ids: DataFrame) -> DataFrame:
    """A frame of distinct ids, marked to be sent to every task if it has BROADCAST_IDS rows at most; else it is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def row_key(df: DataFrame, *columns: str) -> Column:
    """A 64-bit hash of some columns, never null: rows that differ in them have different keys, but for chance (of 10 million different rows, two share a key in about 3 cases of a million)."""
    return F.xxhash64(*[x for c in columns for x in (df[c].isNull(), df[c])])


def row_keys(df: DataFrame, *columns: str) -> tuple[Column, Column]:
    """key_1 and key_2, 128 bits of some columns, never null: among 10**11 different rows, two share both in about one case of 10**17."""
    parts = [x for c in columns for x in (df[c].isNull(), df[c])]
    return F.xxhash64(*parts).alias("key_1"), F.xxhash64(F.lit(1), *parts).alias("key_2")


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever case their names are told apart by."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += " own"
    return name


#: Copies of one row that one array holds, and beyond which they are dealt to several tasks.
COPIES = 10_000


def copies(df: DataFrame, first: str, n: str, number: str) -> DataFrame:
    """Each row n times, numbered from first on; the columns first and n go. Rows of more than COPIES copies are cut into parts that are dealt to tasks before they become rows. The frame is read twice, so it should be written or cheap."""
    others = [c for c in df.columns if c not in (first, n)]
    whole = lambda frame: frame.select(*others, F.explode(F.sequence(F.col(first).cast("long"), (F.col(first) + F.col(n) - 1).cast("long"))).alias(number))
    begin, part = unused("begin", df), unused("part", df)
    many = df.where(F.col(n) > COPIES).select("*", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col(n) - 1) / COPIES).cast("long"))).alias(part))
    many = many.withColumn(begin, F.col(first) + F.col(part) * COPIES).withColumn(n, F.least(F.lit(COPIES), F.col(n) - F.col(part) * COPIES)).drop(first, part).withColumnRenamed(begin, first)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return whole(df.where(F.col(n) <= COPIES)).unionByName(whole(many.repartition(spread, F.col(first))))


def rows_at_most(df: DataFrame, bound: int) -> list:
    """Collect a frame that has no more rows than a proven bound."""
    rows = df.collect()
    if len(rows) > bound:
        raise ValueError(f"{len(rows)} rows, more than {bound}")
    return rows


def sample_at_most(sample: DataFrame, bound: int, key: str = "doc_id") -> pa.Table:
    """A written sample on the driver, in order of the key. If one key has so many rows that they exceed twice the bound, the rest of the rows by the key's hash is left out."""
    if sample.count() > 2 * bound + 1000:
        sample = sample.orderBy(F.xxhash64(key)).limit(2 * bound)
    return sample.toArrow().sort_by(key).combine_chunks()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return pc.fill_null(batch.column(name), "").to_pylist()


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and more columns), whatever else the frame holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def batches_by_bytes(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one holds about `most` bytes of a string column (or one row that is longer)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        if at < batch.num_rows:
            yield batch.slice(at)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups from batches that come in order of the keys, with the places where the groups begin. A group that goes on in the next batch waits for it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        changed = np.zeros(table.num_rows - 1, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed |= values[1:] != values[:-1]
        begins = [0, *(np.flatnonzero(changed) + 1).tolist()]
        rest = table.slice(begins[-1])
        if len(begins) > 1:
            yield table.slice(0, begins[-1]), begins[:-1]
    if rest is not None and rest.num_rows:
        yield rest, [0]
