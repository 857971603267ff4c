"""The pipeline as streams: page texts in, records out; reviewers' corrections folded into templates; admission of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import feedback, fields
from ..sources.readers import classified, split_pages


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """A stream of text files, a form feed between pages."""
    files = spark.readStream.format("text").option("wholetext", "true").load(path)
    return split_pages(files.select(F.col("_metadata.file_path").alias("doc_id"), "value"))


def extracted(pages: DataFrame) -> DataFrame:
    """Each document's field values from its pages, in batch or in a micro-batch: a document arrives whole, in one file."""
    return fields.by_document(classified(pages).where(~F.col("needs_ocr")))


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Read what has arrived, write records as Parquet, stop. A batch that is repeated after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        extracted(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return incoming(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def learn(actions: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of reviewers' actions to a log of changes, a folder for each batch: log/batch=n. A batch is read alone, so work follows the batch and not the suppliers; a repeated one replaces its own folder."""

    def fold(batch: DataFrame, number: int) -> None:
        feedback.changes(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return actions.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


LOG = "supplier_name string, field string, value string, at long, seq long, n long"


def changes(spark: SparkSession, log: str) -> DataFrame:
    """The changes of a log: those of the newest compaction (compact=n, which stands for the batches up to n) and of later batches. A batch or compaction without a finished write isn't read."""
    newest = max(_numbers(spark, log, "compact"), default=-1)
    paths = [f"{log}/batch={n}" for n in _numbers(spark, log, "batch") if n > newest] + ([f"{log}/compact={newest}"] if newest >= 0 else [])
    if not paths:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(*paths).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))


def compact(spark: SparkSession, log: str) -> None:
    """Write the log's last changes as one compaction; earlier batches stay for versions over time, and aren't read for templates any more."""
    newest = max(_numbers(spark, log, "batch"), default=-1)
    if newest >= 0:
        feedback.compacted(changes(spark, log)).write.mode("overwrite").parquet(f"{log}/compact={newest}")


def history(spark: SparkSession, log: str) -> DataFrame:
    """All changes of all batches."""
    paths = [f"{log}/batch={n}" for n in _numbers(spark, log, "batch")]
    return (spark.read.schema(LOG).parquet(*paths) if paths else spark.createDataFrame([], LOG)).drop("n")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of folders name=n whose write has finished, listed by the file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found.getFileSystem(conf).globStatus(found) or ())
