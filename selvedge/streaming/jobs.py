"""Jobs on a stream: each uploaded paper becomes one outcome, a finished record or a zeroed one with the reason, and its state can be asked for.

A micro-batch writes its outcomes as one folder (outcomes/batch=n) and then one line in the manifest (manifest/batch=n), which alone makes them count; a batch that is run again replaces both. A paper that comes again within WITHIN is dropped by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import Shipments
from ..functions.fixed import FIELDS
from ..sources.readers import split_pages

#: How long after a paper the same one (name and content) is held a repeat.
WITHIN = "1 day"
OUTCOME = "job_id string, file string, came timestamp, status string, error string, record string"


def arrived(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of uploaded text files: job_id (a hash of name and content), file, came (when the file was written), content. Empty files are no uploads."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.sha2(F.concat(F.col("path").cast("binary"), F.lit(b"\0"), "content"), 256).alias("job_id"), F.col("path").alias("file"), F.col("modificationTime").alias("came"), "content")


def outcomes_of(jobs: DataFrame, suppliers: DataFrame | None = None) -> DataFrame:
    """An outcome (OUTCOME) for each job (job_id, file, came, content): done with its finished record as JSON, or failed with a reason and a record without values in which every field is to be reviewed. One bad paper costs no other."""
    text = F.when(F.is_valid_utf8("content"), F.col("content").cast("string"))
    reason = F.when(F.octet_length("content") == 0, F.lit("the file is empty")).when(text.isNull(), F.lit("the file is no text")).when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit("no text on any page"))
    known = jobs.withColumns({"error": reason, "value": text})
    pages = split_pages(known.where("error IS NULL").select(F.col("job_id").alias("doc_id"), "value"))
    pages = pages.join(suppliers, "doc_id", "left") if suppliers is not None else pages.withColumn("supplier_name", F.lit(None).cast("string"))
    records = Shipments(pages).result()
    record = records.select(F.col("doc_id").alias("job_id"), F.to_json(F.struct(*[c for c in records.columns if c != "doc_id"])).alias("record"))
    zeroed = F.to_json(F.struct(F.lit("error").alias("mapping_source"), F.lit(",".join(sorted(FIELDS))).alias("flagged_fields")))
    both = known.join(record, "job_id", "left")
    error = F.coalesce("error", F.when(F.col("record").isNull(), F.lit("no record")))
    return both.select("job_id", "file", "came", F.when(error.isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("status"), error.alias("error"), F.when(error.isNull(), F.col("record")).otherwise(zeroed).alias("record"))


def commit(jobs: DataFrame, number: int, store: str) -> None:
    """Write a micro-batch's outcomes and then its line of the manifest. Jobs that the batch holds twice have one outcome; a batch without any writes nothing."""
    if jobs.isEmpty():
        return
    folder = f"{store}/outcomes/batch={number}"
    outcomes_of(jobs.dropDuplicates(["job_id"])).write.mode("overwrite").parquet(folder)
    counts = jobs.sparkSession.read.schema(OUTCOME).parquet(folder).agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"))
    counts.write.mode("overwrite").json(f"{store}/manifest/batch={number}")


def process(arrivals: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Work off what has arrived (job_id, file, came, content), then stop."""
    once = arrivals.withWatermark("came", WITHIN).dropDuplicatesWithinWatermark(["job_id"])
    return once.writeStream.foreachBatch(lambda batch, number: commit(batch, number, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Store:
    """What is known of jobs: the outcomes of batches in the manifest, the newest of each job, without those that were deleted since."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str, kind: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        schema = f"{schema}, batch long"
        return self.spark.read.format(kind).schema(schema).load(folder) if there else self.spark.createDataFrame([], schema)

    def batches(self) -> DataFrame:
        """The manifest: batch, jobs, failed."""
        return self._read("manifest", "jobs long, failed long", "json").select("batch", "jobs", "failed")

    def jobs(self) -> DataFrame:
        """The newest outcome of each job that isn't deleted, with its batch."""
        counted = self._read("outcomes", OUTCOME, "parquet").join(self.batches().select("batch"), "batch", "left_semi")
        columns = [c.split()[0] for c in OUTCOME.split(", ")]
        last = counted.groupBy("job_id").agg(F.max_by(F.struct("batch", *columns[1:]), "batch").alias("last")).select("job_id", "last.*")
        gone = self._read("deleted", "job_id string", "parquet").groupBy("job_id").agg(F.max("batch").alias("gone"))
        return last.join(gone, "job_id", "left").where(F.col("gone").isNull() | (F.col("batch") > F.col("gone"))).select(*columns, "batch")

    def get(self, job_id: str) -> DataFrame:
        """One job's outcome, or no row."""
        return self.jobs().where(F.col("job_id") == job_id)

    def ids(self) -> DataFrame:
        return self.jobs().select("job_id")

    def delete(self, job_ids: DataFrame) -> None:
        """Forget jobs (job_id) as far as the newest batch; one that comes again later is there again. Deleting what isn't there changes nothing."""
        newest = self.batches().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        job_ids.select("job_id").distinct().withColumn("batch", F.lit(newest).cast("long")).write.mode("append").partitionBy("batch").parquet(f"{self.path}/deleted")
