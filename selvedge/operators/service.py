"""What a service around the pipeline shows: job logs, names of files, prompts for an extractor, records of failed jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS

#: Names of actions in the reviewers' interface and in the store.
ACTION_NAMES = {"accept": "confirm", "edit": "reassign", "remove": "not_present"}
DONE = "DONE"
#: Seconds after which a silent log gets a sign of life.
SILENT_AFTER = 30


def renamed_action(x: Column) -> Column:
    out = x
    for shown, stored in ACTION_NAMES.items():
        out = F.when(x == shown, F.lit(stored)).otherwise(out)
    return out


def job_log(messages: DataFrame) -> DataFrame:
    """Messages (job_id, ord, msg) as each job's log: numbered from 1, on one line each, closed by DONE."""
    lines = messages.select("job_id", "ord", F.lit(0).alias("last"), F.replace("msg", F.lit("\n"), F.lit("  ")).alias("msg"))
    ends = messages.select("job_id").distinct().select("job_id", F.lit(0).cast("long").alias("ord"), F.lit(1).alias("last"), F.lit(DONE).alias("msg"))
    order = Window.partitionBy("job_id").orderBy("last", "ord")
    return lines.unionByName(ends).select("job_id", F.row_number().over(order).alias("seq"), "msg")


def log_sessions(messages: DataFrame, silence: int = SILENT_AFTER) -> DataFrame:
    """Messages (job_id, at in microseconds, ord, msg) as sessions: job_id, started and ended (first and last message), messages, end (done or silent). A session ends with a DONE message, or before a silence of so many seconds; messages of one time are in order of ord, then msg."""
    order = Window.partitionBy("job_id").orderBy("at", "ord", "msg")
    rows = messages.withColumns({"before": F.lag("at").over(order), "msg_before": F.lag("msg").over(order)})
    begins = F.col("before").isNull() | (F.col("msg_before") == DONE) | (F.col("at") - F.col("before") >= silence * 1_000_000)
    rows = rows.withColumn("session", F.count_if(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.bool_or(F.coalesce(F.col("msg") == DONE, F.lit(False))), F.lit("done")).otherwise(F.lit("silent"))
    return rows.groupBy("job_id", "session").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("messages"), end.alias("end")).drop("session")


def keepalives(messages: DataFrame, silence: int = SILENT_AFTER) -> DataFrame:
    """job_id, at and msg of what a follower of each job's log is sent: its messages on one line each and, for each `silence` seconds without any, a sign of life (msg null); nothing after DONE. Each silence is filled from its own two ends."""
    order = Window.partitionBy("job_id").orderBy("at", "ord", "msg")
    gap = silence * 1_000_000
    rows = messages.withColumns({"next": F.lead("at").over(order), "over": F.count_if(F.coalesce(F.col("msg") == DONE, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, -1))})
    rows = rows.where("over = 0")
    quiet = F.when(F.coalesce(F.col("msg") != DONE, F.lit(True)) & (F.col("next") - F.col("at") > gap), F.sequence(F.col("at") + gap, F.col("next") - 1, F.lit(gap)))
    signs = rows.select("job_id", F.explode(quiet).alias("at"), F.lit(None).cast("string").alias("msg"))
    return rows.select("job_id", "at", F.replace("msg", F.lit("\n"), F.lit("  ")).alias("msg")).unionByName(signs)


def file_name(supplier: Column, job_id: Column) -> Column:
    return F.concat(F.lit("packing_list_"), supplier, F.lit("_"), F.substring(job_id, 1, 8), F.lit(".xlsx"))


def prompt(chunk: Column, n_chunks: Column, content: Column) -> Column:
    """The request for a chunk: the first asks for the header too."""
    head = F.when(chunk == 0, F.lit("Extract the header and all rolls.")).otherwise(F.format_string("Continue with part %d of %d: only rolls.", chunk + 1, n_chunks))
    return F.concat(head, F.lit("\n\n"), content)


def failed_records(jobs: DataFrame) -> DataFrame:
    """The record of each failed job (job_id, error): no values, confidence 0, every field to be reviewed."""
    return jobs.select("job_id", F.lit("error").alias("mapping_source"), F.lit(0.0).alias("confidence"), F.lit(",".join(sorted(FIELDS))).alias("flagged_fields"), "error")


def encoded(values: Column) -> Column:
    """A template's values as JSON text, one for each field."""
    return F.transform_values(values, lambda k, v: F.to_json(F.array(v)))


def decoded(values: Column) -> Column:
    """Back again; what is no JSON stays as it is."""
    return F.transform_values(values, lambda k, v: F.coalesce(F.get(F.from_json(v, "array<string>"), F.lit(0)), v))


def free_models(models: DataFrame) -> DataFrame:
    """Models (JSON: id, pricing.prompt) that ask nothing for a prompt."""
    return models.where(F.get_json_object("json", "$.pricing.prompt") == "0").select(F.get_json_object("json", "$.id").alias("model"))
