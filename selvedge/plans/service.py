"""Queries on what the service shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import FIELDS
from ..operators import pages, service
from ..sources.rendered import PAPERS, frame, quoted
from ..streaming import jobs
from .registry import query


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("job_log", """WITH m AS (SELECT user_id AS job_id, event_id AS ord, 0 AS last, concat(event_type, '  ', event_id) AS msg FROM events UNION ALL SELECT DISTINCT user_id, 0, 1, 'DONE' FROM events)
    SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY last, ord) AS INTEGER) AS seq, msg FROM m""")
def job_log(spark, sf_dir):
    return service.job_log(events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), F.concat("event_type", F.lit("\n"), F.col("event_id").cast("string")).alias("msg")))


@query("file_name", "SELECT s_suppkey, concat('packing_list_', s_name, '_', substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8), '.xlsx') AS name FROM supplier")
def file_name(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", service.file_name(F.col("s_name"), F.md5(F.col("s_suppkey").cast("string"))).alias("name"))


@query("prompt_text", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Extract the header and all rolls.' ELSE concat('Continue with part ', event_id % 3 + 1, ' of 3: only rolls.') END || chr(10) || chr(10) || props AS prompt FROM events")
def prompt_text(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", service.prompt((F.col("event_id") % 3).cast("int"), F.lit(3), F.col("props")).alias("prompt"))


@query("failed_records", f"SELECT DISTINCT user_id AS job_id, 'error' AS mapping_source, CAST(0.0 AS DOUBLE) AS confidence, '{','.join(sorted(FIELDS))}' AS flagged_fields, 'failed' AS error FROM events WHERE event_type = 'error'")
def failed_records(spark, sf_dir):
    return service.failed_records(events(spark, sf_dir).where("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.lit("failed").alias("error")).distinct())


@query("action_rename", "SELECT event_id, CASE event_type WHEN 'view' THEN 'confirm' WHEN 'click' THEN 'reassign' WHEN 'error' THEN 'not_present' ELSE event_type END AS action FROM events")
def action_rename(spark, sf_dir):
    shown = F.col("event_type")
    for ours, theirs in (("view", "accept"), ("click", "edit"), ("error", "remove")):
        shown = F.when(F.col("event_type") == ours, F.lit(theirs)).otherwise(shown)
    return events(spark, sf_dir).select("event_id", service.renamed_action(shown).alias("action"))


@query("template_codec", "SELECT s_suppkey, s_name AS lot, concat('[\"', s_name, '\"]') AS stored, 'plain' AS quality FROM supplier")
def template_codec(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", service.encoded(F.create_map(F.lit("lot"), "s_name")).alias("stored"))
    back = service.decoded(F.map_concat(F.col("stored"), F.create_map(F.lit("quality"), F.lit("plain"))))
    return rows.select("s_suppkey", back["lot"].alias("lot"), F.col("stored")["lot"].alias("stored"), back["quality"].alias("quality"))


@query("free_models", "SELECT concat('m', s_suppkey) AS model FROM supplier WHERE s_nationkey % 2 = 0")
def free_models(spark, sf_dir):
    price = F.when(F.col("s_nationkey") % 2 == 0, F.lit("0")).otherwise(F.lit("0.001"))
    json = F.to_json(F.struct(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.struct(price.alias("prompt")).alias("pricing")))
    return service.free_models(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(json.alias("json")))


@query("ocr_coalesce", """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS raw_text, CASE WHEN doc_id % 8 = 0 THEN 'tiny' ELSE concat('direct text of page ', doc_id, ' at length') END AS direct, CASE WHEN doc_id % 16 = 0 THEN '' ELSE concat('image of ', doc_id) END AS image FROM documents),
    f AS (SELECT *, CASE WHEN length(direct) > 20 THEN direct ELSE image END AS ocr, length(trim(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g'))) < 20 AS needs FROM p)
    SELECT doc_id, CASE WHEN needs AND length(ocr) > 0 THEN 'item_table' ELSE 'scanned' END AS page_type, CASE WHEN needs AND length(ocr) > 0 THEN ocr ELSE raw_text END AS raw_text FROM f""")
def ocr_coalesce(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.col("doc_id")
    own = docs.select("doc_id", F.lit(1).alias("page_number"), F.lit("scanned").alias("page_type"), F.when(key % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("raw_text"))
    number = key.cast("string")
    found = docs.select("doc_id", F.lit(1).alias("page_number"), F.when(key % 8 == 0, F.lit("tiny")).otherwise(F.concat(F.lit("direct text of page "), number, F.lit(" at length"))).alias("direct_text"), F.when(key % 16 == 0, F.lit("")).otherwise(F.concat(F.lit("image of "), number)).alias("image_text"))
    return pages.ocr_filled(own, found).select("doc_id", "page_type", "raw_text")


#: Messages of users as logs of jobs; a purchase is the end of one. Silences are counted in hours here, since these events are hours apart.
DUCK_MESSAGES = "SELECT user_id AS job_id, epoch_us(ts) AS at, event_id AS ord, CASE event_type WHEN 'purchase' THEN 'DONE' ELSE event_type END AS msg FROM events"
HOURS = 6 * 3600


def messages(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "purchase", F.lit(service.DONE)).otherwise(F.col("event_type")).alias("msg"))


@query("log_sessions", quoted(f"""WITH m AS ({DUCK_MESSAGES}), b AS (SELECT *, coalesce(lag(msg) OVER w = 'DONE' OR at - lag(at) OVER w >= {HOURS}000000, true) AS begins FROM m WINDOW w AS (PARTITION BY job_id ORDER BY at, ord, msg)),
    s AS (SELECT *, count(*) FILTER (WHERE begins) OVER (PARTITION BY job_id ORDER BY at, ord, msg ROWS UNBOUNDED PRECEDING) AS n FROM b)
    SELECT job_id, min(at) AS started, max(at) AS ended, count(*) AS messages, CASE WHEN bool_or(msg = 'DONE') THEN 'done' ELSE 'silent' END AS end FROM s GROUP BY job_id, n"""))
def log_sessions(spark, sf_dir):
    """Sessions of each job's log, ended by DONE or by silence."""
    return service.log_sessions(messages(spark, sf_dir), HOURS)


@query("log_keepalives", quoted(f"""WITH m AS ({DUCK_MESSAGES}), f AS (SELECT job_id, min((at, ord)) AS done FROM m WHERE msg = 'DONE' GROUP BY job_id), r AS (SELECT m.job_id, at, msg, lead(at) OVER (PARTITION BY m.job_id ORDER BY at, ord) AS next FROM m LEFT JOIN f ON f.job_id = m.job_id WHERE done IS NULL OR (at, ord) <= done)
    SELECT job_id, at, msg FROM r UNION ALL SELECT job_id, unnest(range(at + {HOURS}000000, next, {HOURS}000000)), NULL FROM r"""))
def log_keepalives(spark, sf_dir):
    """What a follower of each job's log is sent, with a sign of life in each silence."""
    return service.keepalives(messages(spark, sf_dir), HOURS)


@query("job_outcomes", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, CASE WHEN o_orderkey % 7 < 3 THEN 'failed' ELSE 'done' END AS status, CASE o_orderkey % 7 WHEN 0 THEN 'the file is empty' WHEN 1 THEN 'the file is no text' WHEN 2 THEN 'no text on any page' END AS error, CASE WHEN o_orderkey % 7 < 3 THEN 'error' ELSE 'regex' END AS mapping_source,
    CASE WHEN o_orderkey % 7 >= 3 THEN concat('INV/', o_custkey) END AS invoice_number FROM orders""")
def job_outcomes(spark, sf_dir):
    """An outcome for each paper, bad ones among them."""
    key = F.col("doc_id") % 7
    content = F.when(key == 0, F.unhex(F.lit(""))).when(key == 1, F.unhex(F.lit("FFFE"))).when(key == 2, F.lit(" \n\f ").cast("binary")).otherwise(F.col("raw_text").cast("binary"))
    papers = frame(spark, sf_dir, PAPERS).select(F.col("doc_id").cast("string").alias("job_id"), F.lit("paper").alias("file"), F.lit(None).cast("timestamp").alias("came"), content.alias("content"))
    found = jobs.outcomes_of(papers)
    return found.select("job_id", "status", "error", F.get_json_object("record", "$.mapping_source").alias("mapping_source"), F.get_json_object("record", "$.invoice_number").alias("invoice_number"))
