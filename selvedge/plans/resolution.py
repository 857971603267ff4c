"""Queries on evidence. The events table stands in for it: a user is a document, an event's type its field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS, HEADER_PRIORITY, TABLE_FIELDS, TABLE_PRIORITY
from ..operators import evidence as E
from ..sources.rendered import duck, frame
from .registry import query

EVIDENCE = """
    SELECT user_id AS doc_id,
           CASE event_type WHEN 'view' THEN 'lot' WHEN 'signup' THEN 'po_number' WHEN 'error' THEN 'net_weight' WHEN 'click' THEN 'invoice_number' ELSE 'color' END AS field,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('v', CAST(event_id % 7 AS STRING)) END AS value,
           CAST(CASE event_id % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 ELSE 0.9 END AS DOUBLE) AS confidence,
           CASE (event_id * 7) % 5 WHEN 0 THEN 'template' WHEN 1 THEN 'regex' WHEN 2 THEN 'ai' WHEN 3 THEN 'table_col' ELSE 'text_pattern' END AS source,
           CAST(event_id % 3 AS INT) AS page_number, event_id AS ord
    FROM {events}
"""


def _cases(column: str, values: dict, default: str = "0") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


PRIO = f"CASE WHEN field IN {TABLE_FIELDS} THEN {_cases('source', TABLE_PRIORITY)} ELSE {_cases('source', HEADER_PRIORITY)} END"
TOP1 = f"WITH ev AS ({duck(EVIDENCE)}), won AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, {PRIO} DESC, ord) AS n FROM ev WHERE value IS NOT NULL)"
FIELD_ROWS = ", ".join(f"('{f}')" for f in FIELDS)
RESOLVED = TOP1 + f", resolved AS (SELECT d.doc_id, f.field, value, coalesce(source, 'none') AS source, coalesce(confidence, 0.0) AS confidence FROM (SELECT DISTINCT doc_id FROM ev) d CROSS JOIN (VALUES {FIELD_ROWS}) f(field) LEFT JOIN (SELECT * FROM won WHERE n = 1) w ON w.doc_id = d.doc_id AND w.field = f.field)"
SCORE = "CASE WHEN value IS NULL THEN 0.0 WHEN source = 'ai' THEN greatest(0.0, least(1.0, confidence)) WHEN source = 'template' THEN 0.95 WHEN source = 'regex' THEN 0.90 WHEN source = 'table_col' THEN 0.88 ELSE 0.0 END"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, EVIDENCE)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = evidence(spark, sf_dir)
    return E.resolve_all(ev, ev)


@query("evidence_union", f"WITH ev AS ({duck(EVIDENCE)}) SELECT source, field, count(*) AS n, count(value) AS n_values, CAST(sum(page_number) AS BIGINT) AS pages FROM ev WHERE value IS NOT NULL OR source NOT IN ('template', 'ai') GROUP BY source, field")
def evidence_union(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    parts = {source: ev.where(F.col("source") == source).drop("source") for source in E.ORDER}
    return E.union(**parts).groupBy("source", "field").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.sum("page_number").alias("pages"))


@query("resolve_top1", TOP1 + " SELECT doc_id, field, value, source, confidence, page_number FROM won WHERE n = 1")
def resolve_top1(spark, sf_dir):
    return E.top1(evidence(spark, sf_dir)).select("doc_id", "field", "value", "source", "confidence", "page_number")


@query("resolve_all", RESOLVED + " SELECT doc_id, field, value, source, CAST(confidence AS DOUBLE) AS confidence FROM resolved")
def resolve_all(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("confidence_score", RESOLVED + f" SELECT doc_id, field, source, CAST({SCORE} AS DOUBLE) AS score FROM resolved")
def confidence_score(spark, sf_dir):
    return resolved(spark, sf_dir).select("doc_id", "field", "source", E.score(F.col("value"), F.col("source"), F.col("confidence")).alias("score"))


@query("flag_fields", RESOLVED + f" SELECT doc_id, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE {SCORE} < 0.85), '') AS flagged_fields FROM resolved GROUP BY doc_id")
def flag_fields(spark, sf_dir):
    scored = resolved(spark, sf_dir).withColumn("confidence", E.score(F.col("value"), F.col("source"), F.col("confidence")))
    return E.flagged(scored)


@query("candidates_top5", f"""WITH ev AS ({duck(EVIDENCE)}), firsts AS (SELECT doc_id, field, value, min(ord) AS ord FROM ev WHERE value IS NOT NULL GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY ord) AS n FROM firsts)
    SELECT doc_id, field, string_agg(value, '|' ORDER BY ord) AS candidates FROM numbered WHERE n <= 5 GROUP BY doc_id, field""")
def candidates_top5(spark, sf_dir):
    return E.candidates(evidence(spark, sf_dir))


@query("all_candidates", RESOLVED + """, every AS (SELECT doc_id, field, value, 0 AS now FROM ev WHERE value IS NOT NULL UNION ALL SELECT doc_id, field, value, 1 FROM resolved WHERE value IS NOT NULL)
    SELECT doc_id, field, CASE field WHEN 'lot' THEN 'Lot' WHEN 'po_number' THEN 'Po Number' WHEN 'net_weight' THEN 'Net Weight' WHEN 'invoice_number' THEN 'Invoice Number' ELSE 'Color' END AS label, value, max(now) = 1 AS is_confirmed FROM every GROUP BY doc_id, field, value""")
def all_candidates(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    return E.all_candidates(ev, E.resolve_all(ev, ev))


@query("missing_fields", RESOLVED + f""", places(field, k) AS (VALUES {", ".join(f"('{f}', {k})" for k, f in enumerate(FIELDS))})
    SELECT doc_id, coalesce(string_agg(field, ',' ORDER BY k) FILTER (WHERE value IS NULL), '') AS missing, bool_and(value IS NOT NULL OR field NOT IN ('lot', 'po_number')) AS complete FROM resolved JOIN places USING (field) GROUP BY doc_id""")
def missing_fields(spark, sf_dir):
    return E.found_and_missing(resolved(spark, sf_dir), ("lot", "po_number"))


@query("response_projection", RESOLVED + f" SELECT doc_id, field AS name, value, CAST(round({SCORE} * 100) AS INTEGER) AS confidence, CASE WHEN source = 'none' THEN 'regex' ELSE 'ai' END AS mapping_source, 'complete' AS status FROM resolved")
def response_projection(spark, sf_dir):
    return E.response(resolved(spark, sf_dir))


STATUS = f"CASE WHEN {SCORE} >= 0.85 THEN 'auto' WHEN {SCORE} >= 0.60 THEN 'review' ELSE 'flag' END"


@query("review_status", RESOLVED + f" SELECT doc_id, field, {STATUS} AS review, {STATUS} = 'auto' AS actioned FROM resolved")
def review_status(spark, sf_dir):
    scored = E.score(F.col("value"), F.col("source"), F.col("confidence"))
    return resolved(spark, sf_dir).select("doc_id", "field", E.review(scored).alias("review"), (E.review(scored) == "auto").alias("actioned"))


@query("submit_gate", RESOLVED + f" SELECT doc_id, bool_and({STATUS} <> 'flag') AS can_submit, count(*) FILTER (WHERE {STATUS} = 'flag') AS n_flagged, count(*) FILTER (WHERE {STATUS} = 'auto') AS n_actioned FROM resolved GROUP BY doc_id")
def submit_gate(spark, sf_dir):
    scored = E.score(F.col("value"), F.col("source"), F.col("confidence"))
    return E.submit_gate(resolved(spark, sf_dir).withColumn("review", E.review(scored)))


@query("confirmed_count", RESOLVED + " SELECT doc_id, count(value) AS confirmed_count FROM resolved GROUP BY doc_id")
def confirmed_count(spark, sf_dir):
    return E.confirmed_count(resolved(spark, sf_dir))


@query("chip_split", "WITH i AS (SELECT DISTINCT user_id AS doc_id, CASE event_type WHEN 'view' THEN 'lot' WHEN 'signup' THEN 'po_number' ELSE event_type END AS name FROM events) SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE name IN ('lot', 'po_number')), '') AS fields, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE name NOT IN ('lot', 'po_number')), '') AS unidentified FROM i GROUP BY doc_id")
def chip_split(spark, sf_dir):
    name = F.when(F.col("event_type") == "view", F.lit("lot")).when(F.col("event_type") == "signup", F.lit("po_number")).otherwise(F.col("event_type"))
    return E.chips(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), name.alias("name"), F.lit(None).cast("string").alias("value")))
