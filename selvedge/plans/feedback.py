"""Queries on review, templates, model answers and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import FIELDS, SUPPLIER_COLUMNS
from ..operators import checks, feedback, rates, responses, tables
from ..sources.rendered import dealt, duck, frame, quoted
from .registry import query
from .rolls import SUMMARY, WITH_ROLLS, rolls
from ..operators import rolls as R

#: Events as reviewers' actions: a user is a job, and every sixth one a supplier.
ACTIONS = """SELECT user_id AS job_id, event_id AS seq, concat('sup', CAST(user_id % 40 AS STRING)) AS supplier_name, CASE event_type WHEN 'view' THEN 'lot' WHEN 'signup' THEN 'po_number' WHEN 'error' THEN 'net_weight' WHEN 'click' THEN 'no_such_field' ELSE 'color' END AS field,
    CASE event_id % 4 WHEN 0 THEN 'not_present' WHEN 1 THEN 'confirm' ELSE 'reassign' END AS action, concat('v', CAST(event_id % 9 AS STRING)) AS value FROM {events}"""
WITH_ACTIONS = f"WITH actions AS ({duck(ACTIONS)})"


def actions(spark, sf_dir):
    return frame(spark, sf_dir, ACTIONS)


def base_values(acts):
    return acts.select("job_id").distinct().select("job_id", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field"), F.lit("old").alias("value"))


@query("apply_actions", WITH_ACTIONS + f""", base AS (SELECT job_id, field, 'old' AS value FROM (SELECT DISTINCT job_id FROM actions) CROSS JOIN (VALUES {", ".join(f"('{f}')" for f in FIELDS)}) f(field)),
    last AS (SELECT job_id, field, arg_max(action, seq) AS action, max(seq) AS seq FROM actions WHERE field <> 'no_such_field' GROUP BY job_id, field)
    SELECT b.job_id, b.field, CASE WHEN l.action IS NULL THEN b.value WHEN l.action = 'not_present' THEN NULL ELSE a.value END AS value, l.action FROM base b LEFT JOIN last l ON b.job_id = l.job_id AND b.field = l.field LEFT JOIN actions a ON a.seq = l.seq""")
def apply_actions(spark, sf_dir):
    acts = actions(spark, sf_dir)
    return feedback.applied(base_values(acts), acts)


@query("corrections_fold", WITH_ACTIONS + """, used AS (SELECT * FROM actions WHERE action <> 'not_present'), last AS (SELECT supplier_name, field, arg_max(value, seq) AS value, count(*) AS n FROM used GROUP BY supplier_name, field), counts AS (SELECT supplier_name, CAST(sum(n) AS BIGINT) AS correction_count FROM last GROUP BY supplier_name)
    SELECT supplier_name, field, value, correction_count FROM last JOIN counts USING (supplier_name)""")
def corrections_fold(spark, sf_dir):
    return feedback.corrections(actions(spark, sf_dir)).select("supplier_name", F.explode("fields").alias("field", "value"), "correction_count")


OLD_TEMPLATES = "SELECT concat('sup', CAST(s_suppkey AS STRING)) AS supplier_name, CASE s_suppkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS schema_version, CAST(s_nationkey AS BIGINT) AS correction_count, s_name AS old_lot FROM {supplier} WHERE s_suppkey % 2 = 0"


def old_templates(spark, sf_dir):
    return frame(spark, sf_dir, OLD_TEMPLATES).withColumn("fields", F.create_map(F.lit("lot"), "old_lot", F.lit("quality"), F.lit("Q"))).drop("old_lot")


@query("template_upsert", WITH_ACTIONS + f""", old AS ({duck(OLD_TEMPLATES)}), used AS (SELECT * FROM actions WHERE action <> 'not_present'), new AS (SELECT supplier_name, field, arg_max(value, seq) AS value FROM used GROUP BY supplier_name, field), counts AS (SELECT supplier_name, count(*) AS n FROM used GROUP BY supplier_name),
    long_old AS (SELECT supplier_name, 'lot' AS field, old_lot AS value FROM old UNION ALL SELECT supplier_name, 'quality', 'Q' FROM old), merged AS (SELECT supplier_name, field, coalesce(n.value, o.value) AS value FROM long_old o FULL JOIN new n USING (supplier_name, field))
    SELECT b.supplier_name, field, value, '2' AS schema_version, CAST(coalesce(old.correction_count, 0) + coalesce(n, 0) AS BIGINT) AS correction_count FROM merged b LEFT JOIN old USING (supplier_name) LEFT JOIN counts USING (supplier_name)""")
def template_upsert(spark, sf_dir):
    merged = feedback.upserted(old_templates(spark, sf_dir), feedback.corrections(actions(spark, sf_dir)))
    return merged.select("supplier_name", F.explode("fields").alias("field", "value"), "schema_version", "correction_count")


@query("template_lookup", f"WITH old AS ({duck(OLD_TEMPLATES)}) SELECT c_custkey AS doc_id, concat('sup', c_custkey % 120) AS supplier_name, old_lot AS lot FROM customer LEFT JOIN old ON old.supplier_name = concat('sup', c_custkey % 120) AND coalesce(schema_version, '1') = '2'")
def template_lookup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("sup"), (F.col("c_custkey") % 120).cast("string")).alias("supplier_name"))
    return feedback.lookup(docs, old_templates(spark, sf_dir)).select("doc_id", "supplier_name", F.col("fields")["lot"].alias("lot"))


@query("suppliers_list", f"WITH old AS ({duck(OLD_TEMPLATES)}) SELECT DISTINCT supplier_name FROM old WHERE supplier_name NOT IN (SELECT concat('sup', CAST(user_id % 40 AS VARCHAR)) FROM events WHERE event_type = 'error')")
def suppliers_list(spark, sf_dir):
    deleted = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").select(F.concat(F.lit("sup"), (F.col("user_id") % 40).cast("string")).alias("supplier_name"))
    return feedback.suppliers(old_templates(spark, sf_dir), deleted)


@query("template_from_records", f"{WITH_ROLLS}, s AS ({SUMMARY}), r AS (SELECT doc_id AS seq, concat('sup', doc_id % 40) AS supplier_name, CASE WHEN doc_id % 3 = 0 THEN lot END AS lot, po_number, CASE WHEN doc_id % 2 = 0 THEN color END AS color, CASE WHEN doc_id % 5 <> 0 THEN quality END AS quality FROM s), f AS (SELECT *, (lot IS NOT NULL)::INT + (po_number IS NOT NULL)::INT + (color IS NOT NULL)::INT + (quality IS NOT NULL)::INT AS n FROM r), l AS (SELECT *, row_number() OVER (PARTITION BY supplier_name ORDER BY seq DESC) AS k FROM f WHERE n >= 3) SELECT supplier_name, lot, po_number, color, quality, CASE seq % 2 WHEN 0 THEN 'roll_level' ELSE 'lot_level' END AS doc_type FROM l WHERE k = 1")
def template_from_records(spark, sf_dir):
    own = R.summary(rolls(spark, sf_dir))
    key = F.col("doc_id")
    values = {"lot": F.when(key % 3 == 0, F.col("lot")), "po_number": F.col("po_number"), "color": F.when(key % 2 == 0, F.col("color")), "quality": F.when(key % 5 != 0, F.col("quality"))}
    records = own.select(key.alias("seq"), F.concat(F.lit("sup"), (key % 40).cast("string")).alias("supplier_name"), *[values.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS], F.when(key % 2 == 0, F.lit("roll_level")).otherwise(F.lit("lot_level")).alias("doc_type"))
    return feedback.templates_from(records).select("supplier_name", *[F.col("fields")[f].alias(f) for f in values], "doc_type")


#: Model answers made of rolls: fenced, in a list, or cut off, by doc_id.
def answers_of(spark, sf_dir):
    roll = F.struct("seq", F.struct(F.lpad(F.col("seq").cast("string"), 4, "0").alias("roll_no"), F.floor("meters").alias("length_mts")).alias("roll"))
    listed = F.transform(F.array_sort(F.collect_list(roll)), lambda x: x["roll"])
    answer = F.struct(F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("packing_list_no"), F.count("*").alias("net_weight_kg"), listed.alias("rolls"))
    return rolls(spark, sf_dir).groupBy("doc_id").agg(F.to_json(answer).alias("json"))


@query("json_repair", f"{WITH_ROLLS} SELECT doc_id, concat('P', doc_id) AS packing_list_no, CASE WHEN doc_id % 4 = 3 THEN count(*) - 1 ELSE count(*) END AS n_rolls, CAST(coalesce(sum(floor(meters)) FILTER (WHERE doc_id % 4 <> 3 OR seq < n), 0) AS DOUBLE) AS meters FROM (SELECT *, max(seq) OVER (PARTITION BY doc_id) AS n FROM rolls) WHERE doc_id % 4 <> 3 OR n > 1 GROUP BY doc_id")
def json_repair(spark, sf_dir):
    key, text = F.col("doc_id"), F.col("json")
    damaged = F.when(key % 4 == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(key % 4 == 2, F.concat(F.lit("["), text, F.lit("]"))).when(key % 4 == 3, F.expr("substring(json, 1, length(json) - 5)")).otherwise(text)
    answers = answers_of(spark, sf_dir).select("doc_id", responses.parsed(damaged).alias("answer")).where(F.col("answer").isNotNull())
    meters = F.aggregate(F.col("answer.rolls"), F.lit(0.0), lambda a, r: a + F.coalesce(r["length_mts"], F.lit(0.0)))
    return answers.select("doc_id", F.col("answer.packing_list_no").alias("packing_list_no"), F.size("answer.rolls").cast("long").alias("n_rolls"), meters.alias("meters")).where("n_rolls > 0")


@query("extractor_fallback", f"{WITH_ROLLS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS used, count(*) AS n_rolls FROM rolls GROUP BY doc_id")
def extractor_fallback(spark, sf_dir):
    answers = answers_of(spark, sf_dir)
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("no answer")).otherwise(F.col("json"))
    picked = answers.select("doc_id", responses.parsed(first).alias("a"), responses.first_answer(first, F.col("json")).alias("answer"))
    return picked.select("doc_id", F.when(F.col("a").isNull(), F.lit("second")).otherwise(F.lit("first")).alias("used"), F.size("answer.rolls").cast("long").alias("n_rolls"))


@query("merge_chunks", f"{WITH_ROLLS} SELECT CAST(doc_id - doc_id % 3 AS BIGINT) AS doc_id, arg_min(concat('P', doc_id), doc_id) AS packing_list_no, count(*) AS n_rolls, string_agg(lpad(CAST(seq AS VARCHAR), 4, '0'), ',' ORDER BY doc_id, seq) AS roll_nos FROM rolls GROUP BY doc_id - doc_id % 3 HAVING min(doc_id) % 3 = 0")
def merge_chunks(spark, sf_dir):
    key = F.col("doc_id")
    answers = answers_of(spark, sf_dir).select((key - key % 3).alias("doc_id"), (key % 3).alias("chunk"), responses.parsed(F.col("json")).alias("answer"))
    lines = responses.merged(answers)
    return lines.select("doc_id", F.col("header.packing_list_no").alias("packing_list_no"), F.size("rolls").cast("long").alias("n_rolls"), F.array_join(F.transform("rolls", lambda r: r["roll_no"]), ",").alias("roll_nos"))


DUCK_REQUESTS = "SELECT user_id AS key, epoch_us(ts) AS ts, event_id FROM events"


def requests(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id")


@query("rate_window", f"WITH r AS ({DUCK_REQUESTS}) SELECT key, ts, event_id, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS last_minute, count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS last_day FROM r")
def rate_window(spark, sf_dir):
    return rates.in_window(requests(spark, sf_dir))


@query("rate_admission", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM ({DUCK_REQUESTS})),
    walk(key, n, event_id, ts, kept, admitted) AS (
        SELECT key, 1::BIGINT, event_id, ts, [ts], true FROM r WHERE n = 1
        UNION ALL
        SELECT key, n, event_id, ts, CASE WHEN ok THEN list_append(still, ts) ELSE still END, ok
        FROM (SELECT *, len(still) < 2 AND len(list_filter(still, lambda t: t >= ts - {rates.MINUTE})) < 1 AS ok
              FROM (SELECT r.*, list_filter(kept, lambda t: t >= r.ts - {rates.DAY}) AS still FROM walk w JOIN r ON r.key = w.key AND r.n = w.n + 1)))
    SELECT key, ts, event_id, admitted FROM walk""")
def rate_admission(spark, sf_dir):
    return rates.admission(requests(spark, sf_dir), per_minute=1, per_day=2)


RAW = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN '-3' WHEN 1 THEN '1,200.5' WHEN 2 THEN 'abc' WHEN 3 THEN '0' END AS meters, CASE o_orderkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '12' ELSE '1.5' END AS pieces, CASE o_orderkey % 7 WHEN 0 THEN '-1' ELSE '5' END AS net_weight FROM {orders}"


@query("validate_rules", f"WITH r AS ({duck(RAW)}) SELECT doc_id, concat_ws('; ', CASE WHEN meters IN ('-3', '0') THEN 'meters must be > 0' END, CASE WHEN pieces = '0' THEN 'pieces must be > 0' END, CASE WHEN net_weight = '-1' THEN 'net_weight cannot be negative' END) AS errors FROM r")
def validate_rules(spark, sf_dir):
    return frame(spark, sf_dir, RAW).select("doc_id", F.array_join(checks.rule_errors(F.col("meters"), F.col("pieces"), F.col("net_weight")), "; ").alias("errors"))


DATED = f"SELECT *, CASE doc_id % 4 WHEN 0 THEN '2024-13-01' WHEN 1 THEN '01/02/2024' WHEN 2 THEN '2024-02-30' END AS delivered_date FROM ({RAW})"


@query("validate_all", f"WITH r AS ({duck(DATED)}) SELECT doc_id, concat_ws('; ', CASE doc_id % 4 WHEN 0 THEN 'month or day' WHEN 1 THEN 'not ISO' END, CASE WHEN meters IN ('-3', '0') THEN 'meters must be > 0' END, CASE WHEN pieces = '0' THEN 'pieces must be > 0' END, CASE WHEN net_weight = '-1' THEN 'net_weight cannot be negative' END) AS errors FROM r")
def validate_all(spark, sf_dir):
    errors = checks.all_errors(*[F.col(c) for c in ("delivered_date", "meters", "pieces", "net_weight")])
    return frame(spark, sf_dir, DATED).select("doc_id", F.array_join(errors, "; ").alias("errors"))


@query("quarantine", f"WITH r AS ({duck(RAW)}) SELECT doc_id, CASE WHEN meters = 'abc' THEN 'meters' ELSE '' END AS quarantine FROM r")
def quarantine(spark, sf_dir):
    from ..functions.text import coerced

    rows = frame(spark, sf_dir, RAW)
    records = rows.select("doc_id", F.col("meters").alias("meters_text"), coerced(F.col("meters")).alias("meters"), F.col("pieces").alias("pieces_text"), coerced(F.col("pieces"), whole=True).alias("pieces"))
    return checks.quarantined(records, {"meters": "meters_text", "pieces": "pieces_text"}).select("doc_id", "quarantine")


#: Every heading that any of the known suppliers has, and some that none has.
ALL_HEADINGS = sorted({h.upper() for names in SUPPLIER_COLUMNS.values() for h in names} | {"UPCE NO", "CTN NO", "WIDTH (INCH)", "FBN"})
KNOWN_ROWS = ", ".join(f"('{code}', '{h.upper()}', '{f}')" for code, names in SUPPLIER_COLUMNS.items() for h, f in names.items())


@query("supplier_columns", f"WITH known(code, heading, field) AS (VALUES {KNOWN_ROWS}) SELECT s_suppkey, heading, field FROM supplier JOIN known ON code = CASE s_suppkey % 3 WHEN 0 THEN 'AML' WHEN 1 THEN 'PEN' ELSE 'SFM' END")
def supplier_columns(spark, sf_dir):
    key = F.col("s_suppkey")
    code = F.when(key % 3 == 0, F.lit("AML")).when(key % 3 == 1, F.lit("PEN")).otherwise(F.lit("SFM"))
    every = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", code.alias("code"), F.explode(F.array(*[F.lit(h) for h in ALL_HEADINGS])).alias("heading"))
    return tables.known_columns(every).select("s_suppkey", "heading", "field")


#: Orders as confirmed values of 40 suppliers over time, and as papers that came some weeks later.
SUPPLIERS, FIELD_OF = 40, ("lot", "color", "quality")
AT = "CAST(datediff(o_orderdate, DATE '1992-01-01') AS BIGINT) * 86400000000"
DUCK_AT = "CAST(date_diff('day', DATE '1992-01-01', o_orderdate) AS BIGINT) * 86400000000"
LOG = "SELECT concat('S', CAST(o_custkey % 40 AS STRING)) AS supplier_name, CASE o_orderkey % 3 WHEN 0 THEN 'lot' WHEN 1 THEN 'color' ELSE 'quality' END AS field, concat('v', CAST(o_orderkey AS STRING)) AS value, {at} AS at, o_orderkey AS seq FROM {orders} WHERE o_orderkey % 4 = 0"
PAPERS_CAME = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE concat('S', CAST(o_custkey % 40 AS STRING)) END AS supplier_name, {at} + 20 * 86400000000 AS at FROM {orders}"
_ASOF = "ASOF LEFT JOIN (SELECT supplier_name, at, arg_max(value, seq) AS value FROM log WHERE field = '{f}' GROUP BY supplier_name, at) {f} ON {f}.supplier_name = p.supplier_name AND {f}.at <= p.at"


@query("template_at_time", quoted(f"WITH log AS ({duck(LOG.replace('{at}', DUCK_AT))}), p AS ({duck(PAPERS_CAME.replace('{at}', DUCK_AT))}) SELECT doc_id, {', '.join(f'{f}.value AS {f}' for f in FIELD_OF)} FROM p {' '.join(_ASOF.replace('{f}', f) for f in FIELD_OF)}"))
def template_at_time(spark, sf_dir):
    """The values of the supplier's template that were in force when each paper came."""
    over_time = feedback.versions(frame(spark, sf_dir, LOG.replace("{at}", AT)))
    found = feedback.lookup_at(frame(spark, sf_dir, PAPERS_CAME.replace("{at}", AT)), over_time)
    return found.select("doc_id", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in FIELD_OF])


@query("template_log", quoted(f"WITH log AS ({duck(LOG.replace('{at}', DUCK_AT))}), last AS (SELECT supplier_name, field, arg_max(value, (at, seq)) AS value, count(*) AS n FROM log GROUP BY ALL) SELECT supplier_name, string_agg(concat(field, '=', value), ',' ORDER BY field) AS template, sum(n)::BIGINT AS correction_count FROM last GROUP BY supplier_name"))
def template_log(spark, sf_dir):
    """Templates from a compacted log of the earlier changes and the later ones."""
    log = frame(spark, sf_dir, LOG.replace("{at}", AT))
    early = F.col("seq") % 8 == 0
    both = feedback.compacted(log.where(early)).unionByName(log.where(~early).withColumn("n", F.lit(1).cast("long")))
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return feedback.templates_of(both).select("supplier_name", F.array_join(pairs, ",").alias("template"), "correction_count")


#: Records as maps of texts: bad numbers and dates, and fields that some of them don't have at all.
_TEXTS = {"lot": "'A'", "pieces": "pieces", "meters": "meters", "po_number": "'P'", "net_weight": "net_weight", "order_number": "CAST(NULL AS STRING)", "invoice_number": "'I'", "delivered_date": "delivered_date", "quality": "'Q'", "color": "'C'"}
_GONE = {"lot": 10, "color": 6}
_BROKEN = [
    ("schema", "pieces is no whole number", "pieces = '1.5'"), ("schema", "meters is no number", "meters = 'abc'"), ("schema", "net_weight is no number", "false"), ("date", "not ISO", "doc_id % 4 = 1"), ("date", "month or day", "doc_id % 4 = 0"),
    ("rules", "meters must be > 0", "meters IN ('-3', '0')"), ("rules", "pieces must be > 0", "pieces = '0'"), ("rules", "net_weight cannot be negative", "net_weight = '-1'"), ("completeness", "lot is missing from the record", "doc_id % 10 = 0"), ("completeness", "color is missing from the record", "doc_id % 6 = 0"),
]


def record_maps(spark, sf_dir):
    texts = spark.sql(DATED, orders=dealt(spark, sf_dir, "orders", "o_orderkey")).selectExpr("doc_id", *[f"{v} AS {f}" for f, v in _TEXTS.items()])
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).alias("v"), (F.col("doc_id") % _GONE[f] == 0 if f in _GONE else F.lit(False)).alias("gone")) for f in _TEXTS])
    kept = F.transform(F.filter(pairs, lambda p: ~p["gone"]), lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    return texts.select("doc_id", F.map_from_entries(kept).alias("values"))


@query("validate_joint", f"WITH r AS ({duck(DATED)}) SELECT doc_id, concat_ws('; ', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{check}: {m}{chr(39)} END' for check, m, c in _BROKEN)}) AS errors FROM r")
def validate_joint(spark, sf_dir):
    """Schema, date, rules and completeness in their order, in one pass."""
    checked = checks.validated(record_maps(spark, sf_dir))
    return checked.select("doc_id", F.array_join(F.transform("errors", lambda e: F.concat(e["check"], F.lit(": "), e["message"])), "; ").alias("errors"))


@query("rule_violations", f"WITH r AS ({duck(DATED)}) SELECT * FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{check}{chr(39)} AS check_name, {chr(39)}{m}{chr(39)} AS message, count(*) AS n FROM r WHERE {c}' for check, m, c in _BROKEN)}) WHERE n > 0")
def rule_violations(spark, sf_dir):
    """How many records break each rule."""
    return checks.violations(checks.validated(record_maps(spark, sf_dir))).select(F.col("check").alias("check_name"), "message", "n")
