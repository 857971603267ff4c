"""Queries on rolls. An order is a document, its lines are the rolls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction as X
from ..operators import responses
from ..operators import rolls as R
from ..sources.rendered import ROLLS, duck, rolls_dealt
from .registry import query

WITH_ROLLS = f"WITH rolls AS ({duck(ROLLS)})"


def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolls_dealt(spark, sf_dir)


def _mixed_sql(c: str) -> str:
    return f"CASE WHEN count(DISTINCT {c}) = 1 THEN min({c}) WHEN count(DISTINCT {c}) > 1 THEN concat('MIXED (', string_agg(DISTINCT {c}, ', ' ORDER BY {c}), ')') END"


SUMMARY = f"""SELECT doc_id, count(*) AS pieces, CAST(sum(CAST(meters AS DECIMAL(18,2))) AS DOUBLE) AS meters, CAST(sum(CAST(net_weight AS DECIMAL(18,2))) AS DOUBLE) AS net_weight,
    {_mixed_sql("lot")} AS lot, {_mixed_sql("color")} AS color, {_mixed_sql("quality")} AS quality, min(po_number) AS po_number,
    CAST(CASE WHEN count(DISTINCT po_number) > 1 THEN 0.7 WHEN count(po_number) > 0 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS po_confidence FROM rolls GROUP BY doc_id"""
#: Stated weight in cents: the rolls' own plus 0, 1 or 3 per cent, so that both sides of the tolerance occur.
CHECK = "SELECT doc_id, CAST(sum(CAST(round(net_weight * 100) AS BIGINT)) AS BIGINT) AS cents FROM rolls GROUP BY doc_id"
STATED = f"SELECT doc_id, cents, CAST(cents * (100 + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END) AS BIGINT) AS stated_hundredths FROM ({CHECK})"


def weight_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = rolls(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.round(F.col("net_weight") * 100).cast("long")).alias("cents"))
    more = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 1).otherwise(3)
    stated = sums.select("doc_id", (F.col("cents") * (100 + more)).alias("stated_cents"))
    return R.crosschecked(sums.withColumn("cents", F.col("cents") * 100), stated)


@query("doc_summary", f"{WITH_ROLLS} {SUMMARY}")
def doc_summary(spark, sf_dir):
    return R.summary(rolls(spark, sf_dir))


@query("mixed_values", f"{WITH_ROLLS} SELECT doc_id, {_mixed_sql('lot')} AS lot, {_mixed_sql('color')} AS color FROM rolls GROUP BY doc_id")
def mixed_values(spark, sf_dir):
    return R.summary(rolls(spark, sf_dir)).select("doc_id", "lot", "color")


@query("po_aggregate", f"{WITH_ROLLS} SELECT doc_id, min(po_number) AS po_number, CAST(CASE WHEN count(DISTINCT po_number) > 1 THEN 0.7 ELSE 0.9 END AS DOUBLE) AS confidence FROM rolls GROUP BY doc_id")
def po_aggregate(spark, sf_dir):
    return R.summary(rolls(spark, sf_dir)).select("doc_id", "po_number", F.col("po_confidence").alias("confidence"))


@query("fallback_totals", f"""{WITH_ROLLS}, sums AS ({SUMMARY}), stated AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0.0 ELSE o_totalprice END AS s_meters, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 7 END AS s_pieces FROM orders)
    SELECT doc_id, CASE WHEN coalesce(s_meters, 0) < 0.01 AND coalesce(meters, 0) > 0 THEN meters ELSE s_meters END AS meters, CASE WHEN coalesce(s_meters, 0) < 0.01 AND coalesce(meters, 0) > 0 THEN 'aggregated' ELSE 'stated' END AS meters_source,
    CAST(CASE WHEN s_pieces = 0 AND coalesce(pieces, 0) > 0 THEN pieces ELSE s_pieces END AS BIGINT) AS pieces, CASE WHEN s_pieces = 0 AND coalesce(pieces, 0) > 0 THEN 'aggregated' ELSE 'stated' END AS pieces_source FROM stated LEFT JOIN sums USING (doc_id)""")
def fallback_totals(spark, sf_dir):
    key = F.col("o_orderkey")
    stated = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("doc_id"), F.when(key % 3 == 1, F.lit(0.0)).when(key % 3 == 2, F.col("o_totalprice")).alias("meters"), F.when(key % 2 == 0, 0).otherwise(7).alias("pieces"))
    return R.with_fallbacks(stated, R.summary(rolls(spark, sf_dir)))


@query("stated_or_sum", f"{WITH_ROLLS}, sums AS ({SUMMARY}) SELECT o_orderkey AS doc_id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, net_weight) AS net_weight FROM orders LEFT JOIN sums ON doc_id = o_orderkey")
def stated_or_sum(spark, sf_dir):
    stated = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("stated"))
    return stated.join(R.summary(rolls(spark, sf_dir)), "doc_id", "left").select("doc_id", F.coalesce("stated", "net_weight").alias("net_weight"))


def _override_sql(c: str, own: str) -> str:
    return f"CASE WHEN (n_{c} > 1 AND NOT list_contains(all_{c}, {own})) OR (n_{c} = 1 AND {own} = '') THEN m_{c} ELSE {own} END AS {c}"


def _own_sql(c: str, k: int) -> str:
    return f"CASE WHEN doc_id % 3 = {k} THEN '' WHEN doc_id % 3 = {(k + 1) % 3} THEN 'X' ELSE m_{c} END"


THREE = ("lot", "color", "quality")


@query("mixed_override", f"{WITH_ROLLS}, sets AS (SELECT doc_id, {', '.join(f'count(DISTINCT {c}) AS n_{c}, list(DISTINCT {c}) AS all_{c}, {_mixed_sql(c)} AS m_{c}' for c in THREE)} FROM rolls GROUP BY doc_id) SELECT doc_id, {', '.join(_override_sql(c, _own_sql(c, k)) for k, c in enumerate(THREE))} FROM sets")
def mixed_override(spark, sf_dir):
    sets = rolls(spark, sf_dir).groupBy("doc_id").agg(*[F.collect_set(c).alias(f"all_{c}") for c in THREE])
    own = {c: F.when(F.col("doc_id") % 3 == k, F.lit("")).when(F.col("doc_id") % 3 == (k + 1) % 3, F.lit("X")).otherwise(T.mixed(F.col(f"all_{c}"))) for k, c in enumerate(THREE)}
    return sets.select("doc_id", *[R.overridden(own[c], F.col(f"all_{c}")).alias(c) for c in THREE])


@query("weight_crosscheck", f"{WITH_ROLLS} SELECT doc_id, CAST(cents * 100 AS BIGINT) AS cents, stated_hundredths AS stated_cents, abs(cents * 100 - stated_hundredths) * 50 > stated_hundredths AS mismatch FROM ({STATED})")
def weight_crosscheck(spark, sf_dir):
    return weight_check(spark, sf_dir)


@query("flagship", f"{WITH_ROLLS}, sums AS ({SUMMARY}), checked AS (SELECT doc_id, abs(cents * 100 - stated_hundredths) * 50 > stated_hundredths AS mismatch FROM ({STATED})) SELECT doc_id, o_custkey AS customer, pieces, meters, net_weight, lot, color, quality, po_number, mismatch, concat_ws(',', CASE WHEN po_confidence < 0.85 THEN 'po_number' END, CASE WHEN mismatch THEN 'net_weight' END) AS flagged_fields FROM orders JOIN sums ON doc_id = o_orderkey JOIN checked USING (doc_id)")
def flagship(spark, sf_dir):
    """Documents with their totals, the weight check and the fields to be reviewed."""
    sums = R.summary(rolls(spark, sf_dir)).join(weight_check(spark, sf_dir).select("doc_id", "mismatch"), "doc_id")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("customer"))
    flags = F.concat_ws(",", F.when(F.col("po_confidence") < 0.85, F.lit("po_number")), F.when(F.col("mismatch"), F.lit("net_weight")))
    return orders.join(sums, "doc_id").select("doc_id", "customer", "pieces", "meters", "net_weight", "lot", "color", "quality", "po_number", "mismatch", flags.alias("flagged_fields"))


#: Rolls with ditto marks and blanks where a lot goes on, and a total after every fifth roll.
GAPPED = f"{WITH_ROLLS}, gapped AS (SELECT doc_id, seq, CASE WHEN seq % 3 = 0 THEN '\"' WHEN seq % 3 = 2 THEN ' ' ELSE lot END AS lot, CASE WHEN seq % 5 = 4 THEN 'Total' WHEN seq % 5 = 3 THEN '' ELSE piece_number END AS piece_number, meters FROM rolls)"


def gapped(spark, sf_dir):
    seq = F.col("seq")
    return rolls(spark, sf_dir).select("doc_id", "seq", F.when(seq % 3 == 0, F.lit('"')).when(seq % 3 == 2, F.lit(" ")).otherwise(F.col("lot")).alias("lot"), F.when(seq % 5 == 4, F.lit("Total")).when(seq % 5 == 3, F.lit("")).otherwise(F.col("piece_number")).alias("piece_number"), "meters")


@query("ditto_fill", f"{GAPPED} SELECT doc_id, seq, last_value(CASE WHEN trim(lot) NOT IN ('', '\"') THEN lot END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS lot FROM gapped")
def ditto_fill(spark, sf_dir):
    return R.filled(gapped(spark, sf_dir), "lot").select("doc_id", "seq", "lot")


@query("skip_summary", f"{GAPPED} SELECT doc_id, count(*) AS n_rolls FROM gapped WHERE piece_number <> 'Total' GROUP BY doc_id")
def skip_summary(spark, sf_dir):
    return R.without_summaries(gapped(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_rolls"))


@query("roll_identity", f"{GAPPED} SELECT doc_id, seq, CASE WHEN piece_number = '' THEN CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS VARCHAR) ELSE piece_number END AS piece_number FROM gapped WHERE piece_number <> 'Total'")
def roll_identity(spark, sf_dir):
    return R.identified(R.without_summaries(gapped(spark, sf_dir))).select("doc_id", "seq", "piece_number")


LINES = f"{WITH_ROLLS} SELECT doc_id, seq * 2 AS seq, piece_number AS line FROM rolls UNION ALL SELECT doc_id, seq * 2 - 1, concat('PO # ', po_number) FROM rolls WHERE seq % 2 = 1"


@query("section_fill", f"WITH lines AS ({LINES}), filled AS (SELECT *, last_value(nullif(regexp_extract(line, '^PO # (.*)$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM lines) SELECT doc_id, seq, line, section FROM filled WHERE line NOT LIKE 'PO #%'")
def section_fill(spark, sf_dir):
    own = rolls(spark, sf_dir)
    lines = own.select("doc_id", (F.col("seq") * 2).alias("seq"), F.col("piece_number").alias("line")).unionByName(own.where("seq % 2 = 1").select("doc_id", (F.col("seq") * 2 - 1).alias("seq"), F.concat(F.lit("PO # "), "po_number").alias("line")))
    return R.sectioned(lines).select("doc_id", "seq", "line", "section")


@query("extraction_notes", f"{GAPPED} SELECT doc_id, concat_ws('; ', CASE WHEN count(*) FILTER (WHERE lot = '\"') > 0 THEN concat('ditto marks: ', count(*) FILTER (WHERE lot = '\"')) END, CASE WHEN count(*) FILTER (WHERE piece_number = 'Total') > 0 THEN concat('rows skipped: ', count(*) FILTER (WHERE piece_number = 'Total')) END, concat('rolls: ', count(*) FILTER (WHERE piece_number <> 'Total')), CASE WHEN count(*) <> count(*) FILTER (WHERE piece_number <> 'Total') THEN concat('expected: ', count(*)) END, CASE WHEN doc_id % 3 = 0 THEN 'unmapped: Ctn No, FBN' END) AS notes FROM gapped GROUP BY doc_id")
def extraction_notes(spark, sf_dir):
    own = gapped(spark, sf_dir)
    unmapped = own.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit("FBN"), F.lit("Ctn No"))).alias("heading"))
    return R.extraction_notes(own, own.groupBy("doc_id").agg(F.count("*").alias("expected")), unmapped)


LINE_ITEMS = "SELECT doc_id, seq, CASE WHEN seq % 4 = 3 THEN NULL ELSE lot END AS lot, CASE WHEN seq % 3 = 0 THEN '' ELSE po_number END AS po_number, piece_number, CASE WHEN seq % 6 = 5 THEN 0.0 ELSE meters END AS meters, net_weight, color, CASE WHEN doc_id % 3 = 0 THEN meters + 0.25 END AS length_yds, CASE WHEN seq % 2 = 0 THEN CAST(seq AS DOUBLE) END AS points_per_roll, CAST(seq * 1.5 AS DOUBLE) AS points_per_100m2, net_weight + 1 AS weight_gross_kgs FROM rolls WHERE doc_id % 5 <> 0"
SHEET_RECORDS = f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lot END AS lot, po_number, color, pieces, meters, net_weight FROM ({SUMMARY})"
HALF_EVEN = "CASE WHEN meters <> 0 THEN printf('%.2f', meters * 1.09361) ELSE '' END"


def _or_blank(x: str) -> str:
    return f"CASE WHEN coalesce({x}, 0) = 0 THEN '' ELSE CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR) END"


@query("sheet_rows", f"""{WITH_ROLLS}, lines AS ({LINE_ITEMS}), records AS ({SHEET_RECORDS}),
    joined AS (SELECT l.*, coalesce(nullif(l.lot, ''), nullif(r.lot, ''), '') AS lot_value, coalesce(nullif(l.po_number, ''), r.po_number, '') AS po, coalesce(l.color, r.color, '') AS shade FROM lines l JOIN records r USING (doc_id)),
    lagged AS (SELECT *, lag(lot_value) OVER (PARTITION BY doc_id ORDER BY seq) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY seq) + 8 AS row FROM joined)
    SELECT doc_id, CAST(row AS INTEGER) AS row, CASE WHEN before <> '' AND before = lot_value THEN '"' ELSE lot_value END AS lot_no, po, shade, piece_number AS roll_no, {_or_blank('meters')} AS length_mts, CASE WHEN length_yds IS NOT NULL THEN CAST(CAST(length_yds AS DECIMAL(18,2)) AS VARCHAR) ELSE {HALF_EVEN} END AS length_yds, {_or_blank('points_per_roll')} AS points_per_roll, {_or_blank('points_per_100m2')} AS points_per_100m2, {_or_blank('weight_gross_kgs')} AS weight_gross, {_or_blank('net_weight')} AS weight_nett FROM lagged
    UNION ALL SELECT doc_id, 9, coalesce(lot, ''), coalesce(po_number, ''), coalesce(color, ''), CAST(pieces AS VARCHAR), {_or_blank('meters')}, {HALF_EVEN}, '', '', '', {_or_blank('net_weight')} FROM records WHERE doc_id % 5 = 0""")
def sheet_rows(spark, sf_dir):
    own = rolls(spark, sf_dir)
    seq = F.col("seq")
    lines = own.where("doc_id % 5 <> 0").select("doc_id", "seq", F.when(seq % 4 != 3, F.col("lot")).alias("lot"), F.when(seq % 3 == 0, F.lit("")).otherwise(F.col("po_number")).alias("po_number"), "piece_number", F.when(seq % 6 == 5, F.lit(0.0)).otherwise(F.col("meters")).alias("meters"), "net_weight", "color", F.when(F.col("doc_id") % 3 == 0, F.col("meters") + 0.25).alias("length_yds"), F.when(seq % 2 == 0, seq.cast("double")).alias("points_per_roll"), (seq * 1.5).alias("points_per_100m2"), (F.col("net_weight") + 1).alias("weight_gross_kgs"))
    records = R.summary(own).withColumn("lot", F.when(F.col("doc_id") % 2 == 0, F.col("lot")))
    return R.sheet_rows(lines, records)


@query("flat_rows", f"{WITH_ROLLS} SELECT doc_id, CAST(seq AS INTEGER) AS n, lot AS lot_no, po_number AS po, color AS shade, piece_number AS roll_no, meters AS length_mts, net_weight AS weight_nett FROM rolls")
def flat_rows(spark, sf_dir):
    return R.flat_rows(rolls(spark, sf_dir))


@query("sheet_header", f"""{WITH_ROLLS}, r AS (SELECT s.*, s_name, s_suppkey % 4 AS k FROM ({SUMMARY}) s JOIN supplier ON s_suppkey = doc_id % 10 + 1)
    SELECT doc_id, cell, value FROM r, (VALUES ('C1'), ('D1'), ('A3'), ('B3'), ('C3'), ('D3'), ('E3'), ('F3'), ('G3'), ('H3'), ('A4'), ('B4')) c(cell), LATERAL (SELECT CASE cell WHEN 'C1' THEN 'Exporter / Manufacturer:' WHEN 'A3' THEN 'Packing list No:' WHEN 'C3' THEN 'Date:' WHEN 'E3' THEN 'Net Weight:' WHEN 'G3' THEN 'Total Length:' WHEN 'A4' THEN 'Product:'
        WHEN 'D1' THEN CASE WHEN k = 0 THEN '' ELSE upper(s_name) END WHEN 'B3' THEN CASE WHEN k = 1 THEN '' ELSE concat('PL-', doc_id) END WHEN 'D3' THEN '2024-03-15' WHEN 'F3' THEN {_or_blank('net_weight')} WHEN 'H3' THEN {_or_blank('meters')} ELSE coalesce(quality, '') END AS value)""")
def sheet_header(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    own = R.summary(rolls(spark, sf_dir)).join(names, F.col("s_suppkey") == F.col("doc_id") % 10 + 1)
    k = F.col("s_suppkey") % 4
    return R.sheet_header(own.select("*", F.when(k == 0, F.lit("unknown")).otherwise(F.col("s_name")).alias("supplier_name"), F.when(k != 1, F.concat(F.lit("PL-"), F.col("doc_id").cast("string"))).alias("invoice_number"), F.lit("2024-03-15").alias("delivered_date")))


@query("supplier_code", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'AML' WHEN 1 THEN 'PEN' WHEN 2 THEN 'SFM' ELSE 'UNKNOWN' END AS code FROM supplier")
def supplier_code(spark, sf_dir):
    key = F.col("s_suppkey")
    name = F.when(key % 4 == 0, F.lit("Artistic Milliners (Pvt) Ltd")).when(key % 4 == 1, F.lit("PENFABRIC Sdn")).when(key % 4 == 2, F.lit("Sapphire Finishing")).otherwise(F.col("s_name"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", R.supplier_code(name).alias("code"))


@query("split_shade_lot", "SELECT l_orderkey, l_linenumber, l_partkey, concat('DARK ', l_returnflag) AS shade, CAST(l_partkey + 1000000 AS VARCHAR) AS lot FROM lineitem")
def split_shade_lot(spark, sf_dir):
    cell = F.concat(F.lit(" DARK "), "l_returnflag", F.lit("  "), (F.col("l_partkey") + 1000000).cast("string"))
    shade, lot = R.shade_and_lot(cell)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", shade.alias("shade"), lot.alias("lot"))


@query("rolls_to_lines", f"{WITH_ROLLS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, lot, po_number, piece_number, meters, CAST(CAST(round(meters * 109361) AS BIGINT) / 100000 AS DOUBLE) AS length_yds, CASE WHEN seq % 2 = 0 THEN CAST(seq AS DOUBLE) END AS points_per_roll, CAST(NULL AS DOUBLE) AS points_per_100m2, net_weight + 1 AS weight_gross_kgs, net_weight, color, CAST(NULL AS VARCHAR) AS quality FROM rolls")
def rolls_to_lines(spark, sf_dir):
    yds = F.round(F.col("meters") * 109361).cast("long") / 100000
    roll = F.struct(F.col("lot").alias("lot_no"), "po_number", F.col("color").alias("shade"), F.col("piece_number").alias("roll_no"), F.col("meters").alias("length_mts"), yds.alias("length_yds"), F.lit(None).cast("double").alias("points_per_100m2"), (F.col("net_weight") + 1).alias("weight_gross_kgs"), F.col("net_weight").alias("weight_nett_kgs"), F.when(F.col("seq") % 2 == 0, F.col("seq").cast("double")).alias("points_per_roll"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", roll.alias("roll")))), lambda x: x["roll"])
    return responses.line_items(rolls(spark, sf_dir).groupBy("doc_id").agg(listed.alias("rolls")))


def roll_texts(spark, sf_dir):
    """The rolls of each order as text: a section for each PO, ditto marks, totals."""
    order = Window.partitionBy("doc_id", "po_number").orderBy("seq")
    place, last = F.row_number().over(order), F.lead("seq").over(order).isNull()
    own = rolls(spark, sf_dir).select("*", F.lag("lot").over(order).alias("lot_before"), place.alias("place"), last.alias("is_last"))
    lot = F.when(F.col("lot_before") == F.col("lot"), F.lit('"')).otherwise(F.col("lot"))
    money = F.format_string("%.2f", F.col("net_weight"))
    line = F.concat_ws("   ", lot, "piece_number", "color", F.concat(F.col("meters").cast("int").cast("string"), F.lit(" m")), money)
    above = F.when(F.col("place") == 1, F.concat(F.lit("PO # "), "po_number", F.lit("\nLot No   Roll No   Shade   Length (M)   Net Weight\n"))).otherwise("")
    below = F.when(F.col("is_last"), F.concat(F.lit("\nTotal   "), F.col("place").cast("string"), F.lit("   rolls\n"))).otherwise("")
    listed = F.sort_array(F.collect_list(F.struct("po_number", "seq", F.concat(above, line, below).alias("text"))))
    return own.where("po_number IS NOT NULL").groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("full_text"))


@query("roll_extraction", f"{WITH_ROLLS} SELECT doc_id, lot, po_number, piece_number, color, CAST(meters AS DOUBLE) AS meters, CAST(round(net_weight * 100) AS BIGINT) AS cents FROM rolls")
def roll_extraction(spark, sf_dir):
    """Text and back again."""
    found = X.extracted(X.lines_of(roll_texts(spark, sf_dir)))
    return found.select("doc_id", "lot", "po_number", "piece_number", "color", "meters", F.round(F.col("net_weight") * 100).cast("long").alias("cents"))
