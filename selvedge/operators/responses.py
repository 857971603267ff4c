"""JSON answers of an extraction model: repair of cut-off text, chunks' rolls joined, and the bridge to line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """packing_list_no string, packing_list_date string, supplier_code string, exporter_name string, product_description string, net_weight_kg double, total_length_mtr double,
    rolls array<struct<lot_no: string, po_number: string, shade: string, roll_no: string, length_mts: double, length_yds: double, points_per_100m2: double, weight_gross_kgs: double, weight_nett_kgs: double, points_per_roll: double>>, extraction_notes array<string>"""


def unfenced(text: Column) -> Column:
    """Without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"\n\s*```(?:json)?\s*$", ""))


def closed(text: Column) -> Column:
    """Cut after the last closing brace, and every bracket, then every brace, that is still open closed; null without a brace."""
    cut = F.nullif(F.regexp_extract(text, r"(?s)^(.*\})", 1), F.lit(""))

    def still_open(left: str, right: str) -> Column:
        return F.greatest(F.lit(0), F.length(cut) - F.length(F.replace(cut, F.lit(left), F.lit(""))) - (F.length(cut) - F.length(F.replace(cut, F.lit(right), F.lit("")))))

    return F.concat(cut, F.repeat(F.lit("]"), still_open("[", "]")), F.repeat(F.lit("}"), still_open("{", "}")))


def parsed(text: Column) -> Column:
    """The answer as a struct: an object, or the first object of a list; repaired if it was cut off; null if nothing helps."""

    def valid(x: Column) -> Column:
        return F.when(F.get_json_object(x, "$").isNotNull(), x)

    def read(x: Column) -> Column:  # an object is read as a list of one, so that one parse does for both shapes
        listed = F.when(F.startswith(F.ltrim(x), F.lit("[")), x).otherwise(F.concat(F.lit("["), x, F.lit("]")))
        return F.get(F.from_json(listed, f"array<struct<{SCHEMA}>>", {"mode": "PERMISSIVE"}), F.lit(0))

    # The lambdas name a step's result, so that no step is done twice.
    bare = F.transform(F.array(unfenced(text)), lambda x: F.coalesce(valid(x), valid(closed(x))))
    return F.get(F.transform(bare, read), F.lit(0))


def merged(answers: DataFrame) -> DataFrame:
    """Answers to chunks (doc_id, chunk, answer) as one for each document: the first chunk's header, all chunks' rolls in order; nothing if the first chunk has no answer."""
    listed = F.array_sort(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("chunk", F.coalesce(F.col("answer.rolls"), F.array()).alias("rolls")))))
    rolls = F.flatten(F.transform(listed, lambda x: x["rolls"]))
    header = F.max(F.when(F.col("chunk") == 0, F.struct("answer.packing_list_no", "answer.packing_list_date", "answer.net_weight_kg", "answer.total_length_mtr", "answer.product_description")))
    return answers.groupBy("doc_id").agg(header.alias("header"), rolls.alias("rolls")).where(F.col("header").isNotNull())


def line_items(merged_: DataFrame) -> DataFrame:
    """doc_id, seq and the line item of each roll; a roll has no quality of its own."""
    rows = merged_.select("doc_id", F.posexplode("rolls").alias("seq", "roll"))
    names = {"lot_no": "lot", "po_number": "po_number", "roll_no": "piece_number", "length_mts": "meters", "weight_nett_kgs": "net_weight", "shade": "color", "length_yds": "length_yds", "points_per_roll": "points_per_roll", "points_per_100m2": "points_per_100m2", "weight_gross_kgs": "weight_gross_kgs"}
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), *[F.col(f"roll.{a}").alias(b) for a, b in names.items()], F.lit(None).cast("string").alias("quality"))


def first_answer(*answers: Column) -> Column:
    """Of several extractors' answers the first that can be read."""
    return F.coalesce(*[parsed(a) for a in answers])
