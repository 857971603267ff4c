"""Rolls of a document: fill-forward, sections, rows that are no rolls, identity, and sums over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.fixed import SUMMARY_ROW, SUPPLIER_CODES, WEIGHT_TOLERANCE, YARDS_PER_METER
from ..functions.text import mixed, nonempty, once, stripped, yards


def in_order() -> WindowSpec:
    """A document's rolls in order; every window here is within one document."""
    return Window.partitionBy("doc_id").orderBy("seq")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def unmarked(x: Column) -> Column:
    """A stripped cell, or null for a blank or a ditto mark."""
    return F.when(~x.isin("", '"', "''", "“", "”", "〃"), x)


def explicit(x: Column) -> Column:
    """A cell's own value: null for a blank or a ditto mark."""
    return once(stripped(x), unmarked)


def filled(rolls: DataFrame, *columns: str) -> DataFrame:
    """Ditto marks and blanks replaced by the last value above."""
    return rolls.withColumns({c: F.last(explicit(F.col(c)), ignorenulls=True).over(so_far()) for c in columns})


#: The heading of a section, with its value.
SECTION = r"^\s*PO\s*#?\s*[:.]?\s*([A-Z0-9-]+)\s*$"


def section_value(text: str, heading: str = SECTION) -> Column:
    """The value of a line that is a section's heading; null for another."""
    return nonempty(F.regexp_extract(text, heading, 1))


def sectioned(lines: DataFrame, text: str = "line", heading: str = SECTION) -> DataFrame:
    """Lines (doc_id, seq, line) with the value of the section heading above them; the headings themselves are left out."""
    return lines.withColumn("heading", section_value(text, heading)).withColumn("section", F.last("heading", ignorenulls=True).over(so_far())).where(F.col("heading").isNull()).drop("heading")


def without_summaries(rolls: DataFrame, label: str = "piece_number") -> DataFrame:
    """Rows that are rolls: no totals by their label."""
    return rolls.where(~F.coalesce(F.lower(F.col(label)).rlike(SUMMARY_ROW), F.lit(False)))


def identified(rolls: DataFrame) -> DataFrame:
    """Each roll once; one without a number gets its place in the document."""
    once = rolls.dropDuplicates(["doc_id", "seq"])
    return once.withColumn("piece_number", F.coalesce(nonempty(stripped(F.col("piece_number"))), F.row_number().over(in_order()).cast("string")))


def cents(x: str) -> Column:
    return F.sum(F.col(x).cast("decimal(18,2)"))


def summary(rolls: DataFrame) -> DataFrame:
    """Totals of each document from its rolls: pieces, meters, net_weight, and lot, color, quality (MIXED where several), po_number (the least where several, at lower confidence). Sums are of decimals, so the order of rows doesn't matter."""
    sets = {c: F.collect_set(c) for c in ("lot", "color", "quality")}
    return rolls.groupBy("doc_id").agg(
        F.count("*").alias("pieces"),
        cents("meters").cast("double").alias("meters"),
        cents("net_weight").cast("double").alias("net_weight"),
        *[mixed(s).alias(c) for c, s in sets.items()],
        F.min("po_number").alias("po_number"),
        F.when(F.count_distinct("po_number") > 1, F.lit(0.7)).when(F.count("po_number") > 0, F.lit(0.9)).otherwise(F.lit(0.0)).alias("po_confidence"),
    )


def with_fallbacks(stated: DataFrame, sums: DataFrame) -> DataFrame:
    """Stated totals (doc_id, meters, pieces), and where one is missing or nothing, the rolls' (aggregated)."""
    rows = stated.select("doc_id", F.col("meters").alias("s_meters"), F.col("pieces").alias("s_pieces")).join(sums.select("doc_id", "meters", "pieces"), "doc_id", "left")
    use_meters = (F.coalesce("s_meters", F.lit(0.0)) < 0.01) & (F.coalesce("meters", F.lit(0.0)) > 0)
    use_pieces = (F.coalesce("s_pieces", F.lit(0)) == 0) & (F.coalesce("pieces", F.lit(0)) > 0)
    return rows.select(
        "doc_id",
        F.when(use_meters, F.col("meters")).otherwise(F.col("s_meters")).alias("meters"),
        F.when(use_meters, F.lit("aggregated")).otherwise(F.lit("stated")).alias("meters_source"),
        F.when(use_pieces, F.col("pieces")).otherwise(F.col("s_pieces")).cast("long").alias("pieces"),
        F.when(use_pieces, F.lit("aggregated")).otherwise(F.lit("stated")).alias("pieces_source"),
    )


def overridden(record_value: Column, values: Column) -> Column:
    """A document's value against its rolls' (an array): several that don't hold it become MIXED; a single one fills a blank."""
    distinct = F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))
    several = (F.size(distinct) > 1) & ~F.coalesce(F.array_contains(distinct, record_value), F.lit(False))
    blank = (F.size(distinct) == 1) & (F.coalesce(record_value, F.lit("")) == "")
    return F.when(several | blank, mixed(distinct)).otherwise(record_value)


def crosschecked(sums: DataFrame, stated: DataFrame) -> DataFrame:
    """Rolls' weight (doc_id, net_weight in hundredths: cents) against the stated one (stated_cents); mismatch where they differ by more than the tolerance. Without a stated weight or rolls there is none."""
    tolerance = int(1 / WEIGHT_TOLERANCE)
    rows = stated.join(sums, "doc_id", "left")
    off = F.abs(F.col("cents") - F.col("stated_cents")) * tolerance > F.col("stated_cents")
    return rows.select("doc_id", "cents", "stated_cents", F.coalesce(off & (F.col("stated_cents") > 0), F.lit(False)).alias("mismatch"))


def supplier_code(name: Column) -> Column:
    out = F.lit("UNKNOWN")
    for part, code in reversed(SUPPLIER_CODES.items()):
        out = F.when(F.contains(F.upper(name), F.lit(part)), F.lit(code)).otherwise(out)
    return out


def shade_and_lot(x: Column) -> tuple[Column, Column]:
    """A shade's name and the lot number behind it, from one cell."""
    pattern = r"^\s*(.*?)\s+([0-9]{4,})\s*$"
    return nonempty(F.regexp_extract(x, pattern, 1)), nonempty(F.regexp_extract(x, pattern, 2))


def blank_zero(x: Column) -> Column:
    """A cell of a sheet: nothing for null, '' and 0."""
    return F.coalesce(F.when(x.cast("double") == 0, F.lit("")).otherwise(x.cast("string")), F.lit(""))


#: What a sheet shows of a roll beside its lot, PO, shade and number: column, attribute of the line.
SHEET_NUMBERS = {"points_per_roll": "points_per_roll", "points_per_100m2": "points_per_100m2", "weight_gross": "weight_gross_kgs", "weight_nett": "net_weight"}


def money(x: Column) -> Column:
    return blank_zero(x.cast("decimal(18,2)"))


def shown_yards(meters: Column) -> Column:
    return F.when(meters != 0, yards(meters, YARDS_PER_METER)).otherwise(F.lit(""))


def sheet_rows(lines: DataFrame, records: DataFrame) -> DataFrame:
    """The rows of the sheet, numbered from 9: each roll with the document's lot, PO and color where it has none and a ditto mark for a lot that repeats; yards as stated, else from the meters; documents without rolls have one row of their own. Attributes that the lines don't have stay blank; a line without a record has no document's values."""
    own = records.select("doc_id", *[F.col(c).alias(f"doc_{c}") for c in ("lot", "po_number", "color")])
    more = [c for c in ("length_yds", *SHEET_NUMBERS.values()) if c not in lines.columns]
    rows = lines.withColumns({c: F.lit(None).cast("double") for c in more}).join(own, "doc_id", "left")
    lot = F.coalesce(nonempty(F.col("lot")), nonempty(F.col("doc_lot")), F.lit(""))
    rows = rows.withColumn("lot_value", lot).withColumn("lot_before", F.lag("lot_value").over(in_order()))
    shown = rows.select(
        "doc_id",
        (F.row_number().over(in_order()) + 8).cast("int").alias("row"),
        F.when((F.col("lot_before") != "") & (F.col("lot_before") == F.col("lot_value")), F.lit('"')).otherwise(F.col("lot_value")).alias("lot_no"),
        F.coalesce(nonempty(F.col("po_number")), F.col("doc_po_number"), F.lit("")).alias("po"),
        F.coalesce(nonempty(F.col("color")), F.col("doc_color"), F.lit("")).alias("shade"),
        F.coalesce("piece_number", F.lit("")).alias("roll_no"),
        money(F.col("meters")).alias("length_mts"),
        F.when(F.col("length_yds").isNotNull(), F.col("length_yds").cast("decimal(18,2)").cast("string")).otherwise(shown_yards(F.col("meters"))).alias("length_yds"),
        *[money(F.col(attribute)).alias(column) for column, attribute in SHEET_NUMBERS.items()],
    )
    bare = records.join(lines.select("doc_id").distinct(), "doc_id", "left_anti").select(
        "doc_id",
        F.lit(9).alias("row"),
        F.coalesce("lot", F.lit("")).alias("lot_no"),
        F.coalesce("po_number", F.lit("")).alias("po"),
        F.coalesce("color", F.lit("")).alias("shade"),
        blank_zero(F.col("pieces")).alias("roll_no"),
        money(F.col("meters")).alias("length_mts"),
        shown_yards(F.col("meters")).alias("length_yds"),
        *[(money(F.col("net_weight")) if column == "weight_nett" else F.lit("")).alias(column) for column in SHEET_NUMBERS],
    )
    return shown.unionByName(bare)


def sheet_header(records: DataFrame) -> DataFrame:
    """doc_id, cell and value of what stands above the rolls (rows 1 to 4) of each record's sheet."""
    name = F.upper(F.when(F.col("supplier_name") != "unknown", F.col("supplier_name")))
    shown = {
        "C1": F.lit("Exporter / Manufacturer:"), "D1": name,
        "A3": F.lit("Packing list No:"), "B3": F.col("invoice_number"), "C3": F.lit("Date:"), "D3": F.col("delivered_date"),
        "E3": F.lit("Net Weight:"), "F3": money(F.col("net_weight")), "G3": F.lit("Total Length:"), "H3": money(F.col("meters")),
        "A4": F.lit("Product:"), "B4": F.col("quality"),
    }
    cells = F.array(*[F.struct(F.lit(cell).alias("cell"), F.coalesce(value, F.lit("")).alias("value")) for cell, value in shown.items()])
    return records.select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.cell", "x.value")


def flat_rows(lines: DataFrame) -> DataFrame:
    """Lines as plain rows under the sheet's names."""
    return lines.select("doc_id", F.col("seq").cast("int").alias("n"), F.col("lot").alias("lot_no"), F.col("po_number").alias("po"), F.col("color").alias("shade"), F.col("piece_number").alias("roll_no"), F.col("meters").alias("length_mts"), F.col("net_weight").alias("weight_nett"))


#: A value is out of line if it is so many median deviations, and more than NEAR of the median, from its document's median, where the document has LEAST_VALUES of them.
OUT_OF_LINE, NEAR, LEAST_VALUES = 8.0, 0.01, 8


def inconsistent(lines: DataFrame) -> DataFrame:
    """Values of rolls that don't fit their document: doc_id, seq, piece_number, what (meters; kgs per meter; yards per meter), value, median, deviation (the median one). A document whose values are nearly all the same has a deviation of 0: then any value that isn't near them is out of line. Lines without a value aren't judged."""
    meters = F.when(F.col("meters") > 0, F.col("meters"))
    measures = {"meters": F.col("meters"), "kgs per meter": F.col("net_weight") / meters}
    if "length_yds" in lines.columns:
        measures["yards per meter"] = F.col("length_yds") / meters
    pairs = F.array(*[F.struct(F.lit(what).alias("what"), value.cast("double").alias("value")) for what, value in measures.items()])
    rows = lines.select("doc_id", "seq", "piece_number", F.explode(pairs).alias("m")).select("doc_id", "seq", "piece_number", "m.*").where("value IS NOT NULL")
    middle = rows.groupBy("doc_id", "what").agg(F.median("value").alias("median"), F.count("*").alias("n")).where(F.col("n") >= LEAST_VALUES)
    rows = rows.join(middle, ["doc_id", "what"]).withColumn("off", F.abs(F.col("value") - F.col("median")))
    spread = rows.groupBy("doc_id", "what").agg(F.median("off").alias("deviation"))
    return rows.join(spread, ["doc_id", "what"]).where((F.col("off") > OUT_OF_LINE * F.col("deviation")) & (F.col("off") > NEAR * F.abs("median"))).select("doc_id", "seq", "piece_number", "what", "value", "median", "deviation")


def extraction_notes(rows: DataFrame, expected: DataFrame | None = None, unmapped: DataFrame | None = None, odd: DataFrame | None = None) -> DataFrame:
    """What the reader of a document's rows (doc_id, lot, piece_number) should know: ditto marks, rows left out, rolls; how many were expected (doc_id, expected), where that differs; columns that mean no field (doc_id, heading); values that don't fit (of inconsistent())."""
    ditto, skipped = F.count_if(F.col("lot") == '"'), F.count_if(F.coalesce(F.lower("piece_number").rlike(SUMMARY_ROW), F.lit(False)))
    notes = F.concat_ws("; ", F.when(ditto > 0, F.concat(F.lit("ditto marks: "), ditto.cast("string"))), F.when(skipped > 0, F.concat(F.lit("rows skipped: "), skipped.cast("string"))), F.concat(F.lit("rolls: "), (F.count("*") - skipped).cast("string")))
    found = rows.groupBy("doc_id").agg(notes.alias("notes"), (F.count("*") - skipped).alias("n"))
    more = []
    if expected is not None:
        found = found.join(expected, "doc_id", "left")
        more.append(F.when(F.col("expected") != F.col("n"), F.concat(F.lit("expected: "), F.col("expected").cast("string"))))
    if unmapped is not None:
        found = found.join(unmapped.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("heading")), ", ").alias("headings")), "doc_id", "left")
        more.append(F.concat(F.lit("unmapped: "), "headings"))
    if odd is not None:
        said = F.concat("what", F.lit(" "), F.format_string("%.2f", "value"), F.lit(" of roll "), "piece_number")
        found = found.join(odd.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "what", said.alias("said")))), lambda x: x["said"]), ", ").alias("odd")), "doc_id", "left")
        more.append(F.concat(F.lit("inconsistent: "), "odd"))
    return found.select("doc_id", F.concat_ws("; ", "notes", *more).alias("notes"))
