"""Tables of a document as cells (doc_id, tbl, row, col, text): which heading means which field, and the values below it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import ALIASES, FIELDS, LOT_SIGNATURE, ROLL_SIGNATURE, SHORT_ALIASES, SUMMARY_ROW, SUPPLIER_COLUMNS, WEIGHT_HEADINGS
from ..functions.text import clean_number, nonempty, number, once, stripped
from .rolls import explicit, shade_and_lot

#: Rows of a table that can be its heading.
HEADING_ROWS = 3


def alias_table(spark: SparkSession, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """field, field_ord, alias (lower case): a fixed table of some 140 rows."""
    rows = [(field, k, alias) for k, (field, names) in enumerate(aliases.items()) for alias in dict.fromkeys(n.lower() for n in names)]
    return spark.createDataFrame(rows, "field string, field_ord int, alias string")


def counted(cells: DataFrame) -> DataFrame:
    """Cells with a page (doc_id, page, tbl, row, col, text) as cells whose tables are counted over the document."""
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page", "tbl"))
    return cells.select("doc_id", (place - 1).alias("tbl"), "row", *[c for c in ("col", "text", "texts") if c in cells.columns])


def echoes() -> list[str]:
    """Texts that are headings wherever they stand."""
    return sorted({n.lower() for names in ALIASES.values() for n in names} | {f.replace("_", " ") for f in FIELDS})


def without_echoes(cells: DataFrame) -> DataFrame:
    """Cells below the first row that don't repeat a heading."""
    known = cells.sparkSession.createDataFrame([(e,) for e in echoes()], "echo string")
    return cells.where("row > 0").join(F.broadcast(known), F.lower("text") == F.col("echo"), "left_anti")


def headings(cells: DataFrame) -> DataFrame:
    """Cells of the rows that can be headings, as the aliases are written."""
    return cells.where((F.col("row") < HEADING_ROWS) & (F.coalesce("text", F.lit("")) != "")).withColumn("heading", F.lower(stripped(F.col("text")))).where(F.col("heading") != "")


def _means(heading: Column, alias: Column, field: Column) -> Column:
    short = alias.isin(*SHORT_ALIASES) & (F.startswith(heading, F.concat(alias, F.lit(" "))) | F.endswith(heading, F.concat(F.lit(" "), alias)) | F.startswith(heading, F.concat(alias, F.lit("."))))
    return (heading == F.replace(field, F.lit("_"), F.lit(" "))) | (heading == alias) | ((F.length(alias) > 3) & F.contains(heading, alias)) | short


#: Distinct headings that have a meaning and may be sent to every task.
BROADCAST_HEADINGS = 10_000


def to_every_task(found: DataFrame) -> DataFrame:
    """Meanings of headings, to be joined without a shuffle of what has the headings: they are few and go to every task, unless there are more than BROADCAST_HEADINGS."""
    rows = found.limit(BROADCAST_HEADINGS + 1).collect()
    return F.broadcast(found.sparkSession.createDataFrame(rows, found.schema)) if len(rows) <= BROADCAST_HEADINGS else found


def meanings(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """heading and the first field, in the aliases' order, with any alias that matches it. Each distinct heading is looked at once; the aliases are few and fixed, so they go to every task."""
    distinct = texts.select("heading").where(F.col("heading").rlike("[a-z]")).distinct()  # as every alias has a letter
    found = distinct.join(F.broadcast(aliases), _means(F.col("heading"), F.col("alias"), F.col("field")))
    return found.groupBy("heading").agg(F.min_by("field", "field_ord").alias("field"))


def matched(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, row, col, field of the cells in possible heading rows that mean a field."""
    own = headings(cells)
    return own.join(to_every_task(meanings(own, alias_table(cells.sparkSession))), "heading").select("doc_id", "tbl", "row", "col", "field")


def header_rows(found: DataFrame) -> DataFrame:
    """doc_id, tbl and the row with the most headings (the first of several)."""
    counted = found.groupBy("doc_id", "tbl", "row").agg(F.count("*").alias("n"))
    return counted.groupBy("doc_id", "tbl").agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("header_row"), F.max("n").alias("n_columns"))


def candidates(cells: DataFrame) -> DataFrame:
    """Values below the headings: doc_id, tbl, row, col, field, value; without blanks, headings that are repeated, and figures too short for a number of a document. Tables of one row have none. A document's headings meet its cells by doc_id alone, so cells that are dealt by document aren't shuffled."""
    rows = matched(cells).groupBy("doc_id", "tbl", "row").agg(F.count("*").alias("n"), F.collect_list(F.struct("col", "field")).alias("fields"))
    heads = rows.groupBy("doc_id", "tbl").agg(F.max_by(F.struct("row", "fields"), F.struct("n", -F.col("row"))).alias("head"))
    head = F.struct(F.col("head.row").alias("header_row"), F.map_from_entries("head.fields").alias("fields"))
    heads = heads.where("tbl IS NOT NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tbl", head.alias("head")))).alias("heads"))
    rows = cells.join(heads, "doc_id").withColumn("head", F.try_element_at("heads", "tbl")).where(F.col("row") > F.col("head.header_row"))
    rows = rows.withColumn("field", F.try_element_at("head.fields", "col")).where(F.col("field").isNotNull())
    rows = rows.withColumn("value", stripped(F.col("text"))).where(F.col("value") != "")
    short = F.col("field").isin(*NUMBERED) & F.col("value").rlike("^[0-9]{1,3}$")
    return rows.where(~F.lower("value").isin(*echoes()) & ~short).select("doc_id", "tbl", "row", "col", "field", "value")


#: Fields whose values are never so short a figure.
NUMBERED = ("lot", "order_number", "invoice_number", "po_number")


def _exact(aliases: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """The place of the field that meanings() gives to each text that is an alias or a field's name."""

    def means(text: str, field: str) -> bool:
        names = [n.lower() for n in aliases[field]]
        short = any(n in SHORT_ALIASES and (text.startswith((n + " ", n + ".")) or text.endswith(" " + n)) for n in names)
        return text == field.replace("_", " ") or text in names or any(len(n) > 3 and n in text for n in names) or short

    texts = sorted({f.replace("_", " ") for f in aliases} | {n.lower() for names in aliases.values() for n in names})
    return {text: next(k for k, field in enumerate(aliases) if means(text, field)) for text in texts}


def _pattern(field: str, names: tuple[str, ...]) -> str:
    """What a heading (lower case) matches somewhere if an alias of the field means it."""
    lower = list(dict.fromkeys(n.lower() for n in names))
    short = [re.escape(n) for n in lower if n in SHORT_ALIASES]
    whole = "|".join(re.escape(n) for n in (field.replace("_", " "), *lower))
    parts = [rf"\A(?:{whole})\z", *[re.escape(n) for n in lower if len(n) > 3], *[rf"\A{n}[ .]| {n}\z" for n in short]]
    return "|".join(parts)


def meaning(heading: Column, aliases: dict[str, tuple[str, ...]] = ALIASES) -> Column:
    """The place (in the aliases' order) of the field that meanings() gives to a heading; null if it has none. Texts that are an alias are looked up; others are tried by a pattern for each field, if they have two letters side by side, as every alias has: lots such as L12 haven't."""
    known = _exact(aliases)
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), heading)
    tried = F.coalesce(*[F.when(heading.rlike(_pattern(field, names)), F.lit(k)) for k, (field, names) in enumerate(aliases.items())])
    return F.when(heading.isin(*known), found).when(heading.rlike("[a-z][a-z]"), tried)


def first_values(rows: DataFrame) -> DataFrame:
    """From tables' rows (doc_id, tbl, row, texts by column): doc_id, firsts (k, the field's place in ALIASES, and value: the first of candidates() for each field, in order of table, row and column, and maybe others behind it) and weight (as in weights()). One pass over the rows, which stay whole: below the first row under a heading only cells of fields that have no value yet are looked at, and only rows that are the first to have a field are listed."""
    field = lambda t: once(F.lower(stripped(t)), lambda h: meaning(h))
    weighs = lambda t: F.exists(F.array(*[F.lit(w) for w in WEIGHT_HEADINGS]), lambda w: F.contains(F.lower(stripped(t)), w))
    rows = rows.where("doc_id IS NOT NULL AND tbl IS NOT NULL").withColumns({"fields": F.when(F.col("row") < HEADING_ROWS, F.transform("texts", field)), "weighs": F.when(F.col("row") == 0, F.array_position(F.transform("texts", weighs), F.lit(True)).cast("int"))})
    rows = rows.withColumn("n", F.size(F.filter("fields", lambda f: f.isNotNull())))
    one_table = Window.partitionBy("doc_id", "tbl").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"head": F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("row")).alias("place"), "fields"))).over(one_table), "weighs": F.max(F.when(F.col("weighs") > 0, F.col("weighs"))).over(one_table)})
    names = [k for k, f in enumerate(ALIASES) if f in NUMBERED]
    bit = lambda k: F.call_function("shiftleft", F.lit(1), k)
    value = lambda t, k: once(stripped(t), lambda v: F.when((v != "") & ~F.lower(v).isin(*echoes()) & ~(k.isin(*names) & v.rlike("^[0-9]{1,3}$")), F.struct(k.alias("k"), v.alias("value"))))

    def found(unless: Column) -> Column:
        """The cells of a row that are values of fields whose bits aren't set."""
        cell = lambda t, i: once(F.get("head.fields", i), lambda k: F.when(k.isNotNull() & (unless.bitwiseAND(bit(k)) == 0), value(t, k)))
        return F.array_compact(F.transform("texts", cell))

    bits = lambda cells: F.reduce(cells, F.lit(0), lambda out, x: out.bitwiseOR(bit(x["k"])))
    above = lambda c: F.coalesce(F.bit_or(c).over(Window.partitionBy("doc_id").orderBy("tbl", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = number(F.replace(stripped(F.get("texts", F.col("weighs") - 1)), F.lit(","), F.lit(""))).cast("decimal(20,4)")
    below = F.col("row") + F.col("head.place")  # how far below the heading
    rows = rows.select("doc_id", "tbl", "row", "texts", "head", F.when(F.col("row") > 0, weight).alias("weight"), F.when(below == 1, found(F.lit(0))).alias("found"))
    rows = rows.withColumn("has", bits("found")).withColumn("above", above("has"))
    rows = rows.select("doc_id", "tbl", "row", "weight", F.when(below == 1, F.col("found")).when(below > 1, found(F.col("above"))).alias("found"))
    rows = rows.withColumn("has", bits("found")).withColumn("above", above("has"))
    first = F.when(F.col("has").bitwiseAND(F.bitwise_not("above")) != 0, F.struct("tbl", "row", "found"))
    rows = rows.select("doc_id", first.alias("first"), F.when(F.col("weight") > 0, F.col("weight")).alias("weight"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("first")).alias("listed"), F.sum("weight").alias("weight"))
    return listed.select("doc_id", F.flatten(F.transform("listed", lambda x: x["found"])).alias("firsts"), "weight")


def signature_meanings(texts: DataFrame, signature: dict[str, tuple[str, ...]]) -> DataFrame:
    """heading (distinct) and the first field of a signature with an alias that holds it or that it holds."""
    either = F.contains(F.col("heading"), F.col("alias")) | F.contains(F.col("alias"), F.col("heading"))
    known = "\n".join(n.lower() for names in signature.values() for n in names)
    possible = F.col("heading").rlike("[a-z]") | F.contains(F.lit(known), F.col("heading"))  # as every alias has a letter
    found = texts.select("heading").where(possible).distinct().join(F.broadcast(alias_table(texts.sparkSession, signature)), either)
    return found.groupBy("heading").agg(F.min_by("field", "field_ord").alias("field"))


def signed_headings(cells: DataFrame) -> DataFrame:
    """headings() with double blanks made single, as the signatures are written."""
    return headings(cells).withColumn("heading", F.replace("heading", F.lit("  "), F.lit(" ")))


def weights(cells: DataFrame) -> DataFrame:
    """doc_id and weight (a decimal): the sum of the positive numbers below the first heading of a net weight in each table's first row. Documents whose tables have none aren't there."""
    means = F.exists(F.array(*[F.lit(w) for w in WEIGHT_HEADINGS]), lambda w: F.contains(F.lower(stripped(F.col("text"))), w))
    columns = cells.where((F.col("row") == 0) & means).groupBy("doc_id", "tbl").agg(F.min("col").alias("col"))
    value = number(F.replace(stripped(F.col("text")), F.lit(","), F.lit("")))
    rows = cells.where("row > 0").join(columns, ["doc_id", "tbl", "col"]).select("doc_id", value.cast("decimal(20,4)").alias("value")).where("value > 0")
    return rows.groupBy("doc_id").agg(F.sum("value").alias("weight"))


def signatures(cells: DataFrame) -> DataFrame:
    """For each table of two rows or more: how many signature fields of rolls and of lots its first rows match (either text holding the other). One pass over the cells: a table's fields are bits of a number."""
    named = F.col("doc_id").isNotNull() & F.col("tbl").isNotNull()  # what isn't named scores nothing
    heading = F.when(named & (F.col("row") < HEADING_ROWS) & (F.coalesce("text", F.lit("")) != ""), F.nullif(F.replace(F.lower(stripped(F.col("text"))), F.lit("  "), F.lit(" ")), F.lit("")))
    own, rows = signed_headings(cells), cells.select("doc_id", "tbl", "row", heading.alias("heading"))
    scores = []
    for name, signature in (("roll", ROLL_SIGNATURE), ("lot", LOT_SIGNATURE)):
        bits = F.coalesce(*[F.when(F.col("field") == f, F.lit(1 << k)) for k, f in enumerate(signature)])
        rows = rows.join(to_every_task(signature_meanings(own, signature).select("heading", bits.alias(name))), "heading", "left")
        scores.append(F.coalesce(F.bit_count(F.bit_or(name)), F.lit(0)).cast("long").alias(f"{name}_score"))
    found = rows.groupBy("doc_id", "tbl").agg(F.max("row").alias("last"), *scores).where("last >= 1")
    return found.select("doc_id", "tbl", "roll_score", "lot_score")


def largest(cells: DataFrame) -> DataFrame:
    """The table of each document with the most rows (the first of several)."""
    sizes = cells.groupBy("doc_id", "tbl").agg(F.count_distinct("row").alias("n_rows"))
    return sizes.groupBy("doc_id").agg(F.max_by("tbl", F.struct("n_rows", -F.col("tbl"))).alias("tbl"), F.max("n_rows").alias("n_rows"))


def markdown(cells: DataFrame) -> DataFrame:
    """Each table as text: cells parted by " | ", rows filled up to the widest, a rule after the first."""
    width = Window.partitionBy("doc_id", "tbl")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ")
    rows = cells.groupBy("doc_id", "tbl", "row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("text")))).alias("cells"), (F.max("col") + 1).alias("n"))
    rows = rows.withColumn("wide", F.max("n").over(width))
    values = F.map_from_entries("cells")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda k: F.coalesce(F.try_element_at(values, k), F.lit(""))), " | ")
    line = F.when(F.col("row") == 0, F.concat(line, F.lit("\n---"))).otherwise(line)
    listed = F.array_sort(F.collect_list(F.struct("row", line.alias("line"))))
    return rows.groupBy("doc_id", "tbl").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("markdown"))


#: A column whose mean is this many times a length's holds the same lengths in yards.
YARDS = (1.08, 1.11)


def column_roles(cells: DataFrame) -> DataFrame:
    """doc_id, tbl, col and a role from the column's values, for tables without headings that are known: length (numbers from 10 to 500), length_yds (beside a length that is 9 % smaller), roll_no (long or consecutive figures), weight (larger numbers; of several the smallest is net_weight, the others weight_gross), lot (few values that repeat), other."""
    value = F.col("text").try_cast("double")
    stats = cells.where(F.coalesce("text", F.lit("")) != "").groupBy("doc_id", "tbl", "col").agg(
        F.count("*").alias("n"), F.count(value).alias("n_numbers"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.count_distinct("text").alias("n_distinct"), F.min(F.length("text")).alias("shortest")
    )
    numeric = F.col("n_numbers") == F.col("n")
    consecutive = (F.col("most") - F.col("least") + 1 == F.col("n")) & (F.col("n_distinct") == F.col("n")) & (F.col("least") <= 1)
    role = F.when(numeric & ((F.col("shortest") >= 6) | consecutive), F.lit("roll_no")).when(numeric & F.col("least").between(10, 500) & F.col("most").between(10, 550), F.lit("length")).when(numeric & (F.col("most") > 500), F.lit("weight")).when(~numeric & (F.col("n_distinct") * 2 <= F.col("n")), F.lit("lot")).otherwise(F.lit("other"))
    same = Window.partitionBy("doc_id", "tbl", "role")  # a table's columns
    rows = stats.select("doc_id", "tbl", "col", "mean", role.alias("role"))
    rows = rows.withColumns({"means": F.collect_list("mean").over(same), "least_mean": F.min("mean").over(same), "n_same": F.count("*").over(same)})
    is_yards = (F.col("role") == "length") & F.exists("means", lambda m: (F.col("mean") / m).between(*YARDS))
    is_weight = (F.col("role") == "weight") & (F.col("n_same") > 1)
    finer = F.when(is_yards, F.lit("length_yds")).when(is_weight & (F.col("mean") == F.col("least_mean")), F.lit("net_weight")).when(is_weight, F.lit("weight_gross")).otherwise(F.col("role"))
    return rows.select("doc_id", "tbl", "col", finer.alias("role"))


def known_columns(headings_: DataFrame) -> DataFrame:
    """code, heading and field of headings (code of the supplier, heading) that the supplier's tables are known to have: an equi-join with a fixed table."""
    rows = [(code, heading, field) for code, names in SUPPLIER_COLUMNS.items() for heading, field in names.items()]
    known = headings_.sparkSession.createDataFrame(rows, "code string, known string, field string")
    found = headings_.withColumn("known", F.lower(stripped(F.col("heading"))))
    return found.join(F.broadcast(known), ["code", "known"]).drop("known")


def supplier_lines(cells: DataFrame, codes: DataFrame) -> DataFrame:
    """Rolls of known suppliers' tables (cells with headings in row 0; codes: doc_id, code): doc_id, tbl, seq and the line's attributes.

    Rows without a roll number, and totals, are no rolls. Lots that are blank or ditto marks go on from the row above. PEN's shade holds the lot after its name, and its rolls have no weight of their own where a carton's total has it; SFM's grade is the shade wherever there is one.
    """
    heads = known_columns(cells.where("row = 0").join(codes, "doc_id").select("doc_id", "tbl", "col", "code", F.col("text").alias("heading")))
    heads = heads.where("tbl IS NOT NULL").groupBy("doc_id", "code", "tbl").agg(F.collect_list(F.struct("col", "field")).alias("fields"))
    heads = heads.groupBy("doc_id", "code").agg(F.map_from_entries(F.collect_list(F.struct("tbl", "fields"))).alias("heads"))
    # By doc_id alone: cells that are dealt by document aren't shuffled.
    body = cells.where("row > 0").join(heads, "doc_id").withColumn("fields", F.filter(F.try_element_at("heads", "tbl"), lambda x: x["col"] == F.col("col")))
    body = body.select("doc_id", "tbl", "row", "code", "text", F.explode("fields.field").alias("field"))
    texts = {f: nonempty(stripped(F.max(F.when(F.col("field") == f, F.col("text"))))).alias(f) for f in ("lot", "color", "grade", "piece_number", "meters", "length_yds", "points_per_roll", "points_per_100m2", "weight_gross_kgs", "net_weight")}
    rows = body.groupBy("doc_id", "tbl", "code", F.col("row").alias("seq")).agg(*texts.values())
    rows = rows.where(F.col("piece_number").isNotNull() & ~F.lower("piece_number").rlike(SUMMARY_ROW))
    upto = Window.partitionBy("doc_id", "tbl").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    shade, lot = shade_and_lot(F.col("color"))
    pen, sfm = F.col("code") == "PEN", F.col("code") == "SFM"
    lots = F.coalesce(F.last(explicit(F.col("lot")), ignorenulls=True).over(upto), F.when(pen, lot))
    color = F.when(pen, F.coalesce(shade, F.col("color"))).when(sfm, F.coalesce("grade", "color")).otherwise(F.col("color"))
    numbers = [clean_number(F.col(c)).alias(c) for c in ("meters", "length_yds", "points_per_roll", "points_per_100m2", "weight_gross_kgs", "net_weight")]
    return rows.select("doc_id", "tbl", "seq", lots.alias("lot"), color.alias("color"), "piece_number", *numbers)
