"""Rolls from the running text of roll tables: columns parted by two blanks or more (or by |), headings found by name, ditto marks, section headings and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ALIASES, LOT_SIGNATURE, ROLL_SIGNATURE, SUMMARY_ROW
from ..functions.text import leading_number, leading_value, nonempty, stripped, visible_ends
from .rolls import in_order, section_value, so_far, unmarked

COLUMN_GAP = r"\s*\|\s*|\s{2,}"
#: A line is a heading if so many of its columns have known names.
LEAST_HEADINGS = 3
TEXTS, NUMBERS = ("lot", "color", "quality", "po_number", "piece_number"), ("meters", "net_weight", "weight_gross_kgs")


def heading_names() -> dict[str, str]:
    """Attribute of a roll by heading (lower case). A name that several lists have means the first one's."""
    lists = (
        ("piece_number", ROLL_SIGNATURE["roll_no"]),
        ("meters", ROLL_SIGNATURE["length_mts"]),
        ("weight_gross_kgs", ROLL_SIGNATURE["weight_gross_kgs"]),
        ("net_weight", ROLL_SIGNATURE["weight_nett_kgs"]),
        ("lot", LOT_SIGNATURE["lot"]),
        *((field, ALIASES[field]) for field in ("lot", "color", "meters", "net_weight", "quality", "po_number")),
    )
    out: dict[str, str] = {}
    for attribute, names in lists:
        for name in names:
            out.setdefault(name.lower(), attribute)
    return out


def lines_of(texts: DataFrame, column: str = "full_text") -> DataFrame:
    """doc_id, seq, line of each document's text."""
    text = F.col(column)
    lines = F.when(F.contains(text, F.lit("\r")), F.split(text, r"\r\n|\n|\r")).otherwise(F.split(text, "\n"))
    return texts.select("doc_id", F.posexplode(lines).alias("seq", "line"))


def cells_of(line: Column) -> Column:
    """The columns of a line. Every | is part of a gap, so gaps become single ones, at which a split needs no pattern."""
    bare = F.when(visible_ends(line), line).otherwise(F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.split(F.regexp_replace(bare, COLUMN_GAP, "|"), r"\|")


def attribute_of(heading: Column) -> Column:
    """The attribute that a heading (lower case) names; null where it names none."""
    names: dict[str, list[str]] = {}
    for name, attribute in heading_names().items():
        names.setdefault(attribute, []).append(name)
    return F.coalesce(*[F.when(heading.isin(*known), F.lit(attribute)) for attribute, known in names.items()])


def extracted(lines: DataFrame) -> DataFrame:
    """Rolls (doc_id, seq, lot, po_number, piece_number, color, quality, meters, net_weight, weight_gross_kgs) from lines (doc_id, seq, line).

    A heading holds until the next one of its document. Lots, shades and qualities that are blank or ditto marks go on from the row above; PO numbers come from their column or the section's heading; totals are no rolls; a roll without a number gets its place. Two windows by document, no join.

    Headings are looked up in sets, and only they get attributes. What they hand down is the places of the attributes; each step reads columns of the one before, so that a cell is found, stripped and read once.
    """
    known = F.size(F.filter("cells", lambda c: F.lower(c).isin(*heading_names())))
    rows = lines.select("doc_id", "seq", section_value("line").alias("own_section"), cells_of(F.col("line")).alias("cells"))
    rows = rows.withColumn("is_heading", F.col("own_section").isNull() & (F.size("cells") >= LEAST_HEADINGS) & (known >= LEAST_HEADINGS))
    rows = rows.withColumn("attributes", F.when(F.col("is_heading"), F.transform(F.transform("cells", F.lower), attribute_of)))
    places = F.struct(*[F.array_position("attributes", F.lit(a)).cast("int").alias(a) for a in (*TEXTS, *NUMBERS)])
    rows = rows.select("doc_id", "seq", "own_section", "cells", "is_heading", F.when(F.col("is_heading"), places).alias("places"))
    rows = rows.select("*", F.last("own_section", ignorenulls=True).over(so_far()).alias("section"), F.last("places", ignorenulls=True).over(so_far()).alias("heading"))

    body = rows.where(F.col("own_section").isNull() & F.col("heading").isNotNull() & ~F.col("is_heading") & (F.size("cells") > 1) & ~F.lower(F.get("cells", F.lit(0))).rlike(SUMMARY_ROW))
    body = body.select("doc_id", "seq", "section", *[F.get("cells", F.col(f"heading.{a}") - 1).alias(a) for a in (*TEXTS, *NUMBERS)])
    body = body.withColumns({a: stripped(F.col(a)) for a in TEXTS} | {a: leading_number(F.col(a)) for a in NUMBERS})

    carried = {a: F.last(unmarked(F.col(a)), ignorenulls=True).over(so_far()) for a in ("lot", "color", "quality", "po_number")}
    po = F.coalesce(carried.pop("po_number"), F.col("section")).alias("po_number")
    piece = F.coalesce(nonempty(F.col("piece_number")), F.row_number().over(in_order()).cast("string")).alias("piece_number")
    return body.select("doc_id", F.col("seq").cast("long").alias("seq"), *[c.alias(a) for a, c in carried.items()], po, piece, *[leading_value(F.col(a)).alias(a) for a in NUMBERS])
