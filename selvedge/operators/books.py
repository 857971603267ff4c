"""Roll tables that run over several pages: one table from the pieces, each roll once, with its section's PO number, its carton's total, and totals told from rolls.

Cells are (doc_id, page, tbl, row, col, text), tables counted on their page. Lines of running text are (doc_id, page, tbl, seq, line): they stand above the table `tbl` of their page. Everything is windows within a document over rows that are dealt out once, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.fixed import SUMMARY_ROW, SUPPLIER_COLUMNS
from ..functions.text import leading_number, leading_value, nonempty, once, stripped
from .extraction import heading_names
from .rolls import shade_and_lot, unmarked

#: One of the first rows of a table is its heading if so many of its cells have known names.
LEAST_HEADINGS, HEADING_ROWS = 3, 3
#: A line that opens a section of a PO number.
SECTION = r"(?i)^\s*(?:PO|P\.O\.)\s*(?:#|NO\.?)\s*[:.]?\s*([A-Z0-9][A-Z0-9-]*)"
#: Taken from a line's number, so that it stands above its table's rows in the same order.
LINES_FIRST = 1 << 60
TEXTS = ("lot", "color", "grade", "piece_number", "quality", "po_number")
NUMBERS = ("meters", "length_yds", "points_per_roll", "points_per_100m2", "weight_gross_kgs", "net_weight")


def in_order() -> WindowSpec:
    """A document's table rows in order."""
    return Window.partitionBy("doc_id").orderBy("page", "page_tbl", "page_row")


def above() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def known_names() -> list[str]:
    """Headings (lower case) of any supplier's roll table."""
    return sorted({*heading_names(), *(name for names in SUPPLIER_COLUMNS.values() for name in names)})


def table_rows(cells: DataFrame) -> DataFrame:
    """A row for each row of each table: doc_id, page, page_tbl, page_row, texts (by column; null where there is no cell). Of cells at one place the greatest text stays. Cells that come dealt by document (as from a window over it) aren't dealt again."""
    rows = cells.groupBy("doc_id", "page", F.col("tbl").alias("page_tbl"), F.col("row").alias("page_row")).agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"), F.max("col").alias("last"))
    cell = F.col("cells")
    dense = (F.size(cell) == F.col("last") + 1) & F.forall(F.sequence(F.lit(0), F.col("last")), lambda k: F.get(cell, k)["col"] == k)
    greatest = F.filter(cell, lambda x, i: F.coalesce(F.get(cell, i + 1)["col"] != x["col"], F.lit(True)))
    sparse = once(F.map_from_entries(greatest), lambda m: F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.try_element_at(m, k)))
    return rows.select("doc_id", "page", "page_tbl", "page_row", F.when(dense, F.col("cells.text")).otherwise(sparse).alias("texts"))


def streamed(cells: DataFrame, lines: DataFrame | None = None, pattern: str = SECTION) -> DataFrame:
    """Rows of tables and the section headings among the lines in one ordered stream: doc_id, page, page_tbl, page_row, texts (null for a heading), own_section (a heading's PO number). Cells may come as whole rows (texts instead of col and text) and have other columns of their document; rows that have a line instead of texts are lines of running text, at row. Lines of a frame of their own meet the rows by one union, however many sections a document has."""
    if "texts" not in cells.columns:
        return _with_lines(table_rows(cells), lines, pattern)
    rows = cells.withColumnsRenamed({"tbl": "page_tbl", "row": "page_row"})
    if "line" not in cells.columns:
        return _with_lines(rows, lines, pattern)
    row = F.when(F.col("texts").isNull(), F.col("page_row").cast("long") - LINES_FIRST).otherwise(F.col("page_row"))
    rows = rows.withColumns({"page_row": row, "own_section": nonempty(F.regexp_extract("line", pattern, 1))}).drop("line")
    return rows.where("texts IS NOT NULL OR own_section IS NOT NULL")


def _with_lines(rows: DataFrame, lines: DataFrame | None, pattern: str) -> DataFrame:
    rows = rows.withColumn("own_section", F.lit(None).cast("string"))
    if lines is None:
        return rows
    found = lines.select("doc_id", "page", F.col("tbl").alias("page_tbl"), (F.col("seq").cast("long") - LINES_FIRST).alias("page_row"), nonempty(F.regexp_extract("line", pattern, 1)).alias("own_section")).where("own_section IS NOT NULL")
    return rows.withColumn("page_row", F.col("page_row").cast("long")).unionByName(found, allowMissingColumns=True)


def stitched(cells: DataFrame, lines: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """Rows of tables (see streamed) with tbl (a document's tables, counted over its pages), heading (names by column, in lower case; null for a table that has none), places (where the heading has each of TEXTS and NUMBERS, from 1; 0 where it hasn't), section (the PO number of the last section heading above them, null above the first) and section_no (how many stand above) and cells (texts, stripped, nulls blank), without headings and what stands above them. codes: doc_id, code of known suppliers.

    A table goes on on the next page (or after a break) if it has the same heading, or none and as many columns as the one before. Headings that are repeated, between tables or within one, go. Only rows with enough known names are looked at as headings, and only a table's first heading is understood; it hands its places down.
    """
    rows = streamed(cells, lines)
    if codes is not None:
        rows = rows.join(codes.select("doc_id", "code"), "doc_id", "left")
    elif "code" not in rows.columns:
        rows = rows.withColumn("code", F.lit(None).cast("string"))
    is_row = F.col("texts").isNotNull()
    rows = rows.withColumn("cells", F.transform("texts", lambda t: stripped(F.coalesce(t, F.lit("")))))
    rows = rows.withColumn("n_known", F.when(is_row, F.size(F.filter("cells", lambda t: F.lower(t).isin(*known_names())))))
    rows = rows.withColumn("names", F.when(F.col("n_known") >= LEAST_HEADINGS, F.transform("cells", F.lower)))
    # In the document's order as well, so that one sort serves all windows.
    one_table = Window.partitionBy("doc_id", "page", "page_tbl").orderBy("page_row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"width": F.max(F.when(is_row, F.size("texts"))).over(one_table), "first_row": F.min(F.when(is_row, F.col("page_row"))).over(one_table)})
    heading = F.when((F.col("n_known") >= LEAST_HEADINGS) & (F.col("page_row") < F.col("first_row") + HEADING_ROWS), F.struct("n_known", (-F.col("page_row")).alias("place")))
    rows = rows.withColumn("head_row", -F.max(heading).over(one_table)["place"])
    own = F.when(F.col("page_row") == F.col("head_row"), F.col("names"))
    last = lambda x, over: F.last(x, ignorenulls=True).over(over())
    rows = rows.withColumn("own", own).withColumns({
        "before": last("own", above), "width_before": last(F.when(is_row, F.col("width")), above),
        "section": last("own_section", so_far), "section_no": F.count("own_section").over(so_far()).cast("int"),
    })
    new_head = F.col("own").isNotNull() & (F.col("before").isNull() | (F.col("before") != F.col("own")))
    new_bare = F.col("head_row").isNull() & (F.col("page_row") == F.col("first_row")) & (F.col("width_before").isNull() | (F.col("width_before") != F.col("width")))
    rows = rows.withColumn("begins", is_row & (new_head | new_bare))
    rows = rows.withColumn("attributes", F.when(F.col("begins"), _attributes(F.col("code"), F.col("own"))))
    places = F.array(*[F.array_position("attributes", F.lit(a)).cast("int") for a in (*TEXTS, *NUMBERS)])
    rows = rows.withColumn("opened", F.when(F.col("begins"), F.struct("own", F.when(F.col("attributes").isNotNull(), places).alias("places"))))
    rows = rows.withColumns({"tbl": F.count_if("begins").over(so_far()) - 1, "opened": last("opened", so_far)})
    body = F.col("head_row").isNull() | (F.col("page_row") > F.col("head_row"))
    repeated = F.coalesce(F.col("names") == F.col("opened.own"), F.lit(False))
    return rows.where(is_row & body & ~repeated).select("doc_id", "page", "page_tbl", "page_row", F.col("tbl").cast("int").alias("tbl"), F.col("opened.own").alias("heading"), F.col("opened.places").alias("places"), "texts", "cells", "code", "section", "section_no")


def page_lines(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines for streamed() from whole pages' text (doc_id, page_number, raw_text), where nobody knows which table a line stands above: of a page with m tables and h section headings, the headings belong to the last h tables in order, since each section has a table of its own and only a page's first may go on from the page before; those that are too many stand above the first."""
    lines = pages.select("doc_id", F.col("page_number").alias("page"), F.posexplode(F.split("raw_text", r"\r\n|\n|\r")).alias("seq", "line"))
    lines = lines.where(F.regexp_extract("line", SECTION, 1) != "")
    on_page = Window.partitionBy("doc_id", "page")
    lines = lines.withColumns({"place": F.row_number().over(on_page.orderBy("seq")) - 1, "n_lines": F.count("*").over(on_page)})
    counts = cells.groupBy("doc_id", "page").agg(F.count_distinct("tbl").alias("n_tables"))
    tbl = F.greatest(F.coalesce("n_tables", F.lit(0)) - F.col("n_lines") + F.col("place"), F.lit(0))
    return lines.join(counts, ["doc_id", "page"], "left").select("doc_id", "page", tbl.cast("int").alias("tbl"), "seq", "line")


def _attributes(code: Column, heading: Column) -> Column:
    """What each name of a heading means: for a known supplier as its tables have it, else by the names of all."""
    as_map = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    general = as_map(heading_names())
    own = F.lit(None).cast("map<string,string>")
    for name, columns in SUPPLIER_COLUMNS.items():
        own = F.when(code == name, as_map(columns)).otherwise(own)
    return F.transform(heading, lambda n: F.when(own.isNotNull(), F.try_element_at(own, n)).otherwise(F.try_element_at(general, n)))


def wide(rows: DataFrame) -> DataFrame:
    """Rows of stitched() that have a heading, with the attributes that it means (the first column of several that mean one). numbered: whether the table has roll numbers. Each step reads columns of the one before, so that a cell is found, stripped and read once."""
    at = {a: F.get("places", F.lit(k)) for k, a in enumerate((*TEXTS, *NUMBERS))}
    rows = rows.where("places IS NOT NULL").withColumns({a: F.when(k > 0, nonempty(F.get("cells", k - 1))) for a, k in at.items()} | {"numbered": at["piece_number"] > 0})
    return rows.withColumns({a: leading_number(F.col(a)) for a in NUMBERS}).withColumns({a: leading_value(F.col(a)) for a in NUMBERS})


def classified(rows: DataFrame) -> DataFrame:
    """Rows of wide() with kind: roll; summary (a total by its label); count (a row whose roll number only counts the rolls above it, in its block or the document); blank (no roll number where the table has such a column, or nothing at all); and carton (how many summaries stand above it in the document).

    A block ends with a total or where a section begins. A number that goes on a sequence (one more than the row's above) isn't a count, unless its meters are the block's sum.
    """
    rows = rows.withColumns({"number": F.when(F.col("piece_number").rlike("^[0-9]{1,9}$"), F.col("piece_number").cast("long")), "shown": F.lower(F.array_join("cells", " "))})
    # Few rows hold the words of a total; only their cells are tried one by one.
    labelled = F.exists("cells", lambda t: F.lower(t).rlike(SUMMARY_ROW))
    summary = F.when(F.contains("shown", F.lit("total")) | F.contains("shown", F.lit("summary")), labelled).otherwise(F.lit(False))
    missing = (F.col("numbered") & F.col("piece_number").isNull()) | (F.trim("shown") == "")
    rows = rows.withColumn("first_kind", F.when(summary, F.lit("summary")).when(missing, F.lit("blank")).otherwise(F.lit("roll"))).drop("shown")
    like_roll, totals = F.col("first_kind") == "roll", F.col("first_kind") == "summary"
    rows = rows.withColumn("exact", F.col("meters").cast("decimal(18,2)"))
    meters = F.when(like_roll, F.col("exact"))
    first = F.lag(F.struct("section_no", totals.alias("total"))).over(in_order())
    rows = rows.withColumns({"carton": F.count_if(totals).over(above()), "rolls_above": F.count_if(like_roll).over(above()), "n_meters": F.count(meters).over(above()), "sum_meters": F.coalesce(F.sum(meters).over(above()), F.lit(0).cast("decimal(28,2)")), "row_before": first})
    # Blocks follow one another, so what is above a row in its block is what is above it in all, less what was above the block's first row.
    rows = rows.withColumn("block", F.struct("section_no", "carton"))
    opens = F.col("row_before").isNull() | F.col("row_before.total") | (F.col("row_before.section_no") != F.col("section_no"))
    rows = rows.withColumn("begun", F.when(opens, F.struct("rolls_above", "n_meters", "sum_meters")))
    numbered = F.when(like_roll & F.col("number").isNotNull(), F.struct("block", "number"))
    rows = rows.withColumns({"begun": F.last("begun", ignorenulls=True).over(so_far()), "last_number": F.last(numbered, ignorenulls=True).over(above())})
    in_block = lambda c: F.col(c) - F.col(f"begun.{c}")
    rows = rows.withColumns({"above": in_block("rolls_above"), "meters_above": F.when(in_block("n_meters") > 0, in_block("sum_meters")), "number_above": F.when(F.col("last_number.block") == F.col("block"), F.col("last_number.number"))})
    goes_on = F.coalesce(F.col("number") == F.col("number_above") + 1, F.lit(False))
    is_sum = F.coalesce((F.abs(F.col("exact") - F.col("meters_above")) <= 0.01) & (F.col("above") > 1), F.lit(False))
    counts_block = like_roll & (F.col("above") > 0) & F.coalesce(F.col("number") == F.col("above"), F.lit(False)) & (~goes_on | is_sum)
    rows = rows.withColumn("counts_block", counts_block)
    rows = rows.withColumn("above_all", F.count_if(like_roll & ~F.col("counts_block")).over(above()))
    counts_all = like_roll & (F.col("above_all") > 1) & F.coalesce(F.col("number") == F.col("above_all"), F.lit(False)) & ~goes_on
    kind = F.when(F.col("counts_block") | counts_all, F.lit("count")).otherwise(F.col("first_kind"))
    return rows.withColumn("kind", kind).drop("first_kind", "exact", "row_before", "block", "rolls_above", "n_meters", "sum_meters", "begun", "last_number", "above", "meters_above", "number_above", "counts_block", "above_all", "number")


def left_out(rows: DataFrame) -> DataFrame:
    """doc_id, page, page_tbl, page_row, reason and content of the rows of classified() that are no rolls."""
    reason = F.when(F.col("kind") == "summary", F.lit("total by its label")).when(F.col("kind") == "count", F.lit("number counts the rolls above")).otherwise(F.lit("no roll number"))
    return rows.where("kind <> 'roll'").select("doc_id", "page", "page_tbl", "page_row", reason.alias("reason"), F.array_join(F.transform("texts", lambda t: F.coalesce(t, F.lit(""))), " | ").alias("content"))


def with_cartons(rows: DataFrame) -> DataFrame:
    """Rows of classified() with carton (counted in the document, from 0) and the numbers of the total below it: carton_gross, carton_net (null below the last total). The total below is the last one from the end upwards."""
    upwards = Window.partitionBy("doc_id").orderBy(F.desc("page"), F.desc("page_tbl"), F.desc("page_row")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("kind") == "summary"
    below = F.last(F.when(total, F.struct("weight_gross_kgs", "net_weight")), ignorenulls=True).over(upwards)
    return rows.withColumns({"carton": F.col("carton").cast("int"), "below": below}).withColumns({"carton_gross": F.col("below.weight_gross_kgs"), "carton_net": F.col("below.net_weight")}).drop("below")


def rolls_of(rows: DataFrame) -> DataFrame:
    """The rolls among the rows of with_cartons(): doc_id, seq (in the document, from 1), page, tbl, page_tbl, page_row, lot, po_number, piece_number, color, quality, numbers, carton, carton_gross, carton_net.

    Blank lots, shades and qualities and ditto marks go on from the row above, over pages; the PO number is the row's own or its section's; PEN's shade holds the lot behind its name, SFM's grade is the shade where there is one. A table without roll numbers numbers its rolls by their place in the document. Rows at different places are different rolls, whatever their numbers; cells that were read twice at one place are one.
    """
    kept = rows.where("kind = 'roll'")
    carried = lambda c: F.last(unmarked(F.col(c)), ignorenulls=True).over(so_far())
    shade, lot = shade_and_lot(F.col("color"))
    pen, sfm = F.coalesce(F.col("code") == "PEN", F.lit(False)), F.coalesce(F.col("code") == "SFM", F.lit(False))
    color = F.when(pen, F.coalesce(shade, F.col("color"))).when(sfm, F.coalesce("grade", "color")).otherwise(unmarked(F.col("color")))
    seq = F.row_number().over(in_order())
    return kept.select(
        "doc_id", seq.cast("long").alias("seq"), "page", "tbl", "page_tbl", "page_row",
        F.coalesce(carried("lot"), F.when(pen, lot)).alias("lot"),
        F.coalesce(unmarked(F.col("po_number")), "section").alias("po_number"),
        F.coalesce("piece_number", seq.cast("string")).alias("piece_number"),
        color.alias("color"), carried("quality").alias("quality"), *NUMBERS, "carton", "carton_gross", "carton_net",
    )


def classified_rows(cells: DataFrame, lines: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """From cells to classified rows: pieces stitched, sections from running text where it is there, attributes, kinds, cartons."""
    return with_cartons(classified(wide(stitched(cells, lines, codes))))


def rolls(cells: DataFrame, lines: DataFrame | None = None, codes: DataFrame | None = None) -> DataFrame:
    """All rolls of the documents' tables (see rolls_of)."""
    return rolls_of(classified_rows(cells, lines, codes))


def rollups(own: DataFrame) -> DataFrame:
    """Sums of rolls by document, by PO and by lot: doc_id, level (document, po, lot), value (null for the document), pieces, meters, net_weight. One pass by grouping sets; rolls without a PO or lot are in the document's only."""
    total = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).alias(c)
    sums = own.groupingSets([[F.col("doc_id")], [F.col("doc_id"), F.col("po_number")], [F.col("doc_id"), F.col("lot")]], "doc_id", "po_number", "lot").agg(F.grouping("po_number").alias("no_po"), F.grouping("lot").alias("no_lot"), F.count("*").alias("pieces"), total("meters"), total("net_weight"))
    level = F.when((F.col("no_po") == 1) & (F.col("no_lot") == 1), F.lit("document")).when(F.col("no_po") == 0, F.lit("po")).otherwise(F.lit("lot"))
    out = sums.select("doc_id", level.alias("level"), F.coalesce("po_number", "lot").alias("value"), "pieces", "meters", "net_weight")
    return out.where("level = 'document' OR value IS NOT NULL")


def stated_totals(rows: DataFrame) -> DataFrame:
    """Each total of classified() with what it states and what the rolls above it come to: doc_id, page, page_tbl, page_row, label, pieces_block and meters_block (since the last total), pieces_so_far and meters_so_far (in the document), meters_stated, differs (it states meters that are neither's sum)."""
    roll = F.col("kind") == "roll"
    meters = F.sum(F.when(roll, F.col("meters").cast("decimal(18,2)"))).over(so_far())
    rows = rows.withColumns({"pieces_so_far": F.count_if(roll).over(so_far()), "meters_so_far": F.coalesce(meters, F.lit(0).cast("decimal(28,2)"))})
    totals = rows.where("kind IN ('summary', 'count')")
    label = F.coalesce(F.get(F.filter("texts", lambda t: F.coalesce(F.lower(t).rlike(SUMMARY_ROW), F.lit(False))), F.lit(0)), "piece_number")
    before = lambda c: F.col(c) - F.coalesce(F.lag(c).over(in_order()), F.lit(0))
    totals = totals.withColumns({"pieces_block": before("pieces_so_far"), "meters_block": before("meters_so_far")})
    stated = F.col("meters").cast("decimal(18,2)")
    differs = stated.isNotNull() & (stated != F.col("meters_block")) & (stated != F.col("meters_so_far"))
    return totals.select("doc_id", "page", "page_tbl", "page_row", label.alias("label"), "pieces_block", "meters_block", "pieces_so_far", "meters_so_far", stated.alias("meters_stated"), differs.alias("differs"))
