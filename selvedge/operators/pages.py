"""Pages of a document (doc_id, page_number, raw_text, and what is found on them): kinds of pages, choice of key pages, the document's text, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import HEADER_WORDS, ITEM_WORDS, LOT_WORDS, ROLL_WORDS, SUMMARY_WORDS
from ..functions.text import stripped

#: A page with fewer characters was scanned; up to SHORT it can be a summary or a header, up to HEADER a header.
LEAST_TEXT, SHORT, HEADER = 20, 800, 1500


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def needs_ocr(text: Column) -> Column:
    return F.length(stripped(F.coalesce(text, F.lit("")))) < LEAST_TEXT


def kind(text: Column, has_tables: Column) -> Column:
    """summary, header or item_table; scanned where there is hardly any text."""
    low, n = F.lower(text), F.length(text)
    return (
        F.when(needs_ocr(text), F.lit("scanned"))
        .when(has_any(low, SUMMARY_WORDS) & F.contains(low, F.lit("total")) & (~has_tables | (n < SHORT)), F.lit("summary"))
        .when(has_any(low, HEADER_WORDS) & (n < HEADER), F.lit("header"))
        .when((has_any(low, ITEM_WORDS) & has_tables) | has_tables, F.lit("item_table"))
        .when(n < SHORT, F.lit("header"))
        .otherwise(F.lit("item_table"))
    )


def word_kind(text: Column) -> Column:
    """Whether a text speaks of single rolls or of lots; unknown when even."""

    def score(words):
        return reduce(Column.__add__, [F.contains(F.lower(text), F.lit(w)).cast("int") for w in words])

    return F.when(score(ROLL_WORDS) > score(LOT_WORDS), F.lit("roll_level")).when(score(LOT_WORDS) > score(ROLL_WORDS), F.lit("lot_level")).otherwise(F.lit("unknown"))


def layout(roll: Column, lot: Column, text: Column) -> Column:
    """A document's kind by its tables' scores, and by its words when these don't tell."""
    return F.when((roll >= 3) & (lot >= 2), F.lit("hybrid")).when((roll >= lot) & (roll >= 3), F.lit("roll_level")).when((lot > roll) & (lot >= 3), F.lit("lot_level")).otherwise(word_kind(text))


def key_pages(pages: DataFrame, whole: int = 15) -> DataFrame:
    """The pages (doc_id, page_number, page_type, doc_type) that matter of each document: all of a short or hybrid one; else its headers, its first page of items and its last summary, or else its last page."""
    return _key_rows(pages, whole).select("doc_id", "page_number", "page_type")


def _key_rows(pages: DataFrame, whole: int) -> DataFrame:
    every = Window.partitionBy("doc_id")
    of_kind = Window.partitionBy("doc_id", "page_type")
    rows = pages.withColumns(
        {
            "n_pages": F.count("*").over(every),
            "last": F.max("page_number").over(every),
            "first_of_kind": F.min("page_number").over(of_kind),
            "last_of_kind": F.max("page_number").over(of_kind),
            "has_summary": F.max((F.col("page_type") == "summary").cast("int")).over(every) == 1,
        }
    )
    chosen = (F.col("n_pages") <= whole) | (F.col("doc_type") == "hybrid") | (F.col("page_type") == "header")
    chosen |= (F.col("page_type") == "item_table") & (F.col("page_number") == F.col("first_of_kind"))
    chosen |= (F.col("page_type") == "summary") & (F.col("page_number") == F.col("last_of_kind"))
    chosen |= ~F.col("has_summary") & (F.col("page_number") == F.col("last"))
    return rows.where(chosen)


#: Characters of a document's context, at most.
MOST_CONTEXT = 2_000_000


def context(pages: DataFrame, tables: DataFrame | None = None, most: int = MOST_CONTEXT, whole: int = 15) -> DataFrame:
    """doc_id and context: the text of each document's key pages that have some, each under a banner with its number and kind, and with its tables (doc_id, page_number, tbl, markdown), if any; cut after `most` characters."""
    chosen = _key_rows(pages, whole).where("raw_text <> ''")
    text = F.concat(F.lit("--- Page "), F.col("page_number").cast("string"), F.lit(" ("), "page_type", F.lit(") ---\n"), "raw_text", F.lit("\n"))
    if tables is not None:
        listed = F.array_sort(F.collect_list(F.struct("tbl", "markdown")))
        shown = F.array_join(F.transform(listed, lambda t, i: F.concat(F.lit("\nTable "), (i + 1).cast("string"), F.lit(":\n"), t["markdown"], F.lit("\n"))), "")
        shown = tables.groupBy("doc_id", "page_number").agg(F.concat(F.lit("\n--- Extracted Structured Tables ---\n"), shown).alias("shown"))
        chosen = chosen.join(shown, ["doc_id", "page_number"], "left")
        text = F.concat(text, F.coalesce("shown", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("page_number", text.alias("text"))))
    return chosen.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(listed, lambda p: p["text"]), "\n\n"), 1, most).alias("context"))


def full_text(pages: DataFrame) -> DataFrame:
    """Each document's text: its pages that have some, in order, with a blank line between them."""
    listed = F.array_sort(F.collect_list(F.when(~needs_ocr(F.col("raw_text")), F.struct("page_number", "raw_text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda p: p["raw_text"]), "\n\n").alias("full_text"))


def ocr_filled(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with the text that recognition found (doc_id, page_number, direct_text, image_text) where they have none: direct text of more than LEAST_TEXT characters, else the image's. Such a page becomes a page of items; one without any stays as it is."""
    text = F.when(F.length(stripped(F.col("direct_text"))) > LEAST_TEXT, F.col("direct_text")).otherwise(F.col("image_text"))
    found = recognised.select("doc_id", "page_number", F.when(F.length(stripped(text)) > 0, text).alias("ocr_text"))
    take = needs_ocr(F.col("raw_text")) & F.col("ocr_text").isNotNull()
    return (
        pages.join(found, ["doc_id", "page_number"], "left")
        .withColumn("page_type", F.when(take, F.lit("item_table")).otherwise(F.col("page_type")))
        .withColumn("raw_text", F.when(take, F.col("ocr_text")).otherwise(F.col("raw_text")))
        .drop("ocr_text")
    )


#: A document of up to CHUNK characters is one chunk; a longer one is cut before lines that open a part, or anywhere beyond FORCED; later chunks carry the first CONTEXT characters.
CHUNK, FORCED, CONTEXT = 3000, 4500, 1000


def chunks(texts: DataFrame, column: str = "full_text") -> DataFrame:
    """doc_id, chunk (from 0) and content. A fold over the lines, line ends kept, in one expression for each document."""
    lines = F.filter(F.split(column, r"(?<=\n)|(?<=\r)(?!\n)|(?<=[\x0b\x0c\x1c\x1d\x1e\x85  ])"), lambda x: x != "")
    folded = F.expr(
        f"""aggregate(lines, named_struct('done', cast(array() AS array<string>), 'now', ''),
            (a, line) -> IF(length(a.now) + length(line) > {CHUNK} AND a.now <> '' AND (length(a.now) + length(line) > {FORCED} OR regexp_like(line, '(?U)^\\\\s*(PO #|Page )') OR regexp_like(line, '(?U)^\\\\s*$')),
                named_struct('done', array_append(a.done, a.now), 'now', line), named_struct('done', a.done, 'now', a.now || line)),
            a -> IF(a.now = '', a.done, array_append(a.done, a.now)))"""
    )
    parts = texts.select("doc_id", F.col(column).alias("text"), F.when(F.length(column) <= CHUNK, F.array(F.col(column))).alias("one"), lines.alias("lines"))
    parts = parts.select("doc_id", "text", F.posexplode(F.coalesce("one", folded)).alias("chunk", "content"))
    head = F.concat(F.lit("--- [DOCUMENT HEADER FOR CONTEXT] ---\n"), F.substring("text", 1, CONTEXT), F.lit("\n--- [CONTINUED ROWS] ---\n"))
    return parts.select("doc_id", "chunk", F.when(F.col("chunk") > 0, F.concat(head, "content")).otherwise(F.col("content")).alias("content"))
