"""One object for what users do with shipment papers: ingest, look at results and candidates, confirm, write sheets, keep templates. Every method takes and gives frames; nothing runs until a result is asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fixed import ALIASES, FIELDS
from .operators import books, evidence, extraction, feedback, fields, pages as page_ops, records, rolls, service, tables
from .sources import readers


class Shipments:
    """pages: doc_id, page_number, raw_text, supplier_name; cells: doc_id, page (as page_number; 1 where there is no such column), tbl, row, and col and text, or texts (a row's, by column); templates: supplier_name, fields, schema_version; model: evidence of a model, lines: rolls (doc_id, seq, lot, po_number, piece_number, color, quality, meters, net_weight), as responses.line_items gives them, where rolls are read elsewhere (then no others are sought); all but pages may be missing."""

    def __init__(self, pages: DataFrame, cells: DataFrame | None = None, templates: DataFrame | None = None, model: DataFrame | None = None, lines: DataFrame | None = None):
        self.pages = readers.classified(readers.with_supplier(pages))
        #: Cells by page, and with a document's tables counted over its pages.
        whole = cells is not None and "texts" in cells.columns
        paged = cells if cells is None or "page" in cells.columns else cells.withColumn("page", F.lit(1))
        self.paged = paged.select("doc_id", "page", "tbl", "row", F.posexplode("texts").alias("col", "text")) if whole else paged
        self.cells = tables.counted(self.paged) if cells is not None else None
        #: Rows of the tables, which are counted over the pages.
        self.rows = None
        if whole:
            self.rows = tables.counted(cells) if "page" in cells.columns else cells.select("doc_id", "tbl", "row", "texts")
        elif cells is not None:
            self.rows = tables.counted(books.table_rows(paged).withColumnsRenamed({"page_tbl": "tbl", "page_row": "row"}))
        self.templates, self.model, self.lines = templates, model, lines

    @classmethod
    def ingest(cls, spark: SparkSession, path: str, parser: Callable[[bytes], list[str]], suppliers: DataFrame | None = None, **more: DataFrame) -> Shipments:
        """Papers from uploaded files by a parser, with their suppliers (doc_id, supplier_name) where they are known."""
        pages = readers.parsed_pages(readers.uploads(spark, path), parser)
        pages = pages.join(suppliers, "doc_id", "left") if suppliers is not None else pages.withColumn("supplier_name", F.lit(None).cast("string"))
        return cls(pages, **more)

    def documents(self) -> DataFrame:
        return self.pages.groupBy("doc_id").agg(F.min("supplier_name").alias("supplier_name"))

    def evidence(self) -> DataFrame:
        """All evidence for all fields, with its order of arrival."""
        found = fields.by_document(self.pages.where(~F.col("needs_ocr")), "supplier_name")
        values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS if f in found.columns])
        regex = found.select("doc_id", F.explode(values).alias("x")).select("doc_id", "x.*").where("value IS NOT NULL")
        # A known supplier's own places come before the general patterns.
        known = self.pages.withColumn("code", rolls.supplier_code(F.coalesce("supplier_name", F.lit("")))).where(F.col("code") != "UNKNOWN")
        texts = page_ops.full_text(known).join(known.groupBy("doc_id").agg(F.min("code").alias("code")), "doc_id")
        own = fields.supplier_headers(texts).select("*", F.lit(0.92).alias("confidence"), F.lit(1).alias("page_number"), F.lit(-1).cast("long").alias("ord"))
        parts = {"regex": regex.select("*", F.lit(0.90).alias("confidence"), F.lit(1).alias("page_number"), F.lit(0).cast("long").alias("ord")).unionByName(own)}
        if self.templates is not None:
            parts["template"] = feedback.as_evidence(feedback.lookup(self.documents(), self.templates))
        if self.model is not None:
            parts["ai"] = self.model
        has_pieces = None
        if self.cells is not None:
            # 20 bits of the table, 24 of the row, 16 of the column: they can't meet.
            place = F.shiftleft(F.col("tbl").cast("long"), 40) + F.shiftleft(F.col("row").cast("long"), 16) + F.col("col")
            found = tables.candidates(self.cells)
            has_pieces = found.where("field = 'pieces'")
            parts["table_col"] = found.select("doc_id", "field", "value", F.lit(0.88).alias("confidence"), F.lit(1).alias("page_number"), place.alias("ord"))
        parts["text_pattern"] = fields.text_evidence(page_ops.full_text(self.pages), has_pieces)
        return evidence.union(**parts)

    #: What a roll has, wherever it was read.
    ROLL = ("doc_id", "seq", "lot", "po_number", "piece_number", "color", "quality", "meters", "net_weight", "weight_gross_kgs")

    def table_rows(self) -> DataFrame:
        """The classified rows of the documents' tables: pieces on several pages joined, PO sections from the pages' text, suppliers' own headings (see operators/books.py)."""
        codes = self.documents().select("doc_id", rolls.supplier_code(F.coalesce("supplier_name", F.lit(""))).alias("code"))
        return books.classified_rows(self.paged.repartition("doc_id"), books.page_lines(self.pages, self.paged), codes)

    def rolls(self) -> DataFrame:
        """The rolls of the documents: those given, if any are; else those of each one's tables, or of its running text where they have none."""

        def plain(found: DataFrame) -> DataFrame:
            missing = [c for c in self.ROLL if c not in found.columns]
            return found.withColumns({c: F.lit(None).cast("double" if c in ("meters", "net_weight", "weight_gross_kgs") else "string") for c in missing}).select(*self.ROLL)

        if self.lines is not None:
            return plain(self.lines)
        found = plain(extraction.extracted(extraction.lines_of(page_ops.full_text(self.pages))))
        if self.cells is None:
            return found
        own = plain(books.rolls_of(self.table_rows()))
        return found.join(own.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(own)

    def rows_left_out(self) -> DataFrame:
        """The rows of the documents' tables that are no rolls, with the reason."""
        return books.left_out(self.table_rows())

    def total_differences(self) -> DataFrame:
        """Totals that the tables state and the rolls above them don't come to."""
        return books.stated_totals(self.table_rows()).where("differs")

    def resolved(self) -> DataFrame:
        """doc_id, field, value, source, confidence (scored) for every field of every document."""
        won = evidence.resolve_all(self.documents(), self.evidence())
        return won.withColumn("confidence", evidence.score(F.col("value"), F.col("source"), F.col("confidence")))

    def response(self) -> DataFrame:
        """Every field of every document as it is shown (see evidence.response)."""
        return evidence.response(evidence.resolve_all(self.documents(), self.evidence()))

    def resolved_at_once(self) -> DataFrame:
        """What resolved() finds where neither templates nor a model have a say, as records.pivoted() has it, with the weight of the tables: all other sources have fixed confidences, so the first source that has a field's value, in their order, is the winner. A document's pages are read once and its tables once, and running text is tried only for what neither gives."""
        known = F.nullif(rolls.supplier_code(F.coalesce("supplier_name", F.lit(""))), F.lit("UNKNOWN"))
        pages = self.pages.select("doc_id", "page_number", "raw_text", "supplier_name", "needs_ocr", known.alias("code"), F.when(~F.col("needs_ocr"), fields.by_page(F.col("raw_text"), F.col("supplier_name"))).alias("found"))
        text = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("page_number", "raw_text")))), lambda p: p["raw_text"]), "\n\n")
        docs = pages.groupBy("doc_id").agg(*fields.first_found(), F.min("code").alias("code"), text(~F.col("needs_ocr")).alias("full_text"), text(~F.col("needs_ocr") & F.col("code").isNotNull()).alias("known_text"))
        docs = docs.withColumn("headers", F.when(F.col("code").isNotNull(), fields.header_values(F.col("code"), "known_text")))
        if self.rows is not None:
            docs = docs.join(tables.first_values(self.rows), "doc_id", "left")
        pick = lambda of, name, which: F.get(F.filter(of, lambda x: x[name] == which), F.lit(0))["value"]
        values, late = {}, fields.text_values(F.col("full_text"))
        in_tables = {f: k for k, f in enumerate(ALIASES)} if self.rows is not None else {}
        for f in FIELDS:
            values[f] = [("regex", F.coalesce(pick("headers", "field", f), F.col(f)))]
            if f in in_tables:
                values[f].append(("table_col", pick("firsts", "k", in_tables[f])))
        docs = docs.select("doc_id", "full_text", *(["weight"] if self.rows is not None else []), *[v.alias(f"{f}_{source}") for f in FIELDS for source, v in values[f]])
        early = {f: [(source, F.col(f"{f}_{source}")) for source, _ in values[f]] for f in FIELDS}
        docs = docs.withColumns({f"{f}_text_pattern": F.when(F.coalesce(*[v for _, v in early[f]]).isNull(), late[f]) for f in late})
        every = {f: early[f] + ([("text_pattern", F.col(f"{f}_text_pattern"))] if f in late else []) for f in FIELDS}
        source = lambda found: reduce(lambda out, x: F.when(x[1].isNotNull(), F.lit(x[0])).otherwise(out), reversed(found), F.lit("none"))
        return docs.select("doc_id", *(["weight"] if self.rows is not None else []), *[F.coalesce(*[v for _, v in found]).alias(f) for f, found in every.items()], *[source(found).alias(f"{f}_source") for f, found in every.items()], *[F.lit(None).cast("double").alias(f"{f}_sure") for f in FIELDS])

    def result(self) -> DataFrame:
        """One finished record for each document: resolved values, blanks filled from the rolls, several values MIXED, the stated weight set against the tables' sum, the fields to be reviewed, errors."""
        if self.templates is None and self.model is None:
            return records.finished(self.resolved_at_once(), self.rolls())
        kinds = self.documents().select("doc_id")
        template = feedback.lookup(self.documents(), self.templates).select("doc_id", F.col("fields").isNotNull().alias("has_template")) if self.templates is not None else kinds.withColumn("has_template", F.lit(False))
        ai = self.model.select("doc_id").distinct().withColumn("has_ai", F.lit(True)) if self.model is not None else kinds.withColumn("has_ai", F.lit(False))
        weights = tables.weights(self.cells) if self.cells is not None else None
        return records.finished(self.resolved(), self.rolls(), weights, template.join(ai, "doc_id", "left"))

    def context(self, doc_types: DataFrame, whole: int = 15) -> DataFrame:
        """The text for a model, of key pages with their tables (see pages.context); doc_types: doc_id, doc_type."""
        shown = None
        if self.cells is not None:
            own = self.paged.select(F.struct("doc_id", "page").alias("doc_id"), "tbl", "row", "col", "text")
            shown = tables.markdown(own).select("doc_id.doc_id", F.col("doc_id.page").alias("page_number"), "tbl", "markdown")
        return page_ops.context(self.pages.join(doc_types, "doc_id", "left"), shown, whole=whole)

    def candidates(self, k: int = 5) -> DataFrame:
        return evidence.candidates(self.evidence(), k)

    def all_candidates(self) -> DataFrame:
        return evidence.all_candidates(self.evidence(), self.resolved())

    def confirmed(self, actions: DataFrame) -> DataFrame:
        """Values in long form with reviewers' actions (job_id, seq, field, action, value) laid over."""
        return feedback.applied(self.resolved().select(F.col("doc_id").alias("job_id"), "field", "value"), actions)

    @staticmethod
    def log(messages: DataFrame) -> DataFrame:
        """The log of each job (job_id, ord, msg), numbered."""
        return service.job_log(messages)

    @staticmethod
    def sheet(lines: DataFrame, records: DataFrame) -> DataFrame:
        return rolls.sheet_rows(lines, records)

    @staticmethod
    def workbooks(lines: DataFrame, records: DataFrame) -> DataFrame:
        """A workbook for each document; what stands above its rolls comes from records that have supplier_name, invoice_number, delivered_date and quality."""
        full = {"supplier_name", "invoice_number", "delivered_date", "quality"} <= set(records.columns)
        return readers.workbooks(rolls.sheet_rows(lines, records), rolls.sheet_header(records) if full else None)
