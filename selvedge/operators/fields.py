"""Values of fields from running text, by lists of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS, LOT_NOT, LOT_PATTERNS, METER_PATTERNS, PATTERN_WORDS, PATTERNS, PIECE_PATTERNS, SHOWN_PATTERNS, SUPPLIER_HEADERS, SUPPLIER_PATTERNS
from ..functions.text import clean_number, converted_date, first_value, nonempty, normal_date, number, once, stripped


def field_columns(text: Column, supplier: Column | None = None, low: Column | None = None) -> dict[str, Column]:
    """The value of each field: a supplier's own patterns first, then the general ones; dates made ISO. `low` is the text in lower case, where it is at hand."""
    out = {}
    for field, patterns in PATTERNS.items():
        own = [(name, rules[field]) for name, rules in SUPPLIER_PATTERNS.items() if field in rules] if supplier is not None else []
        value = F.coalesce(*[F.when(F.lower(supplier) == name, first_value(text, rules, low, PATTERN_WORDS)) for name, rules in own], first_value(text, patterns, low, PATTERN_WORDS))
        out[field] = normal_date(value) if field == "delivered_date" else value
    return out


def by_document(pages: DataFrame, supplier: str | None = None) -> DataFrame:
    """Each document's values, each from the first page that has one."""
    found = pages.select("doc_id", "page_number", by_page(F.col("raw_text"), F.col(supplier) if supplier else None).alias("found"))
    return found.groupBy("doc_id").agg(*first_found())


def first_found() -> list[Column]:
    """For each field, as an aggregate over a document's pages (found, page_number), the value of the first page that has one."""
    return [F.min_by(f"found.{f}", F.when(F.col(f"found.{f}").isNotNull(), F.col("page_number"))).alias(f) for f in PATTERNS]


def by_page(text: Column, supplier: Column | None = None) -> Column:
    """All fields' values as a struct. Inside a lambda the forty patterns stay out of the generated code, which they would take beyond what the JVM compiles."""
    page = F.struct(text.alias("text"), F.lower(text).alias("low"), (F.lit("") if supplier is None else supplier).alias("supplier"))
    return F.get(F.transform(F.array(page), lambda p: F.struct(*[v.alias(f) for f, v in field_columns(p["text"], None if supplier is None else p["supplier"], p["low"]).items()])), F.lit(0))


def supplier_headers(texts: DataFrame) -> DataFrame:
    """Header values of known suppliers' documents (doc_id, code, full_text), by the places where these write them: doc_id, field, value. Of totals that repeat the last one counts; numbers lose their commas and units, dates become ISO; what isn't there has no row. Each document is tried by its own supplier's patterns alone."""
    return texts.select("doc_id", F.explode(header_values(F.col("code"), "full_text")).alias("x")).select("doc_id", "x.*").where("value IS NOT NULL")


def header_values(known: Column, text: str) -> Column:
    """field and value (an array) of what a known supplier's text says; null for others."""
    own = F.lit(None)
    for code, rules in SUPPLIER_HEADERS.items():
        values = []
        for field, (pattern, which) in rules.items():
            every = F.regexp_extract_all(text, F.lit(f"(?im){pattern}"), 1)
            raw = once(F.try_element_at(every, F.lit(1 if which == "first" else -1)), stripped)
            if field == "delivered_date":
                raw = F.coalesce(converted_date(raw), raw)
            elif FIELDS[field] != "string":
                raw = clean_number(raw).cast("decimal(18,2)").cast("string" if FIELDS[field] == "double" else "long").cast("string")
            values.append(F.struct(F.lit(field).alias("field"), nonempty(raw).alias("value")))
        own = F.when(known == code, F.array(*values)).otherwise(own)
    return own


def text_evidence(texts: DataFrame, has_pieces: DataFrame | None = None) -> DataFrame:
    """Evidence from documents' texts (doc_id, full_text): lots (confidence 0.85), the highest roll number as pieces (0.80) and totals in meters (0.82), in the patterns' order; no pieces for documents in has_pieces (doc_id), whose tables give some."""
    text = F.col("full_text")
    parts = [texts.select("doc_id", F.lit(field).alias("field"), F.posexplode(values).alias("n", "value"), F.lit(sure).alias("confidence")) for field, values, sure in (("lot", lot_values(text), 0.85), ("meters", meter_values(text), 0.82))]
    pieces = texts if has_pieces is None else texts.join(has_pieces.select("doc_id").distinct(), "doc_id", "left_anti")
    parts.append(pieces.select("doc_id", F.lit("pieces").alias("field"), F.lit(0).alias("n"), most_pieces(text).cast("string").alias("value"), F.lit(0.80).alias("confidence")).where("value IS NOT NULL"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("doc_id", "field", "value", "confidence", F.lit(1).alias("page_number"), F.col("n").cast("long").alias("ord"))


def _lots(text: Column) -> list[Column]:
    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 1), stripped)
        return F.get(F.filter(found, lambda x: (x != "") & ~F.lower(x).isin(*LOT_NOT)), F.lit(0))

    return [first(p) for p in LOT_PATTERNS]


def lot_values(text: Column) -> Column:
    """For each lot pattern the first match that isn't a mere label (an array)."""
    return F.filter(F.array(*_lots(text)), lambda x: x.isNotNull())


def most_pieces(text: Column) -> Column:
    """The highest roll or piece number in a text."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1) for p in PIECE_PATTERNS])
    return F.array_max(F.transform(found, lambda x: x.try_cast("bigint")))


def _meters(text: Column) -> list[Column]:
    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 1), lambda x: F.replace(stripped(x), F.lit(","), F.lit("")))
        return F.get(F.filter(found, lambda x: number(x) > 0), F.lit(0))

    return [first(p) for p in METER_PATTERNS]


def meter_values(text: Column) -> Column:
    """For each pattern of totals the first match that is a positive number, its commas gone (an array of text)."""
    return F.filter(F.array(*_meters(text)), lambda x: x.isNotNull())


def text_values(text: Column) -> dict[str, Column]:
    """What text_evidence() has first for a field: patterns are tried until one gives a value."""
    return {"lot": F.coalesce(*_lots(text)), "meters": F.coalesce(*_meters(text)), "pieces": most_pieces(text).cast("string")}


def shown(text: Column, field: str, value: Column) -> Column:
    """What to mark in a text for a field: its pattern's match, else its value where the text has it; nothing for a field without a value."""
    found = [nonempty(F.regexp_extract(text, f"(?i){p}", 1)) for p in SHOWN_PATTERNS.get(field, ())]
    return F.when(F.coalesce(value, F.lit("")) != "", F.coalesce(*found, F.when(F.contains(text, value), value)))


