"""The finished record of a document: resolved values set against its rolls and its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS, FLAG_BELOW, WEIGHT_TOLERANCE
from ..functions.text import mixed, number
from . import checks, evidence
from .rolls import cents

#: Fields of which a document can have several.
SEVERAL = ("lot", "color", "quality")


def _sums(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(cents("meters").cast("double").alias("sum_meters"), F.count("*").alias("n_lines"), *[F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(f"all_{c}") for c in SEVERAL]).withColumns({f"mixed_{c}": mixed(F.col(f"all_{c}")) for c in SEVERAL})


def _against_rolls(field: str) -> dict[str, Column]:
    """A field's value and source, the rolls considered: their sum or number where the record has none, MIXED where they have several values and the record's isn't one of them, theirs where it has none."""
    value, source = F.col(field), F.col(f"{field}_source")
    if field in ("meters", "pieces"):
        found, own = F.col("sum_meters" if field == "meters" else "n_lines"), F.coalesce(F.col(f"{field}_number").cast("double"), F.lit(0.0))
        use = (own < (0.01 if field == "meters" else 0.5)) & (own >= 0) & (found > 0)
        return {field: F.when(use, found.cast("string")).otherwise(value), f"{field}_source": F.when(use, F.lit("aggregated")).otherwise(source), f"{field}_number": F.when(use, found.try_cast("double" if field == "meters" else "int")).otherwise(F.col(f"{field}_number"))}
    every = F.col(f"all_{field}")
    several = (F.size(every) > 1) & ~F.coalesce(F.array_contains(every, value), F.lit(False))
    blank = (F.size(every) == 1) & (F.coalesce(value, F.lit("")) == "")
    return {field: F.when(several | blank, F.col(f"mixed_{field}")).otherwise(value), f"{field}_source": F.when(several, F.lit("aggregated")).when(blank, F.lit("fallback_from_lines")).otherwise(source)}


def pivoted(resolved: DataFrame) -> DataFrame:
    """Resolved values (doc_id, field, value, source, confidence) as a row for each document: doc_id, and for each field its value, f_source and f_sure."""
    wide = resolved.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "source", "confidence"))).alias(f) for f in FIELDS])
    return wide.select("doc_id", *[F.col(f"{f}.value").alias(f) for f in FIELDS], *[F.col(f"{f}.source").alias(f"{f}_source") for f in FIELDS], *[F.col(f"{f}.confidence").alias(f"{f}_sure") for f in FIELDS])


def finished(resolved: DataFrame, lines: DataFrame | None = None, table_weights: DataFrame | None = None, kinds: DataFrame | None = None) -> DataFrame:
    """One record for each document from its resolved values (doc_id, field, value, source, confidence, or as pivoted() has them; with a column weight there, table_weights aren't needed).

    lines (doc_id, lot, color, quality, meters) fill blanks and make several lots, colors or qualities MIXED; table_weights (tables.weights) that differ from the stated net weight by more than the tolerance flag it; kinds: doc_id, has_template, has_ai. Beside a column for each field, typed: sources (a map), flagged_fields (names in order, joined by commas), weight_mismatch, mapping_source, errors (of dates and rules). A number is read from its text once, and each step reads columns of the one before: all in one expression is code beyond what the JVM takes.
    """
    wide = pivoted(resolved) if "field" in resolved.columns else resolved
    numbers = {f: kind for f, kind in FIELDS.items() if kind != "string"}
    wide = wide.withColumns({f"{f}_number": F.replace(F.regexp_replace(F.col(f), r"\s", ""), F.lit(","), F.lit("")) for f in numbers})
    wide = wide.withColumns({f"{f}_number": number(F.col(f"{f}_number")) for f in numbers})
    wide = wide.withColumns({f"{f}_number": F.col(f"{f}_number").try_cast("int") for f, kind in numbers.items() if kind == "int"})
    if lines is not None:
        wide = wide.join(_sums(lines), "doc_id", "left")
        wide = wide.withColumns({name: column for f in ("meters", "pieces", *SEVERAL) for name, column in _against_rolls(f).items()})
    stated = F.col("net_weight_number")
    if table_weights is not None:
        wide = wide.join(table_weights, "doc_id", "left")
    if "weight" in wide.columns:
        # In decimals, so that no order of adding matters.
        exact = stated.cast("decimal(20,4)")
        off = F.abs(F.col("weight") - exact) * int(1 / WEIGHT_TOLERANCE) > exact
        wide = wide.withColumn("weight_mismatch", F.coalesce((stated > 0) & off, F.lit(False)))
    else:
        wide = wide.withColumn("weight_mismatch", F.lit(False))
    wide = wide.withColumns({f"{f}_source": F.coalesce(f"{f}_source", F.lit("none")) for f in FIELDS})
    low = [F.when((evidence.score(F.col(f), F.col(f"{f}_source"), F.col(f"{f}_sure")) < FLAG_BELOW) | (F.col("weight_mismatch") if f == "net_weight" else F.lit(False)), F.lit(f)) for f in sorted(FIELDS)]
    typed = {f: F.col(f"{f}_number").cast("long" if kind == "int" else kind) if kind != "string" else F.col(f) for f, kind in FIELDS.items()}
    errors = checks.all_errors(F.col("delivered_date"), F.col("meters"), F.col("pieces"), F.col("net_weight"))
    if kinds is not None:
        wide = wide.join(kinds, "doc_id", "left")
        how = evidence.mapping_source(F.coalesce("has_template", F.lit(False)), F.coalesce("has_ai", F.lit(False)))
    else:
        how = F.lit("regex")
    sources = F.map_from_arrays(F.array(*[F.lit(f) for f in FIELDS]), F.array(*[F.col(f"{f}_source") for f in FIELDS]))
    return wide.select("doc_id", *[v.alias(f) for f, v in typed.items()], sources.alias("sources"), F.array_join(F.array_compact(F.array(*low)), ",").alias("flagged_fields"), "weight_mismatch", how.alias("mapping_source"), F.array_join(errors, "; ").alias("errors"))
