"""Evidence for the fields of a record: union, conflict resolution, confidence, candidates.

Evidence is a frame of doc_id, field, value (string), confidence, source, page_number, ord; ord is the order of arrival and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS, FLAG_BELOW, HEADER_PRIORITY, SOURCE_CONFIDENCE, TABLE_FIELDS, TABLE_PRIORITY

COLUMNS = ("doc_id", "field", "value", "confidence", "source", "page_number", "ord")
#: Arrival order of the sources; an ord within a source is below 2 ** 60.
ORDER = ("template", "regex", "ai", "table_col", "text_pattern")


def _mapped(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def priority(field: Column, source: Column) -> Column:
    """How much a source counts for a field when confidences tie."""
    return F.when(field.isin(*TABLE_FIELDS), _mapped(TABLE_PRIORITY, source, 0)).otherwise(_mapped(HEADER_PRIORITY, source, 0))


def union(**frames: DataFrame) -> DataFrame:
    """One evidence frame from a frame for each source (template, regex, ai, table_col, text_pattern), in that order of arrival; null values of templates and of the model are no evidence."""
    parts = []
    for place, source in enumerate(ORDER):
        if source in frames:
            frame = frames[source]
            if source in ("template", "ai"):
                frame = frame.where(F.col("value").isNotNull())
            parts.append(frame.withColumn("source", F.lit(source)).withColumn("ord", F.lit(place << 60) + F.col("ord")).select(*COLUMNS))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def top1(evidence: DataFrame) -> DataFrame:
    """The winning value of each document and field: highest confidence, then priority, then first come. One aggregation, combined before the shuffle."""
    rank = F.struct(F.col("confidence"), priority(F.col("field"), F.col("source")).alias("prio"), (-F.col("ord")).alias("first"))
    won = evidence.where(F.col("value").isNotNull()).groupBy("doc_id", "field").agg(F.max_by(F.struct("value", "source", "confidence", "page_number"), rank).alias("won"))
    return won.select("doc_id", "field", "won.*")


def resolve_all(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every field of every document in docs (doc_id): the winner, or null from source "none" with confidence 0."""
    every = docs.select("doc_id").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in FIELDS])))
    return every.join(top1(evidence), ["doc_id", "field"], "left").select("doc_id", "field", "value", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def score(value: Column, source: Column, confidence: Column) -> Column:
    """Confidence of a resolved value: 0 without one; the model's own, within 0 and 1; else by source, and 0 for sources that the table doesn't name."""
    named = _mapped(SOURCE_CONFIDENCE, source, 0.0)
    return F.when(value.isNull(), F.lit(0.0)).when((source == "ai") & confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(named)


def flagged(resolved: DataFrame) -> DataFrame:
    """doc_id and its fields of low confidence, joined by commas in order of name."""
    low = F.array_sort(F.collect_list(F.when(F.col("confidence") < FLAG_BELOW, F.col("field"))))
    return resolved.groupBy("doc_id").agg(F.array_join(low, ",").alias("flagged_fields"))


def candidates(evidence: DataFrame, k: int = 5) -> DataFrame:
    """The first k distinct values of each document and field, in order of arrival, joined by |. Repeats are dropped before the shuffle's second half, so a group holds its distinct values only."""
    first = evidence.where(F.col("value").isNotNull()).groupBy("doc_id", "field", "value").agg(F.min("ord").alias("ord"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "value")))
    values = F.transform(F.slice(listed, 1, k), lambda x: x["value"])
    return first.groupBy("doc_id", "field").agg(F.array_join(values, "|").alias("candidates"))


def all_candidates(evidence: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every distinct value of each document and field with its label; is_confirmed where it is the record's current value."""
    seen = evidence.where(F.col("value").isNotNull()).select("doc_id", "field", "value")
    now = resolved.where(F.col("value").isNotNull()).select("doc_id", "field", "value")
    both = seen.withColumn("now", F.lit(0)).unionByName(now.withColumn("now", F.lit(1)))
    found = both.groupBy("doc_id", "field", "value").agg(F.max("now").alias("now"))
    return found.select("doc_id", "field", F.initcap(F.replace("field", F.lit("_"), F.lit(" "))).alias("label"), "value", (F.col("now") == 1).alias("is_confirmed"))


def found_and_missing(resolved: DataFrame, required: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """For each document: fields without a value (in the record's order), and whether all required ones have one."""
    have = F.collect_set(F.when(F.col("value").isNotNull(), F.col("field")))
    missing = F.array_except(F.array(*[F.lit(f) for f in FIELDS]), have)
    wanted = F.array_except(F.array(*[F.lit(f) for f in required]), have)
    return resolved.groupBy("doc_id").agg(F.array_join(missing, ",").alias("missing"), (F.size(wanted) == 0).alias("complete"))


def mapping_source(has_template: Column, has_ai: Column) -> Column:
    return F.when(has_template, F.lit("template")).when(has_ai, F.lit("ai")).otherwise(F.lit("regex"))


def as_records(resolved: DataFrame) -> DataFrame:
    """One row for each document with a column for each field, as text."""
    return resolved.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])


#: Scores from which a field needs no reviewer, and from which one may pass it.
SURE, FAIR = 0.85, 0.60


def review(score_: Column) -> Column:
    """What a reviewer has to do with a field: nothing, look, or mend."""
    return F.when(score_ >= SURE, F.lit("auto")).when(score_ >= FAIR, F.lit("review")).otherwise(F.lit("flag"))


def submit_gate(reviewed: DataFrame) -> DataFrame:
    """Whether each document (doc_id, field, review) can be submitted, and its numbers of flagged and of settled fields."""
    return reviewed.groupBy("doc_id").agg(F.bool_and(F.col("review") != "flag").alias("can_submit"), F.count_if(F.col("review") == "flag").alias("n_flagged"), F.count_if(F.col("review") == "auto").alias("n_actioned"))


def confirmed_count(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("doc_id").agg(F.count("value").alias("confirmed_count"))


def chips(items: DataFrame) -> DataFrame:
    """Items (doc_id, name, value) by whether their name is a field of the record: doc_id, fields and unidentified (names, in order, joined by commas)."""
    known = F.col("name").isin(*FIELDS)
    return items.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("name")))), ",").alias("fields"), F.array_join(F.array_sort(F.collect_set(F.when(~known, F.col("name")))), ",").alias("unidentified"))


def response(resolved: DataFrame) -> DataFrame:
    """What a result is shown as: doc_id, name, value, confidence (of 100), mapping_source, status, for each field of resolved documents (doc_id, field, value, source, confidence)."""
    scored = score(F.col("value"), F.col("source"), F.col("confidence"))
    return resolved.select("doc_id", F.col("field").alias("name"), "value", F.round(scored * 100).cast("int").alias("confidence"), mapping_source(F.lit(False), F.col("source") != "none").alias("mapping_source"), F.lit("complete").alias("status"))
