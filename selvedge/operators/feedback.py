"""Reviewers' actions and what is learnt from them: overlays on records, templates of suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FIELDS

VERSION = "2"
ACTIONS = ("confirm", "reassign", "not_present")


def known_supplier(name: Column) -> Column:
    return F.coalesce((F.trim(name) != "") & (F.lower(F.trim(name)) != "unknown"), F.lit(False))


def valid_actions(actions: DataFrame) -> DataFrame:
    """Actions (job_id, seq, field, action, value) on known fields; what is marked not present has no value."""
    fine = F.col("field").isin(*FIELDS) & F.col("action").isin(*ACTIONS)
    return actions.where(fine).withColumn("value", F.when(F.col("action") != "not_present", F.col("value")))


def applied(values: DataFrame, actions: DataFrame) -> DataFrame:
    """Records in long form (job_id, field, value) with the last action on each field laid over; confidence and flags stay as they are."""
    last = valid_actions(actions).groupBy("job_id", "field").agg(F.max_by(F.struct("value", "action"), "seq").alias("last"))
    return values.join(last, ["job_id", "field"], "left").select("job_id", "field", F.when(F.col("last").isNotNull(), F.col("last.value")).otherwise(F.col("value")).alias("value"), F.col("last.action").alias("action"))


def templates_from(records: DataFrame, least: int = 3) -> DataFrame:
    """A template (supplier_name, fields) from each supplier's latest record (supplier_name, seq, and a column for each field as text) with at least `least` values; with its doc_type, where the records have one."""
    values = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in FIELDS]), lambda e: e["v"].isNotNull()))
    full = records.where(known_supplier(F.col("supplier_name"))).withColumn("fields", values).where(F.size("fields") >= least)
    kind = [F.max_by("doc_type", "seq").alias("doc_type")] if "doc_type" in records.columns else []
    return full.groupBy("supplier_name").agg(F.max_by("fields", "seq").alias("fields"), F.lit(VERSION).alias("schema_version"), *kind)


def suppliers(templates: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """The suppliers (supplier_name) that have a template, without those whose templates are deleted."""
    names = templates.select("supplier_name").distinct()
    return names if deleted is None else names.join(deleted.select("supplier_name").distinct(), "supplier_name", "left_anti")


def corrections(actions: DataFrame) -> DataFrame:
    """What reviewers' confirmed values (supplier_name, seq, field, action, value) come to: the last value of each supplier and field, and how many corrections the supplier has had."""
    used = actions.where(known_supplier(F.col("supplier_name")) & F.col("action").isin("confirm", "reassign") & F.col("value").isNotNull())
    last = used.groupBy("supplier_name", "field").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))
    return last.groupBy("supplier_name").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"), F.sum("n").alias("correction_count"))


def upserted(templates: DataFrame, newer: DataFrame) -> DataFrame:
    """Templates (supplier_name, fields, correction_count) with newer ones laid over, field by field."""
    old, new = F.coalesce("fields", F.create_map().cast("map<string,string>")), F.coalesce("new_fields", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    joined = templates.join(newer.select("supplier_name", F.col("fields").alias("new_fields"), F.col("correction_count").alias("new_count")), "supplier_name", "full")
    count = F.coalesce("correction_count", F.lit(0)).cast("long") + F.coalesce("new_count", F.lit(0)).cast("long")
    return joined.select("supplier_name", F.map_concat(rest, new).alias("fields"), F.lit(VERSION).alias("schema_version"), count.alias("correction_count"))


def lookup(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents (doc_id, supplier_name) with their supplier's template, if it is of this version. Documents without a known supplier, however many, stay out of the join."""
    current = templates.where((F.coalesce("schema_version", F.lit("1")) == VERSION) & known_supplier(F.col("supplier_name"))).select("supplier_name", "fields")
    known = known_supplier(F.col("supplier_name"))
    named = docs.where(known).join(current, "supplier_name", "left").select("doc_id", "supplier_name", "fields")
    return named.unionByName(docs.where(~known).select("doc_id", "supplier_name", F.lit(None).cast(templates.schema["fields"].dataType).alias("fields")))


def as_evidence(found: DataFrame) -> DataFrame:
    """Template values as evidence: doc_id, field, value, confidence, page_number, ord."""
    rows = found.where(F.col("fields").isNotNull()).select("doc_id", F.explode("fields").alias("field", "value"))
    return rows.select("doc_id", "field", "value", F.lit(0.95).alias("confidence"), F.lit(0).alias("page_number"), F.lit(0).cast("long").alias("ord"))


#: A log of changes to templates: a row for each confirmed value.
CHANGES = ("supplier_name", "field", "value", "at", "seq")


def changes(actions: DataFrame) -> DataFrame:
    """Reviewers' actions (supplier_name, seq, field, action, value, at) as a log of changes to templates (CHANGES): confirmed values of known suppliers and fields."""
    used = F.col("action").isin("confirm", "reassign") & F.col("value").isNotNull() & F.col("field").isin(*FIELDS)
    return actions.where(known_supplier(F.col("supplier_name")) & used).select(*CHANGES)


def compacted(log: DataFrame) -> DataFrame:
    """A log with the last change of each supplier and field alone, and the number of those it stands for (n). A compacted log with later changes gives the templates that the whole log gives."""
    n = F.sum("n") if "n" in log.columns else F.count("*")
    last = log.groupBy("supplier_name", "field").agg(F.max_by(F.struct("value", "at", "seq"), F.struct("at", "seq")).alias("last"), n.alias("n"))
    return last.select("supplier_name", "field", "last.value", "last.at", "last.seq", "n")


def templates_of(log: DataFrame) -> DataFrame:
    """The templates (supplier_name, fields, schema_version, correction_count) after all changes of a log, compacted or not."""
    last = compacted(log)
    return last.groupBy("supplier_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.lit(VERSION).alias("schema_version"), F.sum("n").alias("correction_count"))


def versions(log: DataFrame) -> DataFrame:
    """Each supplier's template over time: supplier_name, fields, valid_from and valid_until (null for the one in force). Changes at one time make one version."""
    order = Window.partitionBy("supplier_name").orderBy("at", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    pairs = [F.struct(F.lit(f).alias("field"), F.last(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).over(so_far).alias("value")) for f in FIELDS]
    rows = log.select("supplier_name", "at", "seq", F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()).alias("pairs"))
    rows = rows.groupBy("supplier_name", "at").agg(F.max_by("pairs", "seq").alias("pairs"))
    until = F.lead("at").over(Window.partitionBy("supplier_name").orderBy("at"))
    return rows.select("supplier_name", F.map_from_entries("pairs").alias("fields"), F.col("at").alias("valid_from"), until.alias("valid_until"))


#: Microseconds of a slice of time by which papers meet versions.
SLICE = 7 * 86_400_000_000


def lookup_at(docs: DataFrame, over_time: DataFrame) -> DataFrame:
    """Documents (doc_id, supplier_name, at: when the paper came) with the template that was in force then: fields, valid_from (null where there was none).

    Versions are laid out over weeks and met by supplier and week, so that a document sees the versions of one week, and a supplier with very many documents is many keys. A supplier's versions are as many rows as it has had weeks and versions.
    """
    now = docs.agg(F.max("at")).first()[0]
    slice_of = lambda at: F.floor(at / SLICE).cast("long")
    last = F.greatest(F.coalesce(F.col("valid_until") - 1, F.lit(now or 0)), F.col("valid_from"))
    laid = over_time.withColumn("slice", F.explode(F.sequence(slice_of(F.col("valid_from")), slice_of(last))))
    known = known_supplier(F.col("supplier_name"))
    own = docs.where(known).withColumn("slice", slice_of(F.col("at")))
    there = (own["at"] >= F.col("valid_from")) & (F.col("valid_until").isNull() | (own["at"] < F.col("valid_until")))
    met = own.join(laid.withColumnRenamed("supplier_name", "of_supplier").withColumnRenamed("slice", "of_slice"), (own["supplier_name"] == F.col("of_supplier")) & (own["slice"] == F.col("of_slice")) & there, "left")
    kind = over_time.schema
    rest = docs.where(~known).select("doc_id", "supplier_name", "at", F.lit(None).cast(kind["fields"].dataType).alias("fields"), F.lit(None).cast(kind["valid_from"].dataType).alias("valid_from"))
    return met.select("doc_id", "supplier_name", "at", "fields", "valid_from").unionByName(rest)
