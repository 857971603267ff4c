"""A training-corpus pipeline: quality classifier, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvedge.llm import language, near_dedup, packing, quality
from selvedge.llm.shared import ids_for_join, row_key, row_keys, ship, table, unused, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' weak labels, holds good. Each row is judged by its own text, in the pass that reads it: null, empty and blank texts are rejected, null and repeated ids and repeated rows change nothing, an empty table stays empty, other columns come along whatever they are called."""
    ship(spark)
    return quality.accepted(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents are labelled with. Each row is judged by its own text, label and source, whatever its id; one with neither text nor label is rejected; repeated rows share one verdict; an empty table stays empty; other columns come along."""
    ship(spark)
    return language.in_known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document of the least doc_id, those without one last. Rows are told apart by doc_id and text together, so that different texts of one doc_id, or without any, are judged each for itself; of rows that repeat both, the first in order of all columns stays. Null, empty and blank texts are near nothing, so each such row of an id of its own stays. An empty table stays empty; other columns come along."""
    ship(spark)
    key, (_, second) = row_key(docs, "doc_id", "text"), row_keys(docs, "doc_id", "text")
    found = near_dedup.near_duplicates(docs.select(key.alias("doc_id"), "text"), shingle=5, percent=80)
    found = written(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"), "kept"), "near-duplicates")
    linked = found.where("NOT kept").select("key", "component").distinct()
    members = written(linked.unionByName(linked.select(F.col("component").alias("key"), "component").distinct()), "members")
    ids = docs.select(key.alias("key"), second.alias("second"), F.col("doc_id").cast("long").alias("doc_id")).join(members, "key")
    ids = written(ids.groupBy("component", "key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("id"), (F.min("second") < F.max("second")).alias("shared")), "groups")
    least = ids.groupBy("component").agg(F.min(F.struct("id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    name = unused("removed", docs)
    # Rows that differ and share a key by chance all stay.
    removed = written(ids.where("NOT shared").join(least, "key", "left_anti").select(F.col("key").alias(name)), "removed")
    kept = docs.join(ids_for_join(removed), key == F.col(name), "left_anti")
    repeats = written(found.groupBy("key").count().where("count > 1").select(F.col("key").alias(name)), "repeats")
    if not repeats.limit(1).count():
        return kept
    repeats, key = ids_for_join(repeats), row_key(kept, "doc_id", "text")
    several = kept.join(repeats, key == F.col(name), "left_semi")
    row = F.struct(*[several[f"`{c}`"] for c in docs.columns])
    # Of rows that repeat doc_id and text, the first in order of all columns, written out.
    first = several.groupBy(*row_keys(several, "doc_id", "text")).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.join(repeats, key == F.col(name), "left_anti").unionByName(first.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens (the columns of packing.packed, not those of documents). Null and empty texts are an end id alone; null and repeated ids and repeated rows are packed as often as they are there; an empty table gives no pieces."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("packing", sequences),
]

#: No stage but the first steps can be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a folder of tables to the pieces of the packed corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
