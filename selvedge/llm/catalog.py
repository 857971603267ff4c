"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, collocations, decontamination, fingerprints, language, license_scan, near_dedup, packing, quality, resampling, sharding, token_counts, tokenizer_codec
from .shared import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_document_likeness(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scanned(table(spark, sf_dir, "documents")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_codec.round_trips(table(spark, sf_dir, "documents"))


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op8_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.digest(resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    query.__name__: shipped(query)
    for query in (
        op1_page_languages,
        op2_syncmer_fingerprints,
        op3_license_scan,
        op4_near_duplicates,
        op5_weak_label_quality,
        op6_byte_bpe,
        op7_rendezvous_shards,
        op8_prefix_forest,
        op9_retrieval_packing,
        op10_token_counts,
        op11_phrase_collocations,
        op12_importance_resampling,
        op13_benchmark_decontamination,
    )
}

ORACLES: dict[str, str] = {
    "op7_rendezvous_shards": sharding.oracle(),
    "op11_phrase_collocations": collocations.oracle(),
    "op12_importance_resampling": resampling.oracle(),
    "op13_benchmark_decontamination": decontamination.oracle(),
}
