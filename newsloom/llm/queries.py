"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, contamination, embedding_quality, html_text, langid, licenses, periodic_runs, pii, quality, substring_dedup, token_alignment, token_files
from newsloom.llm.jaccard_join import jaccard_components

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own: the source is the top directory, the language the one in it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs.withColumn("path", F.concat_ws("/", part("source"), part("lang"), part("doc_id"))))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_report(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_quality.score_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan, op2_token_files, op3_language_id, op4_decontamination, op5_substring_dedup, op6_pii, op7_html_extraction, op8_quality_rules, op9_bpe,
        op10_ngram_jaccard_join, op11_quality_classifier, op12_token_alignment, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": contamination.SQL}
