"""The corpus pipeline: five stages, each on all that the one before it kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, langid, pii
from newsloom.llm.contamination import decontaminate
from newsloom.llm.jaccard_join import jaccard_components
from newsloom.llm.queries import BYTE_BPE
from newsloom.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go.

    Null, blank and letterless texts are rejected. Repeated rows are judged alike; a row with a null id is judged, not learned from. An empty table stays empty.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; so do documents that link with nothing, among them null and blank texts.

    Of repeated rows with one id one row stays, the least by its text and then its other columns. Rows with a null id stay: which document they are isn't known.
    An empty table stays empty.
    """
    scratch = Scratch(spark, "near")
    twice = scratch.save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    gone = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    if twice.isEmpty():  # ids are unique, as a rule
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    gone = scratch.save(gone)
    row = F.struct(*docs.columns)
    least = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row")).select("row.*")  # JSON orders columns of any type
    rest = docs.join(twice, "doc_id", "left_anti").unionByName(least)
    return rest.join(gone, "doc_id", "left_anti").select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and blank texts contain nothing. Repeated rows of one id are taken together; rows with a null id stay. An empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars, where there is one, follows the text. Every row stays, whatever its id; a null text stays null and keeps its n_chars."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean.select(*docs.columns)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: one row per row, also for a null id; a null text has no tokens."""
    return bpe.token_digests(docs, BYTE_BPE)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination), ("private_data", private_data), ("encoding", encoding)]

#: A trained model and the merges of the vocabulary can't be put in SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
