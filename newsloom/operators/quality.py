"""Data quality, repairs and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import schema
from newsloom.functions.text import clean_text
from newsloom.operators.filters import recent_window


def check_constraints(articles: DataFrame, feedback: DataFrame) -> DataFrame:
    """``(rule, violations)``: unique keys, required columns and domains."""
    repeats = lambda df, cols, name: df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    found = lambda df, cond, name: df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    domain = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
    rules = [
        repeats(articles, ["topic_id", "url"], "unique_topic_url"), repeats(feedback, ["user_id", "news_id", "action"], "unique_feedback"),
        found(feedback, domain("action", schema.ACTIONS), "feedback_action"), found(articles, F.col("title").isNull() | F.col("url").isNull(), "title_url_required"),
        found(articles, domain("sentiment_label", schema.LABELS), "sentiment_label"), found(articles, F.length("language") > 10, "language_length"),
    ]
    return reduce(lambda a, b: a.unionByName(b), rules)


def cascade_delete(articles: DataFrame, feedback: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting articles deletes their feedback and frees the stories that they stood for."""
    gone = ids.select("id").distinct()
    left = articles.join(gone, "id", "left_anti")
    marks = gone.select(F.col("id").alias("cluster_rep_id"), F.lit(True).alias("__gone"))
    left = left.join(marks, "cluster_rep_id", "left").withColumn("cluster_rep_id", F.when(F.col("__gone").isNull(), F.col("cluster_rep_id")))
    return left.select(*articles.columns), feedback.join(gone.withColumnRenamed("id", "news_id"), "news_id", "left_anti").select(*feedback.columns)


def backfill_published(df: DataFrame) -> DataFrame:
    """Missing publish times are copied from the first sight, which then follows the publish time wherever they differ."""
    out = df.withColumn("published_at", F.coalesce("published_at", "first_seen_at"))
    differs = ~F.col("first_seen_at").eqNullSafe(F.col("published_at"))
    return out.withColumn("first_seen_at", F.when(differs, F.col("published_at")).otherwise(F.col("first_seen_at")))


def reset_enrichment(df: DataFrame, bodies: DataFrame, min_len: int = 100) -> DataFrame:
    """A body long enough and other than the title replaces the summary, and all that was derived from it is done again."""
    b = bodies.select("id", F.col("body").alias("__body"))
    out = df.join(b, "id", "left").withColumn("__use", F.coalesce((F.length("__body") >= min_len) & (F.col("__body") != F.col("title")), F.lit(False)))
    kinds = {f.name: f.dataType for f in df.schema}
    derived = {"summary": F.col("__body"), "llm_enrich_attempts": F.lit(0), **{c: F.lit(None) for c in ("ai_summary", "translated_title", "translated_summary", "sentiment", "sentiment_label", "embedding", "llm_last_attempt_at")}}
    return out.select(*(F.when(F.col("__use"), derived[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in derived else F.col(c) for c in df.columns))


def backfill_clean(df: DataFrame, as_of: Column, days: int = 7, decode: bool = True) -> DataFrame:
    """``(id, title, summary)`` of recent rows not yet enriched whose cleaned texts differ from the stored ones."""
    rows = recent_window(df, "first_seen_at", days, "days", as_of).where("ai_summary is null")
    clean = lambda c: clean_text(F.col(c), F.col("source_url"), decode)
    out = rows.withColumn("new_title", clean("title")).withColumn("new_summary", F.when(F.col("summary").isNotNull(), clean("summary")))
    changed = ~F.col("title").eqNullSafe(F.col("new_title")) | ~F.col("summary").eqNullSafe(F.col("new_summary"))
    return out.where(changed).select("id", F.col("new_title").alias("title"), F.col("new_summary").alias("summary"))
