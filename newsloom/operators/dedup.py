"""Duplicates by URL, upserts, and the state that collectors keep between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.score import month_bucket
from newsloom.functions.text import blank_to_null
from newsloom.operators.running import running_sums
from newsloom.scratch import Scratch


def distinct_urls(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each URL."""
    w = Window.partitionBy("url").orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def split_new_existing(batch: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = existing.select("url")
    return batch.join(known, "url", "left_anti"), batch.join(known, "url", "left_semi")


def new_articles(existing: DataFrame, batch: DataFrame, as_of: Column, schema) -> DataFrame:
    """The batch's articles of unknown URLs, the first of each, as rows of ``schema``. Reads ``url`` and ``id`` of ``existing`` only; new ids follow the greatest one."""
    fresh = distinct_urls(batch.join(existing.select("url"), "url", "left_anti"), [F.col("position")])
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # ids without a single-partition window: a number within each hash bucket, and the buckets' offsets (a fixed number of rows)
    buckets = 256
    held = fresh.withColumn("__b", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    base = held.groupBy("__b").agg(F.count("*").alias("n"))
    base = base.select("__b", (F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__base"))
    held = held.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("position", "url")))
    new = held.join(F.broadcast(base), "__b").crossJoin(F.broadcast(top))  # at most 256 rows, and one row
    return new_rows(new.drop("id", "at").withColumns({"id": F.col("top") + F.col("__base") + F.col("__r"), "at": as_of}), schema)


def new_rows(fresh: DataFrame, schema) -> DataFrame:
    """Records of unknown URLs, with their ``id`` and the time ``at`` that they came, as rows of ``schema``."""
    given = {"id": F.col("id"), "hit_count": F.lit(1), "llm_enrich_attempts": F.lit(0), "cluster_size": F.lit(1)} | {c: F.col("at") for c in ("first_seen_at", "last_seen_at", "created_at", "updated_at")}
    value = lambda c: given[c] if c in given else F.col(c) if c in fresh.columns else F.lit(None)
    return fresh.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in schema))


def bumped_articles(articles: DataFrame, bumps: DataFrame) -> DataFrame:
    """``articles`` with ``bumps(url, hits, at)``, one row a URL, laid over: hit_count grows, last_seen_at and updated_at follow."""
    out = articles.join(bumps.select("url", "hits", "at"), "url", "left")
    return out.select(*(
        F.when(F.col("hits").isNotNull(), F.coalesce(F.col("hit_count"), F.lit(0)) + F.col("hits")).otherwise(F.col("hit_count")).cast("int").alias(c) if c == "hit_count"
        else F.coalesce("at", c).alias(c) if c in ("last_seen_at", "updated_at")
        else F.col(c)
        for c in articles.columns
    ))


def upsert_articles(existing: DataFrame, batch: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """First writer wins: a known URL only bumps hit_count, last_seen_at and updated_at, once a batch.

    ``batch`` has records and an arrival ``position``; its own repeats are dropped first. Returns the new table and the counts
    (inserted, updated), updated counting every batch row of a known URL. New ids follow the greatest one.
    """
    seen = batch.groupBy("url").agg(F.count("*").alias("rows"))
    known = bumped_articles(existing, seen.select("url", F.lit(1).alias("hits"), as_of.alias("at")))
    counts = seen.join(existing.select("url", F.lit(True).alias("hit")), "url", "left").agg(
        F.count_if(F.col("hit").isNull()).alias("inserted"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("rows"))), F.lit(0)).alias("updated")
    )
    return known.unionByName(new_articles(existing, batch, as_of, existing.schema)), counts


def batch_hits(runs: DataFrame) -> DataFrame:
    """What a stream of upserts comes to: per URL the runs it was in, and its first article."""
    first = F.min_by(F.struct("id", "title"), F.struct("run_id", "id"))
    return runs.groupBy("url").agg(F.count_distinct("run_id").alias("hit_count"), first.alias("first")).select("url", "hit_count", F.col("first.id").alias("id"), F.col("first.title").alias("title"))


def drop_linked_duplicates(posts: DataFrame, articles: DataFrame) -> DataFrame:
    """Posts without a link stay."""
    return posts.join(articles.select(F.col("url").alias("linked_url")), "linked_url", "left_anti")


def newer_than_since_id(posts: DataFrame, since: DataFrame) -> DataFrame:
    """Posts above their account's marker; an account without one keeps all."""
    marks = since.select(F.lower("username").alias("__u"), F.col("since_id").alias("__since"))
    out = posts.join(marks, F.lower("username") == F.col("__u"), "left")
    return out.where(F.col("__since").isNull() | (F.col("id") > F.col("__since"))).drop("__u", "__since")


def latest_post_id(posts: DataFrame, since: DataFrame) -> DataFrame:
    """The next markers: never lower than the last ones."""
    both = posts.select(F.lower("username").alias("username"), F.col("id").alias("since_id")).unionByName(since.select(F.lower("username").alias("username"), "since_id"))
    return both.groupBy("username").agg(F.max("since_id").alias("since_id"))


def monthly_spend(posts: DataFrame, price: float, budget: float, column: str = "created_at") -> DataFrame:
    out = posts.groupBy(month_bucket(F.col(column)).alias("month")).agg(F.count("*").alias("posts"))
    spend = F.round(F.col("posts") * F.lit(price), 6)
    return out.withColumn("spend", spend).withColumn("over_budget", F.col("spend") >= budget)


GATED = "month string, id long, allowed boolean"


def gate_posts(posts: DataFrame, spent: DataFrame, price: float, budget: float, scratch: Scratch | None = None) -> DataFrame:
    """Per post (``month``, ``id``), by id, whether what its month had ``spent(month, posts)`` before it and the posts before it left room in the budget."""
    ordered = running_sums(posts, [F.col("month")], [F.col("id")], F.lit(1), "before", scratch=scratch)
    out = ordered.join(spent.select(F.col("month").alias("__month"), F.col("posts").alias("spent")), F.col("month").eqNullSafe(F.col("__month")), "left")
    before = F.col("before") + F.coalesce("spent", F.lit(0))
    return out.select("month", "id", (before * F.lit(price) < budget).alias("allowed"))


def dedupe_feedback(df: DataFrame) -> DataFrame:
    """Of equal (user, article, action) rows the one with the least id."""
    return df.groupBy("user_id", "news_id", "action").agg(F.min("id").alias("id"))


def current_feedback(events: DataFrame) -> DataFrame:
    """State after a log of ``(id, user_id, news_id, action, op)``, op add or delete: adding is idempotent, like and dislike exclude each other."""
    slot = F.when(F.col("action").isin("like", "dislike"), "opinion").otherwise(F.col("action"))
    e = events.where(F.col("action").isin("bookmark", "like", "dislike", "dismiss")).withColumn("slot", slot)
    # a delete of the other opinion changes nothing, so the last event of a slot decides unless it deletes what isn't there
    w = Window.partitionBy("user_id", "news_id", "slot").orderBy("id")
    added = F.last(F.when(F.col("op") == "add", F.col("action")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    idle = (F.col("op") == "delete") & ~F.col("action").eqNullSafe(F.col("added"))
    live = e.withColumn("added", added).where(~idle)
    last = live.groupBy("user_id", "news_id", "slot").agg(F.max_by(F.struct("op", "action"), F.col("id")).alias("last"))
    return last.where("last.op = 'add'").select("user_id", "news_id", F.col("last.action").alias("action"))


def check_references(feedback: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback on known articles, and the rest."""
    ids = articles.select(F.col("id").alias("news_id"))
    return feedback.join(ids, "news_id", "left_semi"), feedback.join(ids, "news_id", "left_anti")


def apply_enrichment(articles: DataFrame, results: DataFrame) -> DataFrame:
    """Writes what a result has: texts that aren't empty, tags where there are none yet, any score; an all-empty result stays due for a retry."""
    r = results.select("id", *(F.col(c).alias(f"__{c}") for c in ("ai_summary", "translated_title", "translated_summary", "tickers", "sectors", "sentiment", "sentiment_label")))
    out = articles.join(r, "id", "left")
    for c in ("ai_summary", "translated_title", "translated_summary"):
        out = out.withColumn(c, F.coalesce(blank_to_null(F.col(f"__{c}")), F.col(c)))
    for c in ("tickers", "sectors"):
        empty = F.coalesce(F.size(c), F.lit(0)) <= 0
        out = out.withColumn(c, F.when(empty & (F.size(f"__{c}") > 0), F.col(f"__{c}")).otherwise(F.col(c)))
    out = out.withColumn("llm_sentiment", F.coalesce("__sentiment", "llm_sentiment")).withColumn("llm_sentiment_label", F.coalesce("__sentiment_label", "llm_sentiment_label"))
    return out.select(*articles.columns)


def merge_body(thin: DataFrame, bodies: DataFrame, least: int = 50) -> DataFrame:
    """Short summaries are replaced by fetched bodies that aren't short."""
    out = thin.join(bodies.select("url", F.col("body").alias("__body")), "url", "left")
    use = (F.length(F.coalesce("summary", F.lit(""))) < least) & (F.length("__body") >= least)
    return out.withColumn("summary", F.when(use, F.col("__body")).otherwise(F.col("summary"))).select(*thin.columns)
