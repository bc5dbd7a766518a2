"""Feeds, lists and the rolling summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.score import FEED_E, recency
from newsloom.operators.affinity import with_boost
from newsloom.operators.filters import ArticleFilter, apply_filters, effective_published, representatives_only

POOL = 300


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """1-based pages of 1 to 100 rows, planned as one TakeOrderedAndProject."""
    size = max(1, min(100, size))
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def exclude_dismissed(df: DataFrame, feedback: DataFrame, user: str) -> DataFrame:
    gone = feedback.where((F.col("user_id") == user) & (F.col("action") == "dismiss")).select(F.col("news_id").alias("id"))
    return df.join(gone, "id", "left_anti")


def sort_keys(sort: str) -> list[Column]:
    """An unknown sort is the latest first."""
    newest, last = F.desc("effective_published"), F.desc("id")
    strength = F.abs(F.coalesce("sentiment", F.lit(0.0))).desc()
    return {"cluster_size": [F.desc("cluster_size"), newest, last], "sentiment_strength": [strength, newest, last]}.get(sort, [newest, last])


def feed_base(df: DataFrame, filters: ArticleFilter | None = None, feedback: DataFrame | None = None, user: str | None = None, dedup: bool = True, hide_dismissed: bool = True) -> DataFrame:
    out = apply_filters(df, filters or ArticleFilter())
    if dedup:
        out = out.where(representatives_only())
    if hide_dismissed and feedback is not None and user is not None:
        out = exclude_dismissed(out, feedback, user)
    return out.withColumn("effective_published", effective_published())


def feed(df: DataFrame, sort: str = "latest", page: int = 1, size: int = 20, affinity: DataFrame | None = None, user: str | None = None, as_of: Column | None = None, **base) -> DataFrame:
    """One page of a feed. The personalised sort ranks the newest ``POOL`` rows after the filters."""
    rows = feed_base(df, user=user, **base)
    if sort != "personalized" or affinity is None:
        return paginate(rows, sort_keys(sort), page, size)
    pool = rows.orderBy(F.desc("effective_published"), F.desc("id")).limit(POOL)
    ranked = with_boost(pool, affinity, user).withColumn("rank_score", (1 + F.col("boost")) * recency(F.col("effective_published"), as_of, clamp=True, base=FEED_E))
    return paginate(ranked, [F.desc("rank_score"), F.desc("effective_published"), F.desc("id")], page, size)


def list_articles(df: DataFrame, filters: ArticleFilter | None = None, page: int = 1, size: int = 20) -> DataFrame:
    return paginate(apply_filters(df, filters or ArticleFilter()), [F.desc("last_seen_at"), F.desc("id")], page, size)


def articles_by_topic(df: DataFrame, topics: DataFrame, slug: str, page: int = 1, size: int = 20) -> DataFrame:
    topic = topics.where(F.col("slug") == slug).select(F.col("id").alias("topic_id"))
    return paginate(df.join(topic, "topic_id", "left_semi"), [F.desc("last_seen_at"), F.desc("id")], page, size)


def cluster_siblings(df: DataFrame, article_id: int) -> DataFrame:
    """All members of the article's story; an article without one is its own."""
    rep = df.where(F.col("id") == article_id).agg(F.max("cluster_rep_id").alias("__rep"))
    out = df.join(F.broadcast(rep), F.col("cluster_rep_id") == F.col("__rep"), "left")  # one row
    out = out.where(F.col("__rep").isNotNull() | (F.col("id") == article_id)).drop("__rep")
    return out.orderBy(F.desc_nulls_last("similarity_to_rep"), F.desc("last_seen_at"), F.desc("id"))


def articles_by_action(df: DataFrame, feedback: DataFrame, user: str, action: str, page: int = 1, size: int = 20) -> DataFrame:
    """The user's articles of an action, newest feedback first, with the total."""
    given = feedback.where((F.col("user_id") == user) & (F.col("action") == action)).select(F.col("news_id").alias("id"), F.col("created_at").alias("given_at"), F.col("id").alias("feedback_id"))
    rows = df.join(given, "id")
    total = rows.agg(F.count("*").alias("total"))
    return paginate(rows, [F.desc("given_at"), F.desc("feedback_id")], page, size).crossJoin(F.broadcast(total))  # one row


def feedback_states(feedback: DataFrame, ids: DataFrame, user: str) -> DataFrame:
    """Per asked id its actions, an empty list where there are none."""
    given = feedback.where(F.col("user_id") == user).join(ids.select(F.col("id").alias("news_id")).distinct(), "news_id", "left_semi")
    given = given.groupBy(F.col("news_id").alias("id")).agg(F.sort_array(F.collect_set("action")).alias("actions"))  # four actions at most
    return ids.select("id").distinct().join(given, "id", "left").select("id", F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def in_last_hours(df: DataFrame, hours: int, as_of: Column) -> DataFrame:
    return df.where(effective_published() >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col("sentiment_label") == k).alias(k) for k in ("positive", "negative", "neutral")))


def _top(df: DataFrame, column: str, n: int, fold=lambda c: c) -> DataFrame:
    tags = df.select(F.explode(column).alias("raw")).where("raw is not null and raw <> ''").select(fold(F.col("raw")).alias("name"))
    return tags.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n)


def top_tickers(df: DataFrame, n: int = 10) -> DataFrame:
    return _top(df, "tickers", n, F.upper)


def top_sectors(df: DataFrame, n: int = 10) -> DataFrame:
    return _top(df, "sectors", n)


def coverage_counts(df: DataFrame) -> DataFrame:
    some = lambda c: F.coalesce(F.exists(c, lambda x: x != ""), F.lit(False))
    return df.agg(
        F.count("*").alias("total"), F.count_if(some("tickers")).alias("with_tickers"), F.count_if(some("sectors")).alias("with_sectors"),
        F.count_if(F.coalesce(F.col("ai_summary") != "", F.lit(False))).alias("enriched"),
    )


def feed_summary(df: DataFrame, hours: int, top_n: int, as_of: Column) -> DataFrame:
    """One row: label counts, coverage, and the top tickers and sectors as arrays of (name, n)."""
    rows = in_last_hours(df, hours, as_of).select("sentiment_label", "tickers", "sectors", "ai_summary")
    listed = lambda top, name: top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "name"))).alias("x")).select(F.transform("x", lambda s: F.struct(s["name"].alias("name"), (-s["neg"]).alias("n"))).alias(name))
    parts = [coverage_counts(rows), sentiment_distribution(rows), listed(top_tickers(rows, top_n), "top_tickers"), listed(top_sectors(rows, top_n), "top_sectors")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def cluster_size_distribution(df: DataFrame) -> DataFrame:
    size = df.where("cluster_rep_id is not null").groupBy("cluster_rep_id").agg(F.max("cluster_size").alias("size"))
    return size.groupBy("size").agg(F.count("*").alias("clusters"))


def cluster_size_report(df: DataFrame) -> DataFrame:
    size = df.where("cluster_rep_id is not null").groupBy("cluster_rep_id").agg(F.max("cluster_size").alias("size"))
    return size.agg(F.count("*").alias("clusters"), F.max("size").alias("largest"), F.count_if(F.col("size") >= 50).alias("over_50"), F.count_if(F.col("size") >= 100).alias("over_100"))


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def feed_health(entries: DataFrame, as_of: Column, first: int = 40, hours: int = 48) -> DataFrame:
    """Per feed over its first entries (``position``): count, recent ones, mean summary length, and whether it is well."""
    w = Window.partitionBy("feed_url").orderBy("position")
    e = entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    recent = F.col("published_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))
    out = e.groupBy("feed_url").agg(F.count("*").alias("entries"), F.count_if(F.coalesce(recent, F.lit(False))).alias("recent"), F.round(F.avg(F.length(F.coalesce("summary", F.lit("")))), 6).alias("mean_summary"))
    well = (F.col("recent") >= 1) & (F.col("entries") >= 3)
    return out.withColumn("ok", well).withColumn("reason", F.when(well, "ok").when(F.col("entries") < 3, "few_entries").otherwise("stale"))


def page_score_stats(page: DataFrame, *by: str) -> DataFrame:
    """Of a page of search results, or of each query's: top and mean score, rows without a text score, and whether the first three have none."""
    return page.groupBy(*by).agg(
        F.max("final_score").alias("top_score"), F.round(F.avg("final_score"), 6).alias("mean_score"), F.count_if(F.col("fts_score") <= 0).alias("zero_fts"),
        F.coalesce(F.bool_and(F.when(F.col("position") <= 3, F.col("fts_score") <= 0)), F.lit(False)).alias("top3_zero_fts"),
    )
