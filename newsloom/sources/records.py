"""Landed payloads to one article record, and the tables that hold them. No source fetches: Spark reads what has landed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schema
from newsloom.functions import text as X

RECORD = schema.RECORD.fieldNames()
#: Fixed values of the formats.
POST_URL, CHANNEL_URL = "https://x.com/", "https://www.youtube.com/post/"
REMOVED = "[Removed]"
TITLE_CHARS, CHANNEL_TITLE_CHARS, SHORT_TITLE = 100, 150, 20
MIN_BODY = 40
HEAVY = ("embedding", "raw_data")
_NO_TAGS = lambda: F.array().cast("array<string>")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ARTICLE).parquet(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TOPIC).parquet(path).orderBy("name", "id")


def read_feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(schema.FEEDBACK).parquet(path)


def normalize_feed_entries(entries: DataFrame, feeds: DataFrame, decode: bool = True) -> DataFrame:
    """Feed entries with ``feeds(feed_url, language)`` to records; entries with no title or link drop."""
    e = entries.join(feeds.select("feed_url", "language"), "feed_url", "left")  # planned as a broadcast while feeds is small
    hint = F.col("feed_url")
    links = F.filter(F.transform("links", lambda x: X.blank_to_null(x["href"])), lambda x: x.isNotNull())
    summary = F.coalesce(X.blank_to_null(F.col("summary")), F.col("description"))
    out = e.select(
        X.clean_text(F.col("title"), hint, decode).alias("title"),
        X.strip(F.coalesce(X.blank_to_null(F.col("link")), F.get(links, F.lit(0)))).alias("url"),
        hint.alias("source_url"), F.lit("rss").alias("source_type"), F.coalesce("language", F.lit("en")).alias("language"),
        X.blank_to_null(X.clean_text(summary, hint, decode)).alias("summary"),
        X.parse_published(F.coalesce("published", "updated")).alias("published_at"),
        X.tickers_from_tags(F.transform("tags", lambda t: t["term"])).alias("tickers"), _NO_TAGS().alias("sectors"),
        F.to_json(F.struct("title", "link", "summary", "description", "published", "updated", "tags")).alias("raw_data"),
    )
    return out.where("title <> '' and url is not null")


def normalize_news_api(responses: DataFrame, base_url: str = "https://newsapi.org/v2", tag: str = "everything") -> DataFrame:
    """Responses with status ok, one record an article; blank and removed ones drop."""
    a = responses.where("status = 'ok'").select(F.explode("articles").alias("a"))
    text = lambda k: X.blank_to_null(X.strip(F.col(f"a.{k}")))
    live = lambda c: F.when(c != REMOVED, c)
    name = F.coalesce(X.blank_to_null(F.col("a.source.name")), X.blank_to_null(F.col("a.source.id")), F.lit("newsapi"))
    return a.select(
        live(text("title")).alias("title"), live(text("url")).alias("url"), F.lit(f"{base_url}/{tag}").alias("source_url"),
        F.lit("newsapi").alias("source_type"), F.lit("en").alias("language"), F.coalesce(live(text("description")), live(text("content"))).alias("summary"),
        X.parse_published(F.col("a.publishedAt")).alias("published_at"), _NO_TAGS().alias("tickers"), _NO_TAGS().alias("sectors"),
        F.to_json(F.struct("a.*", name.alias("_source_name"), F.lit(tag).alias("_source_tag"))).alias("raw_data"),
    ).where("title is not null and url is not null")


def normalize_posts(posts: DataFrame) -> DataFrame:
    """Microblog posts to records; blank ones drop."""
    p = posts.withColumn("text", X.strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    t = F.col("text")
    inner = F.struct(F.col("id").alias("tweet_id"), "username", X.is_breaking(t).alias("breaking"), X.first_expanded_url(F.col("entities.urls")).alias("linked_url"))
    return p.select(
        F.when(F.length(t) > TITLE_CHARS, F.concat(F.substring(t, 1, TITLE_CHARS), F.lit("…"))).otherwise(t).alias("title"),
        F.concat(F.lit(POST_URL), "username", F.lit("/status/"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit(POST_URL), "username").alias("source_url"), F.lit("x_feed").alias("source_type"),
        F.coalesce(X.blank_to_null(F.col("lang")), F.lit("en")).alias("language"), t.alias("summary"), F.col("created_at").alias("published_at"),
        _NO_TAGS().alias("tickers"), _NO_TAGS().alias("sectors"), F.to_json(F.struct(inner.alias("x"))).alias("raw_data"),
    )


def normalize_channel_posts(posts: DataFrame, as_of: Column, language: str = "ko") -> DataFrame:
    """Channel posts to records; a post with no id or text drops."""
    runs = F.coalesce(F.array_join(F.transform("contentText.runs", lambda r: F.coalesce(r["text"], F.lit(""))), ""), F.lit(""))
    p = posts.withColumn("text", runs).where((F.coalesce("postId", F.lit("")) != "") & (X.strip(runs) != ""))
    t = F.col("text")
    thumb = lambda r: X.blank_to_null(F.try_element_at(r["image"]["thumbnails"], F.lit(-1))["url"])
    one = F.array(thumb(F.col("backstageAttachment.backstageImageRenderer")))
    many = F.transform(F.col("backstageAttachment.postMultiImageRenderer.images"), lambda x: thumb(x["backstageImageRenderer"]))
    images = F.array_compact(F.concat(one, F.coalesce(many, _NO_TAGS())))
    when = F.coalesce(X.blank_to_null(F.get("publishedTimeText.runs", F.lit(0))["text"]), F.col("publishedTimeText.simpleText"), F.lit(""))
    stripped = X.strip(t)
    line = F.substring(F.substring_index(stripped, "\n", 1), 1, CHANNEL_TITLE_CHARS)
    whole = F.substring(stripped, 1, CHANNEL_TITLE_CHARS)
    inner = F.struct(
        F.col("postId").alias("post_id"), "handle", X.post_category(t).alias("category"), when.alias("published_time_text"), images.alias("image_urls"),
        X.vote_count(F.coalesce("voteCount.accessibility.accessibilityData.label", F.lit(""))).alias("vote_count"),
    )
    return p.select(
        F.when((F.length(line) < SHORT_TITLE) & (F.length(t) > SHORT_TITLE), whole).otherwise(line).alias("title"),
        F.concat(F.lit(CHANNEL_URL), "postId").alias("url"), F.concat(F.lit("youtube_channel:"), F.coalesce("handle", F.lit(""))).alias("source_url"),
        F.lit("youtube_post").alias("source_type"), F.lit(language).alias("language"), t.alias("summary"), X.relative_time(when, as_of).alias("published_at"),
        _NO_TAGS().alias("tickers"), _NO_TAGS().alias("sectors"), F.to_json(F.struct(inner.alias("youtube"))).alias("raw_data"),
    )


def ingest_pages(pages: DataFrame, as_of: Column, language: str | None = None) -> DataFrame:
    """Stored web pages to records with a status: ok, login_required, unsupported or error. Only ok rows have a record's values."""
    kind = F.lower(F.coalesce("content_type", F.lit("text/html")))
    html, url = F.coalesce("html", F.lit("")), F.coalesce("final_url", "url")
    p = pages.select("url", url.alias("final_url"), F.coalesce("http_status", F.lit(200)).alias("http_status"), kind.alias("kind"), html.alias("html"))
    p = p.withColumn("reason", X.login_wall_reason(F.col("final_url"), F.col("kind"), F.col("html"))).withColumn("body", X.html_body_text(F.col("html")))
    status = (
        F.when(F.col("http_status") >= 400, "error").when(~F.col("kind").startswith("text/html"), "unsupported")
        .when(F.col("reason").isNotNull(), "login_required").when(F.length("body") < MIN_BODY, "error").otherwise("ok")
    )
    p = p.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "ok", c)
    lang = F.coalesce(F.lit(language), X.html_lang(F.col("html")), F.lit("ko"))
    return p.select(
        "status", F.coalesce("reason", F.lit("")).alias("message"), F.length("body").alias("extracted_len"),
        ok(X.choose_title(X.html_title(F.col("html")), F.col("body"), F.col("final_url"))).alias("title"), F.col("final_url").alias("url"),
        F.lit("url_ingest").alias("source_url"), F.lit("url_report").alias("source_type"), ok(lang).alias("language"), ok(F.col("body")).alias("summary"),
        ok(as_of).alias("published_at"), _NO_TAGS().alias("tickers"), _NO_TAGS().alias("sectors"),
        F.to_json(F.struct(F.struct(F.col("url").alias("requested_url"), F.col("kind").alias("content_type")).alias("url_ingest"))).alias("raw_data"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def raw_to_variant(df: DataFrame, column: str) -> DataFrame:
    """A nested payload or JSON text to a variant; an empty one to null, text that isn't JSON to a string."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        c = F.col(column)
        value = F.when(F.coalesce(c, F.lit("")).isin("", "{}", "[]"), None).otherwise(F.coalesce(F.try_parse_json(c), F.try_variant_get(F.parse_json(F.to_json(F.struct(c.alias("x")))), "$.x", "variant")))
    else:
        text = F.to_json(column)
        value = F.when(text.isin("{}", "[]"), None).otherwise(F.try_parse_json(text))
    return df.withColumn(column, value)


def article_view(df: DataFrame) -> DataFrame:
    """What a reader sees: the heavy columns stay unread."""
    return df.select(*(c for c in df.columns if c not in HEAVY))
