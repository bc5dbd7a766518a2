"""Articles, feedback and the other tables as views over the given tables, by formulas that DuckDB can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
TICKERS = ("AAPL", "MSFT", "nvda", "TSLA", "AMZN", "META", "GOOG", "INTC", "AMD", "IBM", "ORCL", "CSCO")
SECTORS = ("tech", "energy", "health", "finance", "retail", "auto", "media", "utilities")
SOURCE_TYPES = ("rss", "api", "x_feed", "youtube_post", "url_report")
ACTIONS = {"click": "like", "error": "dislike", "purchase": "bookmark", "signup": "dismiss", "view": "view"}
_EPOCH = "timestamp'2024-01-01 00:00:00'"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def articles(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Articles of the documents: the text is the summary, its first line the title, its last line the ai_summary (of every other article)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    step = lambda n: f"make_dt_interval(0, 0, {n}, 0)"
    tags = lambda names, count, jump: f"transform(sequence(0, cast({count} - 1 as int)), k -> element_at(array({_list(names)}), cast((doc_id + {jump} * k) % {len(names)} + 1 as int)))"
    out = docs.selectExpr(
        "doc_id as id", "cast(null as bigint) as topic_id", "substring_index(text, '\\n', 1) as title", "text as summary",
        "concat('https://x.example/', md5(text)) as url", "lang as language", "source as source_url",
        f"element_at(array({_list(SOURCE_TYPES)}), cast(doc_id % 5 + 1 as int)) as source_type",
        f"{_EPOCH} + {step('(doc_id * 43) % 43200')} as first_seen_at", f"{_EPOCH} + {step('(doc_id * 43) % 43200 + doc_id % 97')} as last_seen_at",
        f"case when doc_id % 11 <> 0 then {_EPOCH} + {step('(doc_id * 43) % 43200 - doc_id % 300')} end as published_at",
        "case when doc_id % 17 <> 0 then ((doc_id * 7919) % 2001 - 1000) / 1000.0d end as sentiment",
        "case when doc_id % 3 <> 0 then ((doc_id * 104729) % 2001 - 1000) / 1000.0d end as llm_sentiment",
        f"case when doc_id % 4 <> 0 then {tags(TICKERS, 'doc_id % 4', 5)} end as tickers", f"case when doc_id % 3 <> 0 then {tags(SECTORS, 'doc_id % 3', 3)} end as sectors",
        "case when doc_id % 2 = 0 then null when doc_id % 10 = 1 then '' else substring_index(text, '\\n', -1) end as ai_summary", "md5(text) as text_key",
    )
    label = lambda c: F.when(F.col(c) >= 0.2, "positive").when(F.col(c) <= -0.2, "negative").when(F.col(c).isNotNull(), "neutral")
    out = out.withColumns({
        "sentiment_label": label("sentiment"), "llm_sentiment_label": label("llm_sentiment"), "hit_count": F.lit(1), "llm_enrich_attempts": F.lit(0),
        "llm_last_attempt_at": F.lit(None).cast("timestamp"), "translated_title": F.lit(None).cast("string"), "translated_summary": F.lit(None).cast("string"),
        "cluster_rep_id": F.lit(None).cast("bigint"), "cluster_size": F.lit(1), "similarity_to_rep": F.lit(None).cast("double"), "raw_data": F.lit(None).cast("string"),
        "created_at": F.col("first_seen_at"), "updated_at": F.col("last_seen_at"),
    })
    if not vectors:
        return out.drop("text_key")
    first = out.groupBy("text_key").agg(F.min("id").alias("vec_id"))
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return out.join(first.join(emb, "vec_id").drop("vec_id"), "text_key", "left").drop("text_key")


def stories(df: DataFrame) -> DataFrame:
    """Articles with made-up stories: eight ids in a row, the last of them stands for it."""
    rep = (F.floor(F.col("id") / 8) * 8 + 7).cast("bigint")
    some = F.floor(F.col("id") / 8) % 3 != 0
    return df.withColumn("cluster_rep_id", F.when(some, rep)).withColumn("cluster_size", F.when(some, 8).otherwise(1)).withColumn("similarity_to_rep", F.when(some & (F.col("id") % 5 != 0), 1.0 - (F.col("id") % 8) / 100.0))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") * 31 % n).alias("news_id"),
        names[F.col("event_type")].alias("action"), F.col("ts").cast("timestamp").alias("created_at"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"), "html")


_TAGS = lambda names, count, jump: f"list_transform(range({count}), lambda k: [{_list(names)}][((doc_id + {jump} * k) % {len(names)} + 1)::INT])"
_D = "TIMESTAMP '2024-01-01 00:00:00'"
#: The same views for DuckDB, to stand before a query.
SQL = f"""
WITH articles AS (SELECT *, CASE WHEN sentiment >= 0.2 THEN 'positive' WHEN sentiment <= -0.2 THEN 'negative' WHEN sentiment IS NOT NULL THEN 'neutral' END AS sentiment_label,
  CASE WHEN llm_sentiment >= 0.2 THEN 'positive' WHEN llm_sentiment <= -0.2 THEN 'negative' WHEN llm_sentiment IS NOT NULL THEN 'neutral' END AS llm_sentiment_label,
  coalesce(published_at, first_seen_at) AS effective_published
 FROM (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS summary, 'https://x.example/' || md5(text) AS url,
  lang AS language, source AS source_url, [{_list(SOURCE_TYPES)}][(doc_id % 5 + 1)::INT] AS source_type,
  {_D} + to_minutes((doc_id * 43) % 43200) AS first_seen_at, {_D} + to_minutes((doc_id * 43) % 43200 + doc_id % 97) AS last_seen_at,
  CASE WHEN doc_id % 11 <> 0 THEN {_D} + to_minutes((doc_id * 43) % 43200 - doc_id % 300) END AS published_at,
  CASE WHEN doc_id % 17 <> 0 THEN ((doc_id * 7919) % 2001 - 1000) / 1000.0::DOUBLE END AS sentiment,
  CASE WHEN doc_id % 3 <> 0 THEN ((doc_id * 104729) % 2001 - 1000) / 1000.0::DOUBLE END AS llm_sentiment,
  CASE WHEN doc_id % 4 <> 0 THEN {_TAGS(TICKERS, 'doc_id % 4', 5)} END AS tickers, CASE WHEN doc_id % 3 <> 0 THEN {_TAGS(SECTORS, 'doc_id % 3', 3)} END AS sectors,
  CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE string_split(text, chr(10))[-1] END AS ai_summary, text FROM documents)),
stories AS (SELECT * , CASE WHEN (id // 8) % 3 <> 0 THEN id // 8 * 8 + 7 END AS cluster_rep_id, CASE WHEN (id // 8) % 3 <> 0 THEN 8 ELSE 1 END AS cluster_size,
  CASE WHEN (id // 8) % 3 <> 0 AND id % 5 <> 0 THEN 1.0::DOUBLE - (id % 8) / 100.0::DOUBLE END AS similarity_to_rep FROM articles),
feedback AS (SELECT event_id AS id, user_id::VARCHAR AS user_id, event_id * 31 % (SELECT count(*) FROM documents) AS news_id,
  CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END AS action, ts AS created_at FROM events),
knobs AS (SELECT TIMESTAMP '{AS_OF}' AS as_of)
"""
