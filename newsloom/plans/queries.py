"""One query per operator over the given tables, and the same in DuckDB SQL where SQL can say it.

Times are returned as seconds since 1970 and scores rounded to six places, so that both engines' values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import payload as P
from newsloom.functions import score as S
from newsloom.functions import text as X
from newsloom.operators import affinity as A
from newsloom.operators import alerts as AL
from newsloom.operators import cluster as C
from newsloom.operators import dedup as D
from newsloom.operators import feed as FE
from newsloom.operators import filters as FI
from newsloom.operators import quality as Q
from newsloom.operators import scoring as SC
from newsloom.operators import search as SE
from newsloom.operators.components import component_sizes as sizes_of
from newsloom.operators.components import connected_components
from newsloom.plans import views as V
from newsloom.sources import records as R
from newsloom.streaming import streams as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
USER = "7"
LEXICON = (("the", ["and", "that"]), ("thea", ["erthe", "anthe"]), ("les", ["des"]), ("und", ["der", "die"]))
QUERY_TEXTS = "concat_ws(' ', w1, w2)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = V.SQL + sql
        return f

    return add


def secs(c: str, name: str | None = None):
    return F.unix_seconds(F.col(c).cast("timestamp")).alias(name or c)


def r6(c, name: str):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name)


def longs(df: DataFrame) -> DataFrame:
    """Integers as bigints."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


# ---- feeds -----------------------------------------------------------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM w) AS total,
 (SELECT count(*) FROM w WHERE len(list_filter(tickers, lambda x: x <> '')) > 0) AS with_tickers, (SELECT count(*) FROM w WHERE len(list_filter(sectors, lambda x: x <> '')) > 0) AS with_sectors,
 (SELECT count(*) FROM w WHERE ai_summary <> '') AS enriched, (SELECT count(*) FROM w WHERE sentiment_label = 'positive') AS positive,
 (SELECT count(*) FROM w WHERE sentiment_label = 'negative') AS negative, (SELECT count(*) FROM w WHERE sentiment_label = 'neutral') AS neutral,
 (SELECT coalesce(string_agg(name || ':' || n, ',' ORDER BY n DESC, name), '') FROM (SELECT upper(t) AS name, count(*) AS n FROM (SELECT unnest(tickers) AS t FROM w) WHERE t <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_tickers,
 (SELECT coalesce(string_agg(name || ':' || n, ',' ORDER BY n DESC, name), '') FROM (SELECT t AS name, count(*) AS n FROM (SELECT unnest(sectors) AS t FROM w) WHERE t <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_sectors
 FROM (SELECT 1)""".replace("FROM w", "FROM (SELECT a.* FROM articles a, knobs WHERE effective_published >= as_of - INTERVAL 720 HOUR)"))
def feed_summary(spark, d):
    out = FE.feed_summary(V.articles(spark, d), 720, 10, V.as_of())
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["name"], s["n"].cast("string"))), ",").alias(c)
    return out.select("total", "with_tickers", "with_sectors", "enriched", "positive", "negative", "neutral", text("top_tickers"), text("top_sectors"))


@query("SELECT count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (sentiment_label = 'neutral') AS neutral FROM articles")
def sentiment_distribution(spark, d):
    return FE.sentiment_distribution(V.articles(spark, d))


@query("SELECT upper(t) AS name, count(*) AS n FROM (SELECT unnest(tickers) AS t FROM articles) WHERE t <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_tickers(spark, d):
    return FE.top_tickers(V.articles(spark, d), 5)


@query("SELECT t AS name, count(*) AS n FROM (SELECT unnest(sectors) AS t FROM articles) WHERE t <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_sectors(spark, d):
    return FE.top_sectors(V.articles(spark, d), 5)


@query("""SELECT count(*) AS total, count(*) FILTER (len(tickers) > 0) AS with_tickers, count(*) FILTER (len(sectors) > 0) AS with_sectors, count(*) FILTER (ai_summary <> '') AS enriched FROM articles""")
def coverage_counts(spark, d):
    return FE.coverage_counts(V.articles(spark, d))


@query("SELECT count(*) AS total FROM articles WHERE language = 'en' AND source_type = 'rss'")
def filtered_count(spark, d):
    return FE.filtered_count(FI.apply_filters(V.articles(spark, d), FI.ArticleFilter(source_type="rss", language="en")))


_DEDUP = "(cluster_rep_id IS NULL OR cluster_rep_id = id) AND id NOT IN (SELECT news_id FROM feedback WHERE user_id = '7' AND action = 'dismiss')"
_FEED = "SELECT id, epoch(effective_published)::BIGINT AS published FROM stories WHERE " + _DEDUP + " ORDER BY {} LIMIT 20 OFFSET 20"


def _feed(spark, d, sort):
    rows = FE.feed(V.stories(V.articles(spark, d)), sort, 2, 20, feedback=V.feedback(spark, d), user=USER)
    return rows.select("id", secs("effective_published", "published"))


@query(_FEED.format("effective_published DESC, id DESC"))
def feed_latest(spark, d):
    return _feed(spark, d, "latest")


@query(_FEED.format("effective_published DESC, id DESC"))
def feed_unknown_sort(spark, d):
    return _feed(spark, d, "no such order")


@query(_FEED.format("cluster_size DESC, effective_published DESC, id DESC"))
def feed_cluster_size(spark, d):
    return _feed(spark, d, "cluster_size")


@query(_FEED.format("abs(coalesce(sentiment, 0)) DESC, effective_published DESC, id DESC"))
def feed_sentiment_strength(spark, d):
    return _feed(spark, d, "sentiment_strength")


_AFFINITY = """, acted AS (SELECT f.user_id, CASE f.action WHEN 'like' THEN 1.0::DOUBLE WHEN 'bookmark' THEN 0.5::DOUBLE WHEN 'dislike' THEN -1.0::DOUBLE WHEN 'dismiss' THEN -0.3::DOUBLE END AS weight, a.tickers, a.sectors
 FROM feedback f JOIN articles a ON a.id = f.news_id WHERE f.action IN ('like', 'bookmark', 'dislike', 'dismiss')),
tot AS (SELECT user_id, count(*) AS n FROM acted GROUP BY 1),
tagged AS (SELECT user_id, 'ticker' AS kind, upper(unnest(tickers)) AS tag, weight FROM acted UNION ALL SELECT user_id, 'sector', unnest(sectors), weight FROM acted),
affinity AS (SELECT user_id, kind, tag, sum(weight) / (any_value(n) + 5) AS score FROM tagged JOIN tot USING (user_id) WHERE tag <> '' GROUP BY 1, 2, 3) """
_BOOST = """, own AS (SELECT kind, tag, score FROM affinity WHERE user_id = '7'),
boosts AS (SELECT a.id, greatest(-0.5, least(0.5, 0.6 * coalesce((SELECT avg(coalesce(o.score, 0)) FROM (SELECT unnest(a.sectors) AS s) x LEFT JOIN own o ON o.kind = 'sector' AND o.tag = x.s), 0)
  + 0.4 * coalesce((SELECT avg(coalesce(o.score, 0)) FROM (SELECT unnest(a.tickers) AS t) x LEFT JOIN own o ON o.kind = 'ticker' AND o.tag = upper(x.t)), 0))) AS boost FROM articles a) """


@query(_AFFINITY + _BOOST + ", pool AS (SELECT id, effective_published FROM stories WHERE " + _DEDUP + """ ORDER BY effective_published DESC, id DESC LIMIT 300)
SELECT id, round((1 + boost) * pow(2.718281828, -greatest(epoch(as_of) - epoch(effective_published), 0) / (86400.0 * 7)), 6) AS rank_score FROM pool JOIN boosts USING (id), knobs
ORDER BY (1 + boost) * pow(2.718281828, -greatest(epoch(as_of) - epoch(effective_published), 0) / (86400.0 * 7)) DESC, effective_published DESC, id DESC LIMIT 20""")
def feed_personalized(spark, d):
    a, f = V.stories(V.articles(spark, d)), V.feedback(spark, d)
    rows = FE.feed(a, "personalized", 1, 20, A.user_affinity(f.where(F.col("user_id") == USER), a), USER, V.as_of(), feedback=f)
    return rows.select("id", r6("rank_score", "rank_score"))


@query("SELECT id, epoch(last_seen_at)::BIGINT AS last_seen_at FROM articles WHERE list_contains(tickers, 'TSLA') ORDER BY last_seen_at DESC, id DESC LIMIT 50")
def list_articles(spark, d):
    return FE.list_articles(V.articles(spark, d), FI.ArticleFilter(ticker="TSLA"), 1, 50).select("id", secs("last_seen_at"))


@query("SELECT id FROM articles WHERE id % 25 = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_6') ORDER BY last_seen_at DESC, id DESC LIMIT 20")
def articles_by_topic(spark, d):
    topics = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("slug"))
    return FE.articles_by_topic(V.articles(spark, d).withColumn("topic_id", F.col("id") % 25), topics, "NATION_6").select("id")


@query("SELECT id, similarity_to_rep FROM stories WHERE cluster_rep_id = 15")
def cluster_siblings(spark, d):
    return FE.cluster_siblings(V.stories(V.articles(spark, d)), 12).select("id", "similarity_to_rep")


@query("""SELECT a.id, f.id AS feedback_id, count(*) OVER () AS total FROM articles a JOIN feedback f ON f.news_id = a.id WHERE f.user_id = '7' AND f.action = 'like' ORDER BY f.created_at DESC, f.id DESC LIMIT 20""")
def articles_by_action(spark, d):
    return FE.articles_by_action(V.articles(spark, d), V.feedback(spark, d), USER, "like").select("id", "feedback_id", "total")


@query("""SELECT a.id, coalesce((SELECT string_agg(DISTINCT f.action, ',' ORDER BY f.action) FROM feedback f WHERE f.news_id = a.id AND f.user_id = '7'), '') AS actions FROM articles a""")
def feedback_states(spark, d):
    return FE.feedback_states(V.feedback(spark, d), V.articles(spark, d).select("id"), USER).select("id", F.array_join("actions", ",").alias("actions"))


@query("SELECT id FROM articles WHERE id NOT IN (SELECT news_id FROM feedback WHERE user_id = '7' AND action = 'dismiss')")
def exclude_dismissed(spark, d):
    return FE.exclude_dismissed(V.articles(spark, d), V.feedback(spark, d), USER).select("id")


@query("SELECT cluster_size::BIGINT AS size, count(*) AS clusters FROM (SELECT cluster_rep_id, max(cluster_size) AS cluster_size FROM stories WHERE cluster_rep_id IS NOT NULL GROUP BY 1) GROUP BY 1")
def cluster_size_distribution(spark, d):
    return longs(FE.cluster_size_distribution(V.stories(V.articles(spark, d))))


@query("SELECT count(*) AS clusters, max(s)::BIGINT AS largest, count(*) FILTER (s >= 50) AS over_50, count(*) FILTER (s >= 100) AS over_100 FROM (SELECT cluster_rep_id, max(cluster_size) AS s FROM stories WHERE cluster_rep_id IS NOT NULL GROUP BY 1)")
def cluster_size_report(spark, d):
    return longs(FE.cluster_size_report(V.stories(V.articles(spark, d))))


@query("SELECT source_url AS name, count(*) AS n FROM articles GROUP BY 1")
def source_counts(spark, d):
    return FE.status_counts(V.articles(spark, d), "source_url")


@query("""SELECT feed_url, count(*) AS entries, count(*) FILTER (published_at >= as_of - INTERVAL 48 HOUR) AS recent, round(avg(length(coalesce(summary, ''))), 6) AS mean_summary,
 count(*) FILTER (published_at >= as_of - INTERVAL 48 HOUR) >= 1 AND count(*) >= 3 AS ok,
 CASE WHEN count(*) FILTER (published_at >= as_of - INTERVAL 48 HOUR) >= 1 AND count(*) >= 3 THEN 'ok' WHEN count(*) < 3 THEN 'few_entries' ELSE 'stale' END AS reason
 FROM (SELECT source_url AS feed_url, published_at, summary, row_number() OVER (PARTITION BY source_url ORDER BY first_seen_at DESC, id) AS rn FROM articles), knobs WHERE rn <= 40 GROUP BY 1""")
def feed_health(spark, d):
    a = V.articles(spark, d)
    place = F.row_number().over(Window.partitionBy("source_url").orderBy(F.desc("first_seen_at"), "id"))
    return FE.feed_health(a.select(F.col("source_url").alias("feed_url"), "published_at", "summary", place.alias("position")), V.as_of())


# ---- filters ---------------------------------------------------------------------------------------------------------------


@query("SELECT id FROM articles WHERE language = 'en' AND source_type IN ('api', 'newsapi') AND sentiment_label = 'positive' AND list_contains(sectors, 'tech') AND effective_published >= TIMESTAMP '2024-01-05' AND effective_published < TIMESTAMP '2024-01-26'")
def apply_filters(spark, d):
    f = FI.ArticleFilter("api", "en", "positive", sector="tech", date_from="2024-01-05", date_to="2024-01-25")
    return FI.apply_filters(V.articles(spark, d), f).select("id")


@query("SELECT id FROM articles WHERE list_has_all(tickers, ['TSLA', 'AMD']) AND first_seen_at >= TIMESTAMP '2024-01-03'")
def search_filters(spark, d):
    return FI.search_filters(V.articles(spark, d), FI.SearchFilter(tickers=["TSLA", "AMD"], date_from="2024-01-03", date_to="not a date")).select("id")


@query("SELECT id FROM stories WHERE cluster_rep_id IS NULL OR cluster_rep_id = id")
def representatives_only(spark, d):
    return V.stories(V.articles(spark, d)).where(FI.representatives_only()).select("id")


@query("SELECT id FROM articles, knobs WHERE first_seen_at >= as_of - INTERVAL 36 HOUR")
def recent_window(spark, d):
    return FI.recent_window(V.articles(spark, d), "first_seen_at", 36, "hours", V.as_of()).select("id")


@query("SELECT id FROM articles WHERE sentiment IS NULL ORDER BY first_seen_at DESC, id DESC LIMIT 200")
def pending_sentiment(spark, d):
    return FI.pending_sentiment(V.articles(spark, d)).select("id")


@query("SELECT id FROM articles WHERE abs(sentiment) >= 0.05 AND language IN ('en', 'ko') AND ai_summary IS NULL ORDER BY first_seen_at DESC, id DESC LIMIT 100")
def enrichment_candidates(spark, d):
    return FI.enrichment_candidates(V.articles(spark, d), V.as_of()).select("id")


@query("SELECT id, 1 + (id IN (SELECT id FROM c))::BIGINT - 1 AS attempts FROM articles".replace("FROM c", "FROM (SELECT id FROM articles WHERE abs(sentiment) >= 0.05 AND language IN ('en', 'ko') AND ai_summary IS NULL ORDER BY first_seen_at DESC, id DESC LIMIT 100)"))
def claim_pending(spark, d):
    _, stamped = SC.claim_pending(V.articles(spark, d), V.as_of())
    return stamped.select("id", F.col("llm_enrich_attempts").cast("bigint").alias("attempts"))


@query("SELECT id FROM articles WHERE title = summary")
def thin_bodies(spark, d):
    return FI.thin_bodies(V.articles(spark, d)).select("id")


@query("SELECT id FROM articles WHERE length(summary) >= 100 AND source_url IN ('src1', 'src2')")
def requeue_candidates(spark, d):
    return FI.requeue_candidates(V.articles(spark, d), ["src1", "src2"]).select("id")


@query("SELECT id, title FROM articles WHERE id = 42")
def by_id(spark, d):
    return FI.by_id(V.articles(spark, d), 42).select("id", "title")


@query(r"""SELECT id, cleaned FROM (SELECT id, t, regexp_replace(regexp_replace(t, '^([\[\(][^\[\](),]+[\]\)]\s*)+', ''), '\s*[-–—]\s*[^\s\-–—]{1,10}\s*$', '') AS cleaned
 FROM (SELECT id, CASE WHEN id % 2 = 0 THEN '[' || source_url || '] ' || title ELSE title || ' - ' || language END AS t FROM articles)) WHERE cleaned IS DISTINCT FROM t""")
def changed_rows(spark, d):
    """Titles with a bracket tag before them or an attribution behind."""
    t = F.when(F.col("id") % 2 == 0, F.concat(F.lit("["), F.col("source_url"), F.lit("] "), F.col("title"))).otherwise(F.concat("title", F.lit(" - "), F.col("language")))
    return FI.changed_rows(V.articles(spark, d).select("id", t.alias("t")), "t", X.clean_title(F.col("t"))).select("id", "cleaned")


@query("SELECT CASE WHEN coalesce(nullif(language, ''), 'en') IN ('en', 'ko') THEN coalesce(nullif(language, ''), 'en') ELSE 'other' END AS route, count(*) AS n FROM articles GROUP BY 1")
def language_route(spark, d):
    return V.articles(spark, d).groupBy(FI.language_route(F.col("language")).alias("route")).agg(F.count("*").alias("n"))


_PARAMS = AL.AlertParams(lookback_min=60 * 24 * 20, watch=("TSLA", "nvda"))
_TRIG = """, trig AS (SELECT id, first_seen_at, cluster_rep_id, (CASE WHEN llm_sentiment IS NULL THEN coalesce(abs(sentiment) >= 0.7, false) ELSE coalesce(abs(sentiment) >= 0.7 AND abs(llm_sentiment) >= 0.7 AND (sentiment >= 0) = (llm_sentiment >= 0), false) OR abs(llm_sentiment) >= 0.8 END)
  AND cluster_size >= CASE WHEN language = 'en' THEN 2 ELSE 3 END AND cluster_size < 50 AND len(coalesce(sectors, [])) > 0 AS strong,
  coalesce(list_has_any(list_transform(tickers, lambda x: upper(x)), ['TSLA', 'NVDA']) AND abs(sentiment) >= 0.3, false) AS watch FROM stories) """


def _with_payload(spark, d):
    """Articles with the payload of the event of their number: a failed event is breaking news."""
    e = spark.read.parquet(f"{d}/events.parquet")
    inner = F.struct((F.col("event_type") == "error").alias("breaking"), "value", F.col("user_id").cast("string").alias("username"), "props")
    raw = e.select(F.col("event_id").alias("id"), F.to_json(F.struct(inner.alias("x"))).alias("raw_data"))
    return V.articles(spark, d).drop("raw_data").join(raw, "id", "left")


@query("SELECT a.id FROM articles a JOIN events e ON e.event_id = a.id WHERE e.event_type = 'error'")
def breaking_posts(spark, d):
    return FI.breaking_posts(_with_payload(spark, d)).select("id")


@query("SELECT a.id FROM articles a JOIN events e ON e.event_id = a.id WHERE e.event_type = 'error'")
def breaking_posts_of_variants(spark, d):
    return FI.breaking_posts(R.raw_to_variant(_with_payload(spark, d), "raw_data")).select("id")


@query("SELECT a.id, round(e.value, 4) AS value, e.user_id::VARCHAR AS username, regexp_extract(e.props, '[0-9]+')::BIGINT AS k FROM articles a LEFT JOIN events e ON e.event_id = a.id")
def raw_to_variant(spark, d):
    rows = R.raw_to_variant(_with_payload(spark, d), "raw_data")
    rows = R.raw_to_variant(rows.withColumn("props", P.payload_field(rows, "raw_data", "$.x.props")), "props")
    field = lambda c, path, kind: P.payload_field(rows, c, path, kind)
    return rows.select("id", F.round(field("raw_data", "$.x.value", "double"), 4).alias("value"), field("raw_data", "$.x.username", "string").alias("username"), field("props", "$.k", "long").alias("k"))


@query(_TRIG + """, hot AS (SELECT t.*, coalesce(e.event_type = 'error', false) AS breaking FROM trig t LEFT JOIN events e ON e.event_id = t.id)
 SELECT id, concat_ws(',', CASE WHEN breaking THEN 'breaking' END, CASE WHEN strong THEN 'strong_sentiment' END, CASE WHEN watch THEN 'ticker_watch' END) AS reasons FROM hot""")
def evaluate_triggers_of_variants(spark, d):
    return AL.evaluate_triggers(V.stories(R.raw_to_variant(_with_payload(spark, d), "raw_data")), _PARAMS).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT id, published_at::VARCHAR IS NULL AS was_missing FROM articles WHERE first_seen_at IS DISTINCT FROM published_at")
def null_safe_inequality(spark, d):
    return V.articles(spark, d).where(~F.col("first_seen_at").eqNullSafe(F.col("published_at"))).select("id", F.col("published_at").isNull().alias("was_missing"))


@query("SELECT id, title, url, language FROM articles")
def article_view(spark, d):
    return R.article_view(V.articles(spark, d)).select("id", "title", "url", "language")


# ---- duplicates and state --------------------------------------------------------------------------------------------------


@query("SELECT min(id) AS id, url FROM articles GROUP BY url")
def distinct_urls(spark, d):
    return D.distinct_urls(V.articles(spark, d), [F.col("id")]).select("id", "url")


def _halves(spark, d):
    """Articles with an even id as what is there, once a URL, and all with an odd one as a batch."""
    a = V.articles(spark, d)
    return D.distinct_urls(a.where("id % 2 = 0"), [F.col("id")]), a.where("id % 2 = 1").withColumn("position", F.col("id"))


_HALVES = ", ex AS (SELECT url, min(id) AS id FROM articles WHERE id % 2 = 0 GROUP BY url), ba AS (SELECT url, id FROM articles WHERE id % 2 = 1) "


@query(_HALVES + "SELECT id, CASE WHEN url IN (SELECT url FROM ex) THEN 'existing' ELSE 'new' END AS side FROM ba")
def split_new_existing(spark, d):
    ex, ba = _halves(spark, d)
    new, old = D.split_new_existing(ba, ex)
    return new.select("id", F.lit("new").alias("side")).unionByName(old.select("id", F.lit("existing").alias("side")))


@query(_HALVES + """SELECT url, 1 + (url IN (SELECT url FROM ba))::BIGINT AS hit_count, true AS known FROM ex UNION ALL SELECT url, 1, false FROM (SELECT DISTINCT url FROM ba WHERE url NOT IN (SELECT url FROM ex))""")
def upsert_articles(spark, d):
    ex, ba = _halves(spark, d)
    out, _ = D.upsert_articles(ex, ba, V.as_of())
    top = ex.agg(F.max("id").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("url", F.col("hit_count").cast("bigint").alias("hit_count"), (F.col("id") <= F.col("top")).alias("known"))


@query(_HALVES + "SELECT count(DISTINCT url) FILTER (url NOT IN (SELECT url FROM ex)) AS inserted, count(*) FILTER (url IN (SELECT url FROM ex)) AS updated FROM ba")
def upsert_counts(spark, d):
    return D.upsert_articles(*_halves(spark, d), V.as_of())[1]


@query("SELECT url, count(DISTINCT id % 7) AS hit_count, arg_min(id, (id % 7) * 1000000000 + id) AS id FROM articles GROUP BY url")
def batch_hits(spark, d):
    return D.batch_hits(V.articles(spark, d).withColumn("run_id", F.col("id") % 7)).select("url", "hit_count", "id")


@query("SELECT user_id, news_id, action, min(id) AS id FROM feedback GROUP BY ALL")
def dedupe_feedback(spark, d):
    return D.dedupe_feedback(V.feedback(spark, d))


_OPS = ", ops AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'delete' ELSE 'add' END AS op, CASE WHEN action IN ('like', 'dislike') THEN 'opinion' ELSE action END AS slot FROM feedback WHERE action <> 'view') "


@query(_OPS + """, held AS (SELECT *, last_value(CASE WHEN op = 'add' THEN action END IGNORE NULLS) OVER (PARTITION BY user_id, news_id, slot ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS added FROM ops),
fin AS (SELECT user_id, news_id, slot, arg_max(op, id) AS op, arg_max(action, id) AS action FROM held WHERE NOT (op = 'delete' AND action IS DISTINCT FROM added) GROUP BY 1, 2, 3) SELECT user_id, news_id, action FROM fin WHERE op = 'add'""")
def current_feedback(spark, d):
    f = V.feedback(spark, d).withColumn("op", F.when(F.col("id") % 4 == 0, "delete").otherwise("add"))
    return D.current_feedback(f)


def _posts(spark, d):
    return V.articles(spark, d).select("id", F.concat(F.lit("User"), F.col("source_url")).alias("username"), F.col("first_seen_at").alias("created_at"), "url")


def _since(posts):
    return posts.where("id % 10 = 0").groupBy("username").agg((F.max("id") - 300).alias("since_id")).where("since_id % 3 <> 0")


_SINCE = ", since AS (SELECT lower('user' || source_url) AS username, max(id) - 300 AS since_id FROM articles WHERE id % 10 = 0 GROUP BY 1 HAVING (max(id) - 300) % 3 <> 0) "


@query(_SINCE + "SELECT a.id FROM articles a LEFT JOIN since s ON s.username = lower('user' || a.source_url) WHERE s.since_id IS NULL OR a.id > s.since_id")
def newer_than_since_id(spark, d):
    p = _posts(spark, d)
    return D.newer_than_since_id(p, _since(p)).select("id")


@query(_SINCE + "SELECT lower('user' || source_url) AS username, max(id) AS since_id FROM articles GROUP BY 1")
def latest_post_id(spark, d):
    p = _posts(spark, d)
    return D.latest_post_id(p, _since(p))


@query("SELECT id FROM articles a WHERE id % 3 <> 1 AND (id % 2 = 0 OR url NOT IN (SELECT url FROM articles WHERE id % 3 = 1))")
def drop_linked_duplicates(spark, d):
    a = V.articles(spark, d)
    posts = a.where("id % 3 <> 1").select("id", F.when(F.col("id") % 2 == 1, F.col("url")).alias("linked_url"))
    return D.drop_linked_duplicates(posts, a.where("id % 3 = 1")).select("id")


@query("SELECT strftime(first_seen_at, '%Y-%m') AS month, count(*) AS posts, round(count(*) * 0.005, 6) AS spend, round(count(*) * 0.005, 6) >= 4 AS over_budget FROM articles GROUP BY 1")
def monthly_spend(spark, d):
    return D.monthly_spend(_posts(spark, d), 0.005, 4.0)


@query("SELECT count(*) FILTER (news_id IN (SELECT id FROM articles WHERE id % 3 <> 0)) AS known, count(*) FILTER (news_id NOT IN (SELECT id FROM articles WHERE id % 3 <> 0)) AS rejected FROM feedback")
def check_references(spark, d):
    good, bad = D.check_references(V.feedback(spark, d), V.articles(spark, d).where("id % 3 <> 0"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(good, "known").crossJoin(F.broadcast(count(bad, "rejected")))


@query("""SELECT id, CASE WHEN id % 6 = 0 THEN 'S' || id ELSE ai_summary END AS ai_summary, CASE WHEN id % 2 = 0 AND tickers IS NULL THEN 'NEW' ELSE array_to_string(tickers, ',') END AS tickers,
 CASE WHEN id % 2 = 0 THEN 0.0::DOUBLE ELSE llm_sentiment END AS llm_sentiment FROM articles""")
def apply_enrichment(spark, d):
    a = V.articles(spark, d)
    none = F.array().cast("array<string>")
    res = a.where("id % 2 = 0").select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit("S"), F.col("id").cast("string"))).otherwise("").alias("ai_summary"), F.lit("").alias("translated_title"), F.lit("").alias("translated_summary"), F.array(F.lit("NEW")).alias("tickers"), none.alias("sectors"), F.lit(0.0).alias("sentiment"), F.lit("neutral").alias("sentiment_label"))
    return D.apply_enrichment(a, res).select("id", "ai_summary", F.array_join("tickers", ",").alias("tickers"), "llm_sentiment")


@query("SELECT id, CASE WHEN length(coalesce(title, '')) < 50 AND length(summary) >= 50 THEN summary ELSE title END AS summary FROM articles a")
def merge_body(spark, d):
    a = V.articles(spark, d)
    thin = a.select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("title").alias("summary"))
    bodies = a.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("summary").alias("body"))
    return D.merge_body(thin, bodies).select("id", "summary")


# ---- affinity --------------------------------------------------------------------------------------------------------------


@query(_AFFINITY + "SELECT user_id, kind, tag, round(score, 9) AS score FROM affinity")
def user_affinity(spark, d):
    return A.user_affinity(V.feedback(spark, d), V.articles(spark, d)).select("user_id", "kind", "tag", F.round("score", 9).alias("score"))


@query(_AFFINITY + """SELECT user_id, kind, tag FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY round(score, 9) DESC, tag) AS up, row_number() OVER (PARTITION BY user_id, kind ORDER BY round(score, 9), tag) AS down FROM affinity) WHERE up <= 2 OR down <= 2""")
def affinity_snapshot(spark, d):
    a = A.user_affinity(V.feedback(spark, d), V.articles(spark, d)).withColumn("score", F.round("score", 9))
    return A.affinity_snapshot(a, 2).select("user_id", "kind", "tag")


@query(_AFFINITY + _BOOST + "SELECT id, round(boost, 6) AS boost FROM boosts")
def personal_boost(spark, d):
    a = V.articles(spark, d)
    return A.with_boost(a, A.user_affinity(V.feedback(spark, d), a), USER).select("id", r6("boost", "boost"))


#: Title tokens, tokens of a text and their pairs in SQL.
_TT = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace({}, '^([\[\(][^\[\](),]+[\]\)]\s*)+', ''), '\s*[-–—]\s*[^\s\-–—]{{1,10}}\s*$', ''), '[\s,.…·!?;:''"\[\]\(\)\-—–/]+'), lambda x: length(x) >= 2)"""
_SPLIT = r"list_transform(list_filter(regexp_split_to_array({}, '[\s,.…·!?;:''\"\[\]\(\)\-—–/]+'), lambda x: length(x) >= 2), lambda x: lower(x))"
_PAIRS = "CASE WHEN len({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || chr(1) || {0}[i + 1])) END"


# ---- stories ---------------------------------------------------------------------------------------------------------------

_KNN = """, e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), pairs AS (SELECT a.id AS a_id, b.id AS b_id, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS sim FROM e a JOIN e b ON b.id > a.id),
edges AS (SELECT * FROM pairs WHERE sim >= 0.35 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) <= 30) """


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


@query(_KNN + "SELECT a_id, b_id, round(sim, 6) AS sim FROM edges")
def knn_edges(spark, d):
    return C.knn_edges(_vectors(spark, d), 0.35).select("a_id", "b_id", r6("sim", "sim"))


@query()
def knn_edges_indexed(spark, d):
    return C.knn_edges_indexed(_vectors(spark, d), 0.35, block_rows=200).select("a_id", "b_id", r6("sim", "sim"))


@query(_KNN + "SELECT a.id AS a_id, b.id AS b_id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) AS sim FROM e a JOIN e b ON b.id = a.id + 1")
def pair_similarity(spark, d):
    v = _vectors(spark, d)
    return C.pair_similarity(v.select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id")), v).select("a_id", "b_id", r6("sim", "sim"))


@query(_KNN.replace("WITH", "WITH") + """, RECURSIVE_reach AS (SELECT 1) SELECT id, component FROM (WITH RECURSIVE g AS (SELECT a_id AS u, b_id AS v FROM edges UNION ALL SELECT b_id, a_id FROM edges), r(id, c) AS (SELECT id, id FROM e UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.id WHERE r.c < g.v) SELECT id, min(c) AS component FROM r GROUP BY id)""".replace(", RECURSIVE_reach AS (SELECT 1) ", " "))
def connected_components_of_vectors(spark, d):
    v = _vectors(spark, d)
    e = C.knn_edges(v, 0.35)
    return connected_components(v, e.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))


@query(_KNN + """SELECT component, count(*) AS members FROM (WITH RECURSIVE g AS (SELECT a_id AS u, b_id AS v FROM edges UNION ALL SELECT b_id, a_id FROM edges), r(id, c) AS (SELECT id, id FROM e UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.id WHERE r.c < g.v) SELECT id, min(c) AS component FROM r GROUP BY id) GROUP BY 1""")
def component_sizes(spark, d):
    return sizes_of(connected_components_of_vectors(spark, d))


def _story_articles(spark, d):
    return V.articles(spark, d, vectors=True).where("embedding is not null")


_STORY = """, emb AS (SELECT t.id, t.last_seen_at, t.title, t.summary, t.ai_summary, t.language, t.tickers, x.embedding::DOUBLE[] AS v FROM articles t JOIN (SELECT text, min(id) AS vid FROM articles GROUP BY text) m ON m.text = t.text JOIN embeddings x ON x.vec_id = m.vid),
spairs AS (SELECT a.id AS a_id, b.id AS b_id, a.tickers AS tka, b.tickers AS tkb, list_inner_product(a.v, b.v) AS sim FROM emb a JOIN emb b ON b.id > a.id AND list_inner_product(a.v, b.v) >= 0.8),
verdicts AS (SELECT a_id, b_id, CASE WHEN len(tka) > 0 AND len(tkb) > 0 AND NOT list_has_any(list_transform(tka, lambda x: upper(x)), list_transform(tkb, lambda x: upper(x))) THEN 'ticker_conflict' END AS reason FROM spairs QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) <= 30) """
_LOOSE = C.ClusterParams(window_days=31, min_overlap=0, min_ratio=0.0, min_body_jaccard=0.0)


@query(_STORY + "SELECT a_id, b_id, reason FROM verdicts")
def edge_verdicts(spark, d):
    a = _story_articles(spark, d)
    return C.edge_verdicts(C.knn_edges(a, 0.8 - 1e-9), a, _LOOSE).select("a_id", "b_id", "reason")


@query(_STORY + """, parts AS (SELECT id, coalesce(language, '') AS lang, list_distinct(list_transform(TT, lambda x: lower(x))) AS tt, PAIRS AS sh FROM (SELECT id, language, title, SPLIT AS t FROM articles)),
checked AS (SELECT p.*, a.lang = b.lang AS same, len(list_intersect(a.tt, b.tt)) AS shared, greatest(least(len(a.tt), len(b.tt)), 1) AS smaller, a.sh AS ash, b.sh AS bsh FROM
  (SELECT * FROM spairs QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) <= 30) p JOIN parts a ON a.id = a_id JOIN parts b ON b.id = b_id)
SELECT a_id, b_id, CASE WHEN len(tka) > 0 AND len(tkb) > 0 AND NOT list_has_any(list_transform(tka, lambda x: upper(x)), list_transform(tkb, lambda x: upper(x))) THEN 'ticker_conflict'
  WHEN same AND sim < 0.85 THEN 'cosine_below_same_lang' WHEN same AND shared < 2 THEN 'overlap_count' WHEN same AND shared / smaller < 0.3 THEN 'overlap_ratio'
  WHEN same AND len(ash) > 0 AND len(bsh) > 0 AND len(list_intersect(ash, bsh)) / len(list_distinct(list_concat(ash, bsh))) < 0.15 THEN 'body_jaccard' END AS reason FROM checked""".replace("TT", _TT.format("title")).replace("PAIRS", _PAIRS.format("t")).replace("SPLIT", _SPLIT.format("trim(coalesce(nullif(summary, ''), ai_summary, ''), E' \\t\\n')")))
def edge_verdicts_default(spark, d):
    """All five tests at the operator's own limits."""
    a = _story_articles(spark, d)
    return C.edge_verdicts(C.knn_edges(a, 0.8 - 1e-9), a).select("a_id", "b_id", "reason")


@query(_STORY + "SELECT reason, count(*) AS n FROM verdicts WHERE reason IS NOT NULL GROUP BY 1")
def edge_reject_counts(spark, d):
    a = _story_articles(spark, d)
    return C.edge_reject_counts(C.edge_verdicts(C.knn_edges(a, 0.8 - 1e-9), a, _LOOSE))


_ASSIGN = _STORY + """, comp AS (WITH RECURSIVE g AS (SELECT a_id AS u, b_id AS v FROM verdicts WHERE reason IS NULL UNION ALL SELECT b_id, a_id FROM verdicts WHERE reason IS NULL), r(id, c) AS (SELECT id, id FROM emb UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.id WHERE r.c < g.v) SELECT id, min(c) AS c FROM r GROUP BY id),
story AS (SELECT c, count(*) AS size, arg_max(comp.id, epoch(last_seen_at) * 1000000 + comp.id) AS rep FROM comp JOIN emb USING (id) GROUP BY c),
assigned AS (SELECT comp.id, CASE WHEN size > 1 THEN rep END AS cluster_rep_id, size AS cluster_size, CASE WHEN size > 1 THEN CASE WHEN comp.id = rep THEN 1.0::DOUBLE ELSE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) END END AS sim FROM comp JOIN story USING (c) JOIN emb a ON a.id = comp.id JOIN emb b ON b.id = rep) """


@query(_ASSIGN + "SELECT id, cluster_rep_id, cluster_size, round(sim, 6) AS similarity_to_rep FROM assigned")
def cluster_articles(spark, d):
    out = C.cluster_articles(_story_articles(spark, d), V.as_of(), _LOOSE)
    return longs(out.select("id", "cluster_rep_id", "cluster_size", r6("similarity_to_rep", "similarity_to_rep")))


@query(_ASSIGN + "SELECT articles.id, assigned.cluster_rep_id, coalesce(assigned.cluster_size, 1) AS cluster_size FROM articles LEFT JOIN assigned USING (id)")
def apply_assignments(spark, d):
    a = V.articles(spark, d, vectors=True)
    return longs(C.apply_assignments(a, C.cluster_articles(a, V.as_of(), _LOOSE)).select("id", "cluster_rep_id", "cluster_size"))


@query(_ASSIGN + "SELECT (SELECT count(*) FROM assigned) AS considered, (SELECT count(*) FROM assigned WHERE cluster_size > 1) AS clustered, (SELECT max(cluster_size) FROM assigned) AS largest, (SELECT count(DISTINCT cluster_rep_id) FROM assigned) AS stories, (SELECT count(*) FROM verdicts) AS edges, (SELECT count(*) FROM verdicts WHERE reason IS NULL) AS kept")
def clustering_stats(spark, d):
    a = _story_articles(spark, d)
    return C.clustering_stats(C.edge_verdicts(C.knn_edges(a, 0.8 - 1e-9), a, _LOOSE), C.cluster_articles(a, V.as_of(), _LOOSE))


@query()
def cluster_param_sweep(spark, d):
    sweep = {"default": {}, "loose": {"min_overlap": 0, "min_ratio": 0.0, "min_body_jaccard": 0.0}, "strict": {"min_body_jaccard": 0.5}}
    return longs(C.cluster_param_sweep(_story_articles(spark, d), sweep, V.as_of(), C.ClusterParams(window_days=31)))


def _cases(spark, d):
    """Document pairs as labelled cases: copies of a text are related, neighbours aren't."""
    v = _vectors(spark, d)
    pairs = v.select(F.col("id").alias("a_id"), F.explode(F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2)).alias("b_id"))
    s = C.pair_similarity(pairs, v)
    return s.select((F.col("a_id") % 3).alias("model"), (F.col("a_id") % 50).alias("case"), F.lit("en").alias("query_lang"), F.when(F.col("b_id") % 2 == 0, "ko").otherwise("en").alias("doc_lang"), (F.col("a_id") == F.col("b_id")).alias("related"), F.col("sim").alias("cosine"))


_CASES = _KNN + """, cases AS (SELECT a.id % 3 AS model, a.id % 50 AS c, b.id % 2 = 0 AS cross_lang, a.id = b.id AS related, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS cosine FROM e a JOIN e b ON b.id IN (a.id, a.id + 1, a.id + 2)),
gaps AS (SELECT model, c, avg(cosine) FILTER (related) - avg(cosine) FILTER (NOT related) AS gap FROM cases GROUP BY 1, 2),
evals AS (SELECT model, round(avg(gap), 6) AS mean_gap, round(min(gap), 6) AS min_gap, (SELECT round(avg(cosine), 6) FROM cases x WHERE x.model = gaps.model AND related AND cross_lang) AS cross_mean FROM gaps GROUP BY 1) """


@query(_CASES + "SELECT * FROM evals")
def similarity_eval(spark, d):
    return C.similarity_eval(_cases(spark, d)).select("model", "mean_gap", "min_gap", "cross_mean")


@query(_CASES + "SELECT model, round(mean_gap - lag(mean_gap) OVER (ORDER BY model), 5) AS gap_delta, CASE WHEN lag(mean_gap) OVER (ORDER BY model) IS NULL THEN 'base' ELSE ['none', 'one', 'both'][1 + (mean_gap - lag(mean_gap) OVER (ORDER BY model) > 0.05)::INT + (cross_mean - lag(cross_mean) OVER (ORDER BY model) > 0.05)::INT] END AS verdict FROM evals")
def model_deltas(spark, d):
    out = C.model_deltas(C.similarity_eval(_cases(spark, d)).withColumn("position", F.col("model")))
    return out.select("model", F.round("gap_delta", 5).alias("gap_delta"), "verdict")


# ---- search ----------------------------------------------------------------------------------------------------------------


def _queries(spark, d):
    """Each benchmark item asks for its first two words."""
    words = F.split(F.lower(F.regexp_replace("text", r"(?U)[^\p{Alnum}]+", " ")), " ")
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), words.alias("w"))
    v = _vectors(spark, d).withColumnRenamed("id", "query_id")
    return b.join(v, "query_id", "left").select("query_id", F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("text"), F.get("w", F.lit(0)).alias("one"), F.col("embedding").alias("vector"))


def _lexicon(spark):
    return spark.createDataFrame(list(LEXICON), "token string, synonyms array<string>")


_LEX = ", lex(token, synonyms) AS (VALUES " + ", ".join(f"('{t}', [{V._list(s)}])" for t, s in LEXICON) + ") "
_QW = r", qw AS (SELECT item_id AS query_id, string_split(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark) "
_GROUPS = _LEX + _QW + ", groups AS (SELECT query_id, g.group_no, g.token, list_distinct(list_prepend(g.token, coalesce(synonyms, []))) AS terms FROM (SELECT query_id, unnest([{'group_no': 0, 'token': w[1]}, {'group_no': 1, 'token': w[2]}]) AS g FROM qw) LEFT JOIN lex ON lex.token = g.token) "


@query(_GROUPS + "SELECT query_id, group_no::BIGINT AS group_no, token, array_to_string(list_sort(terms), ',') AS terms, len(terms) > 1 AS expanded FROM groups")
def expand_queries(spark, d):
    out = SE.expand_queries(_queries(spark, d), _lexicon(spark))
    return longs(out.select("query_id", "group_no", "token", F.array_join(F.sort_array("terms"), ",").alias("terms"), "expanded"))


_TOK = r"list_filter(string_split(lower(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_POST = ", toks AS (SELECT id, " + ", ".join(f"{_TOK.format(c)} AS {k}" for c, k in (("title", "ta"), ("summary", "tb"), ("ai_summary", "tc"))) + """ FROM articles),
post AS (SELECT id, unnest(list_concat(list_concat(ta, tb), tc)) AS term, generate_subscripts(list_concat(list_concat(ta, tb), tc), 1) AS pos, len(ta) AS na, len(tb) AS nb, len(ta) + len(tb) + len(tc) AS n_pos FROM toks) """


@query(_POST + "SELECT term, count(*) AS n, count(DISTINCT id) AS docs, sum(pos)::BIGINT AS places, count(*) FILTER (pos <= na) AS in_title FROM post GROUP BY 1")
def search_postings(spark, d):
    return _term_counts(V.articles(spark, d))


def _term_counts(a):
    p = SE.search_postings(a)
    return p.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("id").alias("docs"), F.sum("pos").cast("bigint").alias("places"), F.count_if(F.col("weight") == "A").alias("in_title"))


_FTS = _GROUPS + _POST + """, terms AS (SELECT query_id, group_no, unnest(terms) AS term FROM groups), fts AS (SELECT query_id, id FROM terms JOIN post USING (term) GROUP BY 1, 2 HAVING count(DISTINCT group_no) = 2) """


@query(_FTS + "SELECT query_id, id FROM fts")
def fts_candidates(spark, d):
    return _hits(spark, d).select("query_id", "id").distinct()


def _hits(spark, d, one=False):
    q = _queries(spark, d)
    q = q.withColumn("text", F.col("one")) if one else q
    return SE.fts_candidates(SE.expand_queries(q, _lexicon(spark)), SE.search_postings(V.articles(spark, d)))


_ONE = _LEX + _QW + _POST + """, oterms AS (SELECT query_id, unnest(list_distinct(list_prepend(w[1], coalesce(synonyms, [])))) AS term FROM qw LEFT JOIN lex ON lex.token = w[1]),
ranks AS (SELECT query_id, id, sum(CASE WHEN pos <= na THEN 1.0::DOUBLE WHEN pos <= na + nb THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END) / (1 + ln(any_value(n_pos))) AS fts_raw FROM oterms JOIN post USING (term) GROUP BY 1, 2) """


@query(_ONE + "SELECT query_id, id, round(fts_raw, 6) AS fts_raw FROM ranks")
def single_group_rank(spark, d):
    return SE.single_group_rank(_hits(spark, d, one=True)).select("query_id", "id", r6("fts_raw", "fts_raw"))


@query()
def cover_density_rank(spark, d):
    hits = SE.fts_candidates(SE.expand_queries(_queries(spark, d), _lexicon(spark)), SE.search_postings(V.articles(spark, d)))
    return SE.cover_density_rank(hits).select("query_id", "id", r6("fts_raw", "fts_raw"))


def _search(spark, d, **more):
    a = V.articles(spark, d, vectors=True)
    q = _queries(spark, d).withColumn("text", F.col("one"))
    return SE.hybrid_search(a, SE.search_postings(V.articles(spark, d)), q, _lexicon(spark), V.as_of(), filters=FI.SearchFilter(language="en"), size=10, **more)


_SEARCH = _ONE + """, vec AS (SELECT t.id, x.embedding::DOUBLE[] AS v FROM articles t JOIN (SELECT text, min(id) AS vid FROM articles GROUP BY text) m ON m.text = t.text JOIN embeddings x ON x.vec_id = m.vid),
qv AS (SELECT query_id, x.embedding::DOUBLE[] AS q FROM qw JOIN embeddings x ON x.vec_id = query_id),
coss AS (SELECT query_id, id, list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)) AS cos FROM vec, qv),
cand AS (SELECT query_id, id FROM ranks UNION SELECT query_id, id FROM coss WHERE cos >= 0.5),
sc AS (SELECT query_id, a.id, coalesce(r.fts_raw, 0) AS raw, greatest(coalesce(c.cos, 0), 0) AS cos_score, exp(-(epoch(as_of) - epoch(a.last_seen_at)) / (86400.0 * 7)) AS recency
 FROM cand JOIN articles a USING (id) LEFT JOIN ranks r USING (query_id, id) LEFT JOIN coss c USING (query_id, id), knobs WHERE a.language = 'en'),
fin AS (SELECT *, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS fts_score, count(*) OVER (PARTITION BY query_id) AS total FROM sc),
page AS (SELECT *, 0.6 * fts_score + 0.3 * cos_score + 0.1 * recency AS final_score FROM fin QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.6 * fts_score + 0.3 * cos_score + 0.1 * recency DESC, id DESC) <= 10) """


@query(_SEARCH + "SELECT query_id, id, round(fts_score, 6) AS fts_score, round(cos_score, 6) AS cos_score, round(final_score, 6) AS final_score, total FROM page")
def hybrid_search(spark, d):
    return _page(_search(spark, d))


@query()
def hybrid_search_words(spark, d):
    """Two words an item, so that ranks need all groups."""
    a, q = V.articles(spark, d, vectors=True), _queries(spark, d)
    return _page(SE.hybrid_search(a, SE.search_postings(V.articles(spark, d)), q, _lexicon(spark), V.as_of(), size=10))


@query(_SEARCH + "SELECT query_id, page.id, title, url FROM page JOIN articles USING (id)")
def with_articles(spark, d):
    return SE.with_articles(_search(spark, d), V.articles(spark, d)).select("query_id", "id", "title", "url")


def _page(found):
    return found.select("query_id", "id", r6("fts_score", "fts_score"), r6("cos_score", "cos_score"), r6("final_score", "final_score"), "total")


@query(_SEARCH + """SELECT query_id, round(max(final_score), 6) AS top_score, round(avg(final_score), 6) AS mean_score, count(*) FILTER (fts_score <= 0) AS zero_fts, bool_and(fts_score <= 0) FILTER (place <= 3) AS top3_zero_fts
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id DESC) AS place FROM page) GROUP BY 1""")
def page_score_stats(spark, d):
    return FE.page_score_stats(_search(spark, d), "query_id").select("query_id", r6("top_score", "top_score"), "mean_score", "zero_fts", "top3_zero_fts")


# ---- alerts ----------------------------------------------------------------------------------------------------------------



def _ledger(spark, d):
    """Some articles were alerted before, some stories of late, and some alerts went out this hour."""
    s = V.stories(V.articles(spark, d))
    mark = lambda kind, key, cond, at: s.where(cond).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.lit(at).cast("timestamp").alias("marked_at"))
    return mark("article", "id", "id % 13 = 0", "2024-01-20 00:00:00").unionByName(mark("cluster", "cluster_rep_id", "cluster_rep_id % 5 = 0", "2024-01-30 12:00:00")).unionByName(mark("sent", "id", "id < 5", V.AS_OF))


@query(_TRIG + "SELECT id, concat_ws(',', CASE WHEN strong THEN 'strong_sentiment' END, CASE WHEN watch THEN 'ticker_watch' END) AS reasons, strong OR watch AS should_alert FROM trig")
def evaluate_triggers(spark, d):
    return AL.evaluate_triggers(V.stories(V.articles(spark, d)), _PARAMS).select("id", F.array_join("reasons", ",").alias("reasons"), "should_alert")


_DISPATCH = _TRIG + """, due AS (SELECT t.* FROM trig t, knobs WHERE (strong OR watch) AND first_seen_at >= as_of - INTERVAL 20 DAY),
st AS (SELECT *, id % 13 = 0 AS old, coalesce(cluster_rep_id % 5 = 0, false) AS live, coalesce('c' || cluster_rep_id, 'a' || id) AS story FROM due),
lead AS (SELECT id AS lead_id, story FROM (SELECT * FROM st WHERE NOT old AND NOT live QUALIFY row_number() OVER (PARTITION BY story ORDER BY first_seen_at DESC, id DESC) = 1) ORDER BY first_seen_at DESC, id DESC LIMIT 45),
outc AS (SELECT id, CASE WHEN old THEN 'already_sent' WHEN live THEN 'cluster_dedup' WHEN id = lead_id THEN 'sent' WHEN lead_id IS NOT NULL THEN 'cluster_dedup' ELSE 'hourly_cap' END AS outcome FROM st LEFT JOIN lead USING (story)) """


def _dispatch(spark, d):
    return AL.dispatch_alerts(V.stories(V.articles(spark, d)), _ledger(spark, d), V.as_of(), 50, _PARAMS)


@query(_DISPATCH + "SELECT id, outcome FROM outc")
def dispatch_alerts(spark, d):
    return _dispatch(spark, d)[0].select("id", "outcome")


@query(_DISPATCH + "SELECT outcome, count(*) AS n FROM outc GROUP BY 1")
def dispatch_counts(spark, d):
    return AL.dispatch_counts(_dispatch(spark, d)[0])


_SHORT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE substr({0}, 1, {1} - 1) || '…' END"


@query(_TRIG + f"""SELECT id, (CASE WHEN strong THEN '💢 강한 신호' WHEN watch THEN '💹 관심 티커' ELSE '📰' END) || ' · ' || {_SHORT.format('title', 200)} AS title, CASE sentiment_label WHEN 'positive' THEN 2278750 WHEN 'negative' THEN 15680580 ELSE 7041664 END::BIGINT AS color,
 'https://x.example/' || md5(text) AS url, nullif({_SHORT.format('body', 1200)}, '') AS description,
 concat_ws('  ·  ', source_type, language, nullif(concat_ws('/', CASE WHEN strong THEN 'strong_sentiment' END, CASE WHEN watch THEN 'ticker_watch' END), '')) AS footer, strftime(coalesce(published_at, last_seen_at), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
 FROM (SELECT *, coalesce(nullif(trim(ai_summary, E' \\t\\n'), ''), nullif(trim(summary, E' \\t\\n'), '')) AS body FROM trig JOIN (SELECT * EXCLUDE (first_seen_at, cluster_rep_id) FROM stories) USING (id))""")
def alert_payloads(spark, d):
    out = AL.alert_payloads(AL.evaluate_triggers(V.stories(V.articles(spark, d)), _PARAMS))
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return out.select("id", get("title").alias("title"), get("color").cast("bigint").alias("color"), get("url").alias("url"), get("description").alias("description"), get("footer.text").alias("footer"), get("timestamp").alias("timestamp"))


# ---- streams' batch twins --------------------------------------------------------------------------------------------------


@query("""SELECT epoch(s)::BIGINT AS start, count(*) AS total, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (sentiment_label = 'neutral') AS neutral
 FROM (SELECT sentiment_label, unnest([time_bucket(INTERVAL 12 HOUR, effective_published, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, effective_published, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS s FROM articles) GROUP BY 1""")
def rolling_summary(spark, d):
    return ST.rolling_summary(V.articles(spark, d), 24, "12 hours").select(secs("start"), "total", "positive", "negative", "neutral")


# ---- text ------------------------------------------------------------------------------------------------------------------


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def clean_text(spark, d):
    return V.pages(spark, d).select("page_id", X.clean_text(F.col("html"), decode=False).alias("text"))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, lower(regexp_extract(html, '(?i)<html[^>]*lang=.([a-z]+)', 1)) AS lang FROM pages")
def html_title_and_lang(spark, d):
    return V.pages(spark, d).select("page_id", X.html_title(F.col("html")).alias("title"), X.html_lang(F.col("html")).alias("lang"))




@query("SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_transform(" + _TT.format("title") + ", lambda x: lower(x))), lambda x: x NOT IN ('the', 'and', 'of'))), ' ') AS tokens FROM articles WHERE language = 'en'")
def title_tokens(spark, d):
    t = X.title_tokens(F.col("title"), F.col("language"), {"en": ("the", "and", "of")})
    return V.articles(spark, d).where("language = 'en'").select("id", F.array_join(F.sort_array(t), " ").alias("tokens"))


@query("""SELECT a.id, round(coalesce(len(list_intersect(a.t, b.t)) / nullif(len(list_distinct(list_concat(a.t, b.t))), 0), 0), 6) AS jaccard FROM (SELECT id, list_distinct(list_transform(TT, lambda x: lower(x))) AS t FROM articles) a
 JOIN (SELECT id, list_distinct(list_transform(TT, lambda x: lower(x))) AS t FROM articles) b ON b.id = a.id + 1""".replace("TT", _TT.format("title")))
def token_jaccard(spark, d):
    t = V.articles(spark, d).select("id", X.title_tokens(F.col("title"), F.col("language")).alias("t"))
    pairs = t.join(t.select((F.col("id") - 1).alias("id"), F.col("t").alias("u")), "id")
    return pairs.select("id", r6(X.jaccard(F.col("t"), F.col("u")), "jaccard"))


@query("SELECT id, array_to_string(list_transform(list_filter(tickers, lambda x: x <> ''), lambda x: upper(x)), ',') AS tickers FROM articles")
def norm_tickers(spark, d):
    t = F.when(F.col("tickers").isNotNull(), F.array_join(X.norm_tickers(F.col("tickers")), ","))
    return V.articles(spark, d).select("id", t.alias("tickers"))


@query("SELECT id, len(" + _PAIRS.format("t") + ")::BIGINT AS shingles FROM (SELECT id, " + _SPLIT.format("coalesce(summary, '')") + " AS t FROM articles)")
def body_shingle_counts(spark, d):
    return V.articles(spark, d).select("id", F.size(X.body_shingles(F.col("summary"))).cast("bigint").alias("shingles"))


#: The body of a page; the references are those that the given pages hold.
_BODY = ", cut AS (SELECT page_id, url, html, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "nav", "noscript", "footer", "aside", "form", "head")) + r"""', ' ', 'g') AS c FROM pages),
plain AS (SELECT page_id, url, html, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(c, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS c FROM cut),
bodies AS (SELECT page_id, url, html, array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM plain) """


@query(_BODY + "SELECT page_id, body FROM bodies")
def html_body_text(spark, d):
    return V.pages(spark, d).select("page_id", X.html_body_text(F.col("html")).alias("body"))


# ---- sources ---------------------------------------------------------------------------------------------------------------


_STRIPPED = "trim(text, E' \\t\\n')"


@query("SELECT 'https://x.com/' || source_url || '/status/' || id AS url, CASE WHEN length(S) > 100 THEN substr(S, 1, 100) || '…' ELSE S END AS title, coalesce(language, 'en') AS language, S AS summary, 'https://x.com/' || source_url AS source_url, 'x_feed' AS source_type, epoch(as_of)::BIGINT AS published_at, id AS tweet_id, S LIKE '🚨%' AS breaking FROM articles, knobs WHERE S <> ''".replace("S)", f"{_STRIPPED})").replace("S,", f"{_STRIPPED},").replace("ELSE S ", f"ELSE {_STRIPPED} ").replace(" S AS", f" {_STRIPPED} AS").replace("S LIKE", f"{_STRIPPED} LIKE").replace("WHERE S ", f"WHERE {_STRIPPED} "))
def normalize_posts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    urls = F.struct(F.array(F.struct(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("expanded_url"))).alias("urls"))
    posts = docs.select(F.col("doc_id").alias("id"), "text", F.lit(V.AS_OF).cast("timestamp").alias("created_at"), F.col("lang").alias("lang"), urls.alias("entities"), F.col("source").alias("username"))
    of = lambda k: F.get_json_object("raw_data", f"$.x.{k}")
    out = R.normalize_posts(posts)
    return out.select("url", "title", "language", "summary", "source_url", "source_type", secs("published_at"), of("tweet_id").cast("long").alias("tweet_id"), of("breaking").cast("boolean").alias("breaking"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""SELECT {_TRIM.format('title')} AS title, url, 'https://newsapi.org/v2/everything' AS source_url, 'newsapi' AS source_type, 'en' AS language, nullif(CASE WHEN id % 4 = 1 THEN NULL ELSE {_TRIM.format('summary')} END, '') AS summary,
 CASE WHEN id % 11 <> 0 THEN epoch(first_seen_at)::BIGINT END AS published_at, 0 AS tags, CASE WHEN id % 2 = 0 THEN source_url ELSE 'feed-' || language END AS source_name, 'everything' AS source_tag FROM articles WHERE id % 3 <> 0 AND {_TRIM.format('title')} <> ''""")
def normalize_news_api(spark, d):
    """Titles with white space around them, removed and blank ones, answers that failed, texts in one of two fields or none, a source's name or its id."""
    a = V.articles(spark, d)
    none = F.lit(None).cast("string")
    item = F.struct(
        F.when(F.col("id") % 3 == 0, R.REMOVED).otherwise(F.concat(F.lit(" \t"), F.col("title"), F.lit("\n "))).alias("title"), "url", F.when(F.col("id") % 4 > 1, F.col("summary")).alias("description"),
        F.when(F.col("id") % 4 == 1, R.REMOVED).when(F.col("id") % 4 == 0, F.concat(F.lit("\n"), F.col("summary"))).alias("content"),
        F.when(F.col("id") % 11 != 0, F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publishedAt"),
        F.struct(F.concat(F.lit("feed-"), F.col("language")).alias("id"), F.when(F.col("id") % 2 == 0, F.col("source_url")).otherwise("").alias("name")).alias("source"),
    )
    ok = a.select(F.lit("ok").alias("status"), F.array(item).alias("articles"))
    failed = a.where("id % 2 = 0").select(F.lit("error").alias("status"), F.array(item).alias("articles"))
    of = lambda k: F.get_json_object("raw_data", f"$.{k}")
    out = R.normalize_news_api(ok.unionByName(failed))
    tags = F.size("tickers") + F.size("sectors")
    return out.select("title", "url", "source_url", "source_type", "language", "summary", secs("published_at"), tags.alias("tags"), of("_source_name").alias("source_name"), of("_source_tag").alias("source_tag"))


_CLEAN = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""SELECT {_CLEAN.format('title')} AS title, url, nullif({_CLEAN.format('summary')}, '') AS summary, epoch(first_seen_at)::BIGINT AS published_at,
 coalesce(array_to_string(list_filter(tickers, lambda x: regexp_full_match(x, '[A-Z]{{1,5}}')), ','), '') AS tickers FROM articles WHERE {_CLEAN.format('title')} <> ''""")
def normalize_feed_entries(spark, d):
    a = V.articles(spark, d)
    none = F.lit(None).cast("string")
    e = a.select("title", F.col("url").alias("link"), F.array(F.struct(F.col("url").alias("href"))).alias("links"), none.alias("summary"), F.col("summary").alias("description"), F.date_format("first_seen_at", "EEE, dd MMM yyyy HH:mm:ss Z").alias("published"), none.alias("updated"), F.transform("tickers", lambda t: F.struct(t.alias("term"))).alias("tags"), F.col("source_url").alias("feed_url"))
    feeds = a.select(F.col("source_url").alias("feed_url")).distinct().withColumn("language", F.lit("en"))
    return R.normalize_feed_entries(e, feeds).select("title", "url", "summary", secs("published_at"), F.array_join("tickers", ",").alias("tickers"))


_CHANNEL_HEAD = """CASE WHEN id % 6 = 1 THEN '🚨 ' WHEN id % 6 = 2 THEN 'Weekly plan: ' WHEN id % 6 = 3 THEN 'US market recap ' ELSE '' END"""


@query(f"""SELECT 'https://www.youtube.com/post/p' || id AS url, CASE WHEN length(split_part(s, chr(10), 1)) < 20 AND length(t) > 20 THEN substr(s, 1, 150) ELSE substr(split_part(s, chr(10), 1), 1, 150) END AS title, t AS summary,
 'youtube_channel:' || source_url AS source_url, 'youtube_post' AS source_type, 'ko' AS language, epoch(as_of)::BIGINT - 86400 * (id % 9) AS published_at, 'p' || id AS post_id, source_url AS handle,
 CASE WHEN regexp_matches(h, '^(🚨|✔|\\[속보\\]|BREAKING:|JUST IN:|UPDATE:)') THEN 'breaking' WHEN regexp_matches(h, '주간|weekly|주요 일정|Weekly') THEN 'weekly_agenda' WHEN regexp_matches(h, '미국 증시 요약|증시 요약|미국증시 요약|US market recap|market recap') THEN 'daily_recap' ELSE 'general' END AS category,
 (id % 9) || ' days ago' AS published_time_text, CASE WHEN id % 5 <> 0 THEN 1000 + id % 7000 END AS vote_count, CASE WHEN id % 4 = 1 THEN 'big' || id WHEN id % 4 = 2 THEN 'a' || id || ',b' || id ELSE '' END AS images
 FROM (SELECT *, {_TRIM.format('t')} AS s, substr(regexp_replace(t, '^\\s+', ''), 1, 80) AS h FROM (SELECT *, {_CHANNEL_HEAD} || text AS t FROM articles)), knobs WHERE s <> ''""")
def normalize_channel_posts(spark, d):
    """Posts of two text runs, with breaking, weekly and daily heads, numbers of votes with commas or none, one image, several or none."""
    from newsloom.schema import CHANNEL_POST

    i = F.col("doc_id")
    head = F.when(i % 6 == 1, "🚨 ").when(i % 6 == 2, "Weekly plan: ").when(i % 6 == 3, "US market recap ").otherwise("")
    run = lambda c: F.struct(c.alias("text"))
    thumb = lambda *names: F.struct(F.array(*(F.struct(F.concat(F.lit(n), i.cast("string")).alias("url")) for n in names)).alias("thumbnails"))
    image = lambda *names: F.struct(thumb(*names).alias("image"))
    several = F.struct(F.array(F.struct(image("small", "a").alias("backstageImageRenderer")), F.struct(image("b").alias("backstageImageRenderer"))).alias("images"))
    label = F.when(i % 5 != 0, F.concat(F.format_number(1000 + i % 7000, 0), F.lit(" likes"))).otherwise("no likes")
    raw = F.to_json(F.struct(
        F.concat(F.lit("p"), i.cast("string")).alias("postId"), F.struct(F.array(run(head), run(F.col("text"))).alias("runs")).alias("contentText"),
        F.struct(F.concat((i % 9).cast("string"), F.lit(" days ago")).alias("simpleText")).alias("publishedTimeText"), F.col("source").alias("handle"),
        F.struct(F.struct(F.struct(label.alias("label")).alias("accessibilityData")).alias("accessibility")).alias("voteCount"),
        F.struct(F.when(i % 4 == 1, image("small", "big")).alias("backstageImageRenderer"), F.when(i % 4 == 2, several).alias("postMultiImageRenderer")).alias("backstageAttachment"),
    ))
    posts = spark.read.parquet(f"{d}/documents.parquet").select(F.from_json(raw, CHANNEL_POST).alias("p")).select("p.*")
    out = R.normalize_channel_posts(posts, V.as_of())
    of = lambda k: F.get_json_object("raw_data", f"$.youtube.{k}")
    return out.select(
        "url", "title", "summary", "source_url", "source_type", "language", secs("published_at"), of("post_id").alias("post_id"), of("handle").alias("handle"), of("category").alias("category"),
        of("published_time_text").alias("published_time_text"), of("vote_count").cast("bigint").alias("vote_count"), F.array_join(F.from_json(of("image_urls"), "array<string>"), ",").alias("images"),
    )


@query(_BODY + r""", met AS (SELECT page_id, url, CASE WHEN page_id % 7 = 3 THEN 'https://x.example/login?next=' || page_id ELSE url END AS final_url, CASE WHEN page_id % 10 = 9 THEN 404 ELSE 200 END AS http_status,
  CASE WHEN page_id % 8 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS kind, CASE WHEN page_id % 9 = 4 THEN '<p>로그인 ' || page_id || ' please</p>' ELSE html END AS html, CASE WHEN page_id % 9 = 4 THEN '로그인 ' || page_id || ' please' ELSE body END AS body FROM bodies),
seen AS (SELECT *, CASE WHEN page_id % 7 = 3 THEN 'login_path' WHEN kind LIKE 'text/html%' AND page_id % 9 = 4 THEN 'login_words' ELSE '' END AS message,
  CASE WHEN html ILIKE '%<title%</title>%' THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END AS meta,
  list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: length(x) BETWEEN 10 AND 200)[1] AS line FROM met),
done AS (SELECT *, CASE WHEN http_status >= 400 THEN 'error' WHEN kind NOT LIKE 'text/html%' THEN 'unsupported' WHEN message <> '' THEN 'login_required' WHEN length(body) < 40 THEN 'error' ELSE 'ok' END AS status FROM seen)
SELECT page_id, final_url AS url, status, message, length(body) AS extracted_len, CASE WHEN status = 'ok' THEN lower(regexp_extract(html, '(?i)<html[^>]*lang=.([a-z]+)', 1)) END AS language, CASE WHEN status = 'ok' THEN body END AS summary,
  CASE WHEN status = 'ok' THEN substr(CASE WHEN line IS NOT NULL AND (coalesce(meta, '') = '' OR length(regexp_replace(meta, '[^|·»›]', '', 'g')) >= 2 OR length(meta) <= 10) THEN line ELSE coalesce(nullif(meta, ''), line, '(untitled)') END, 1, 500) END AS title FROM done""")
def ingest_pages(spark, d):
    """Pages as they are, and some behind a log-in path or words, of another type, or with an error's status."""
    i, p = F.col("page_id"), V.pages(spark, d)
    p = p.withColumns({
        "final_url": F.when(i % 7 == 3, F.concat(F.lit("https://x.example/login?next="), i.cast("string"))).otherwise(F.col("url")), "http_status": F.when(i % 10 == 9, 404).otherwise(200),
        "content_type": F.when(i % 8 == 5, "application/pdf").otherwise("text/html; charset=utf-8"), "html": F.when(i % 9 == 4, F.concat(F.lit("<p>로그인 "), i.cast("string"), F.lit(" please</p>"))).otherwise(F.col("html")),
        "url": i.cast("string"),
    })
    asked = F.get_json_object("raw_data", "$.url_ingest.requested_url").cast("bigint")
    return R.ingest_pages(p, V.as_of()).select(asked.alias("page_id"), "url", "status", "message", F.col("extracted_len").cast("bigint").alias("extracted_len"), "language", "summary", "title")


@query("""SELECT page_id, title, (length(regexp_replace(title, '[^|·»›]', '', 'g')) >= 2 OR length(title) <= 10) AS generic FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Home | ' || page_id || ' | News' WHEN page_id % 3 = 1 THEN '  short ' ELSE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END AS title FROM pages)""")
def generic_titles(spark, d):
    i = F.col("page_id")
    t = F.when(i % 3 == 0, F.concat(F.lit("Home | "), i.cast("string"), F.lit(" | News"))).when(i % 3 == 1, "  short ").otherwise(X.html_title(F.col("html")))
    return V.pages(spark, d).select("page_id", t.alias("title"), X.is_generic_title(t).alias("generic"))


@query("SELECT id, list_filter(list_transform(string_split(summary, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: length(x) BETWEEN 10 AND 200)[1] AS line FROM articles")
def first_meaningful_line(spark, d):
    return V.articles(spark, d).select("id", X.first_meaningful_line(F.col("summary")).alias("line"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'https://long.example/' || id WHEN id % 3 = 1 THEN 'https://t.example/' || id END AS linked_url FROM articles")
def first_expanded_url(spark, d):
    """Links of a post: without either address, with a short one only, with both."""
    i = F.col("id")
    to = lambda host: F.concat(F.lit(f"https://{host}.example/"), i.cast("string"))
    link = lambda short, long: F.struct(short.alias("url"), long.alias("expanded_url"))
    none = F.lit(None).cast("string")
    urls = F.when(i % 3 == 0, F.array(link(none, F.lit("")), link(to("t"), to("long")))).when(i % 3 == 1, F.array(link(none, none), link(to("t"), none), link(to("u"), to("v")))).otherwise(F.array(link(F.lit(""), none)))
    return V.articles(spark, d).select("id", X.first_expanded_url(urls).alias("linked_url"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 1000 * id + 7 WHEN id % 4 = 2 THEN id % 900 ELSE NULL END AS votes FROM articles")
def vote_count(spark, d):
    i = F.col("id")
    label = F.when(i % 4 == 0, "no votes").when(i % 4 == 1, F.concat(F.format_number(1000 * i + 7, 0), F.lit(" likes"))).when(i % 4 == 2, F.concat(F.lit("likes: "), (i % 900).cast("string")))
    return V.articles(spark, d).select("id", X.vote_count(label).alias("votes"))


@query("SELECT id, concat_ws('. ', nullif(title, ''), CASE WHEN id % 3 <> 0 THEN summary END) AS text FROM articles")
def embedding_text(spark, d):
    return V.articles(spark, d).select("id", X.embedding_text(F.col("title"), F.when(F.col("id") % 3 != 0, F.col("summary")).otherwise("")).alias("text"))


@query("SELECT id, CASE WHEN id % 4 = 0 OR tickers IS NULL THEN '' ELSE array_to_string(list_transform(tickers, lambda x: upper(x)), ',') END AS tickers, CASE WHEN id % 4 = 0 OR id % 4 = 3 OR sectors IS NULL THEN '' ELSE array_to_string(sectors, ',') END AS sectors FROM articles")
def parse_tag_metadata(spark, d):
    """Answers that are JSON, hold a brace block, or hold none; sectors left out in some."""
    i = F.col("id")
    json = F.to_json(F.struct("tickers", F.when(i % 4 != 3, F.col("sectors")).alias("sectors")))
    raw = F.when(i % 4 == 0, "no answer").when(i % 4 == 1, json).otherwise(F.concat(F.lit("Here it is: "), json, F.lit(" as asked")))
    out = V.articles(spark, d).select("id", S.parse_tag_metadata(raw).alias("p"))
    of = lambda c: F.coalesce(F.array_join(f"p.{c}", ","), F.lit("")).alias(c)
    return out.select("id", of("tickers"), of("sectors"))


@query("SELECT id, lower(source_url) || ',' || language || ',x' || id AS names, upper(language) AS tags FROM articles")
def csv_list(spark, d):
    """Names with marks, spaces, blanks and mixed case."""
    text = F.concat(F.lit(" @"), F.upper("source_url"), F.lit(" ,, @@"), F.col("language"), F.lit(" ,  ,X"), F.col("id").cast("string"))
    return V.articles(spark, d).select("id", F.array_join(X.csv_list(text), ",").alias("names"), F.array_join(X.csv_list(F.concat(F.col("language"), F.lit(","))  , upper=True), ",").alias("tags"))


@query("SELECT id, source_type, title, CASE WHEN source_type = 'api' THEN summary END AS summary, CASE WHEN source_type = 'rss' THEN id END AS entry FROM articles WHERE source_type IN ('rss', 'api')")
def union_sources(spark, d):
    a = V.articles(spark, d)
    rss = a.where("source_type = 'rss'").select("title", "source_type", "id", F.col("id").alias("entry"))
    return R.union_sources(rss, a.where("source_type = 'api'").select("id", "title", "summary", "source_type")).select("id", "source_type", "title", "summary", "entry")


# ---- repairs and models ----------------------------------------------------------------------------------------------------


@query("""SELECT 'unique_topic_url' AS rule, coalesce(sum(n - 1), 0)::BIGINT AS violations FROM (SELECT count(*) AS n FROM articles GROUP BY url HAVING count(*) > 1)
 UNION ALL SELECT 'unique_feedback', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM feedback GROUP BY user_id, news_id, action HAVING count(*) > 1)
 UNION ALL SELECT 'feedback_action', count(*) FROM feedback WHERE action = 'view' UNION ALL SELECT 'title_url_required', count(*) FROM articles WHERE title IS NULL OR url IS NULL
 UNION ALL SELECT 'sentiment_label', 0 UNION ALL SELECT 'language_length', 0""")
def check_constraints(spark, d):
    return Q.check_constraints(V.articles(spark, d), V.feedback(spark, d))


@query("SELECT (SELECT count(*) FROM stories WHERE id % 10 <> 7) AS articles, (SELECT count(*) FROM stories WHERE id % 10 <> 7 AND cluster_rep_id IS NOT NULL AND (cluster_rep_id % 10 <> 7 OR cluster_rep_id NOT IN (SELECT id FROM stories))) AS with_story, (SELECT count(*) FROM feedback WHERE news_id % 10 <> 7) AS feedback")
def cascade_delete(spark, d):
    s = V.stories(V.articles(spark, d))
    a, f = Q.cascade_delete(s, V.feedback(spark, d), s.where("id % 10 = 7"))
    return a.agg(F.count("*").alias("articles"), F.count("cluster_rep_id").alias("with_story")).crossJoin(F.broadcast(f.agg(F.count("*").alias("feedback"))))


@query("SELECT id, epoch(coalesce(published_at, first_seen_at))::BIGINT AS published_at, epoch(coalesce(published_at, first_seen_at))::BIGINT AS first_seen_at FROM articles")
def backfill_published(spark, d):
    return Q.backfill_published(V.articles(spark, d)).select("id", secs("published_at"), secs("first_seen_at"))


@query("SELECT id, CASE WHEN id % 4 = 0 AND length(summary) >= 100 AND summary <> title THEN summary ELSE title END AS summary, CASE WHEN id % 4 = 0 AND length(summary) >= 100 AND summary <> title THEN NULL ELSE sentiment END AS sentiment FROM articles")
def reset_enrichment(spark, d):
    a = V.articles(spark, d, vectors=True)
    bodies = a.where("id % 4 = 0").select("id", F.col("summary").alias("body"))
    return Q.reset_enrichment(a.withColumn("summary", F.col("title")), bodies).select("id", "summary", "sentiment")


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM articles, knobs WHERE first_seen_at >= as_of - INTERVAL 7 DAY AND ai_summary IS NULL
 AND (title <> trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) OR summary <> trim(regexp_replace(regexp_replace(summary, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))""")
def backfill_clean(spark, d):
    return Q.backfill_clean(V.articles(spark, d), V.as_of(), decode=False).select("id", "title")


def _hits_of(words) -> str:
    return f"len(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x IN ({V._list(sorted(words))})))"


@query(f"""SELECT id, round((g - b) / greatest(1, g + b), 6)::DOUBLE AS score, CASE WHEN (g - b) / greatest(1, g + b) > 0.2 THEN 'positive' WHEN (g - b) / greatest(1, g + b) < -0.2 THEN 'negative' ELSE 'neutral' END AS label
 FROM (SELECT id, {_hits_of(SC.GOOD)} AS g, {_hits_of(SC.BAD)} AS b FROM articles)""")
def score_batch(spark, d):
    return SC.score_batch(V.articles(spark, d).select("id", "title", "language"), SC.lexicon_scorer).select("id", r6("score", "score"), "label")


@query()
def embed_batch(spark, d):
    a = V.articles(spark, d).select("id", "title", "summary")
    out = SC.embed_batch(a, SC.hashing_embedder(16), 16, "hash-16", X.embedding_text(F.col("title"), F.col("summary")))
    return out.select("id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query("SELECT id, 'Sum ' || id AS ai_summary, 'TSLA' AS tickers, round(least(1.0, greatest(-1.0, sentiment * 2)), 6)::DOUBLE AS sentiment FROM articles WHERE language = 'en' AND abs(sentiment) >= 0.05")
def enrich_and_parse(spark, d):
    a = V.articles(spark, d).select("id", "language", "sentiment", F.format_string("%d|%.6f", F.col("id"), F.col("sentiment") * 2).alias("summary"), F.lit("").alias("title"))

    def client(text: str, lang: str) -> str:
        i, s = text.split("|")
        return f'Here it is: {{"ai_summary": " Sum {i} ", "tickers": ["tsla", ""], "sentiment": {s}}} done'

    p = SC.parse_enrichment(SC.enrich_batch(a, client))
    return p.select("id", "ai_summary", F.array_join("tickers", ",").alias("tickers"), r6("sentiment", "sentiment"))


@query("SELECT id, round((exp(s) - exp(-s)) / (exp(s) + exp(-s) + 1), 6) AS score, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT id, sentiment * 3 AS s FROM articles WHERE sentiment IS NOT NULL AND sentiment <> 0)")
def class_probs_to_sentiment(spark, d):
    s = F.col("sentiment") * 3
    out = V.articles(spark, d).where("sentiment is not null and sentiment <> 0").select("id", S.class_probs_to_sentiment(F.array(s, -s, F.lit(0.0))).alias("p"))
    return out.select("id", "p.score", "p.label")


@query("SELECT count(*) FILTER (language IN ('en', 'ko') AND abs(sentiment) >= 0.05) AS eligible, strftime(first_seen_at, '%Y-%m-%d %H') AS hour FROM articles GROUP BY 2")
def enrich_eligible_by_hour(spark, d):
    rows = V.articles(spark, d).groupBy(F.date_format(S.hour_bucket(F.col("first_seen_at")), "yyyy-MM-dd HH").alias("hour"))
    return rows.agg(F.count_if(S.enrich_eligible(F.col("language"), F.col("sentiment"))).alias("eligible"))


@query("SELECT id, CASE WHEN length(s) <= 80 THEN s ELSE substr(s, 1, 79) || '…' END AS shown FROM (SELECT id, coalesce(nullif(trim(ai_summary, E' \\t\\n'), ''), nullif(trim(summary, E' \\t\\n'), ''), '') AS s FROM articles)")
def display_summary(spark, d):
    return V.articles(spark, d).select("id", X.display_summary(F.col("language"), F.col("translated_summary"), F.col("ai_summary"), F.col("summary"), 80).alias("shown"))
