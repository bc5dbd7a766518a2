"""Queries that run the streams to their end over files made from the given tables, and return what the streams keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schema
from newsloom.operators import alerts as AL
from newsloom.plans import queries as Q
from newsloom.plans import views as V
from newsloom.scratch import Scratch
from newsloom.sources import records as R
from newsloom.streaming import streams as ST

BATCHES = 3


class Run:
    """Folders of one run, and streams that take one file a trigger."""

    def __init__(self, spark: SparkSession, name: str):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.STATE_STORE)
        self.spark, self.scratch = spark, Scratch(spark, name)

    def path(self, name: str) -> str:
        return f"{self.scratch.root}/{name}"

    def stream(self, rows: DataFrame, part=None) -> DataFrame:
        """``rows`` as a stream of ``BATCHES`` micro-batches by ``part`` (0 and up), or of one."""
        path = self.path(f"in{self.scratch.count}")
        self.scratch.count += 1
        for k in range(1 if part is None else BATCHES):
            (rows if part is None else rows.where(part == k)).coalesce(1).write.mode("append").parquet(path)
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def drain(self, query) -> None:
        query.awaitTermination()
        if query.exception():
            raise query.exception()


_PART = f"least({BATCHES - 1}, event_id * {BATCHES} // (SELECT count(*) FROM events))"


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e, F.least(F.lit(BATCHES - 1), F.floor(F.col("event_id") * BATCHES / e.count())).cast("int")


@Q.query(f"""SELECT 'https://x.example/' || user_id || '/' || event_type AS url, arg_min('event ' || event_id, event_id) AS title, count(DISTINCT {_PART}) AS hit_count, true AS own_id FROM events GROUP BY 1""")
def stream_upsert(spark, d):
    run = Run(spark, "stream-upsert")
    e, part = _events(spark, d)
    rows = e.select(F.col("event_id").alias("position"), F.concat_ws("/", F.lit("https://x.example"), F.col("user_id").cast("string"), "event_type").alias("url"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"), part.alias("part"))
    run.drain(ST.stream_upsert(run.stream(rows, F.col("part")), run.path("table"), run.path("cp"), schema.ARTICLE, V.as_of()))
    out = ST.Articles(spark, run.path("table"), schema.ARTICLE).read()
    ids = out.groupBy("id").agg(F.count("*").alias("n"))
    return out.join(ids, "id").select("url", "title", F.col("hit_count").cast("bigint").alias("hit_count"), (F.col("n") == 1).alias("own_id"))


@Q.query("""SELECT strftime(ts, '%Y-%m') AS month, event_id AS id, (row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY event_id) - 1) * 0.5 < 1500 AS allowed FROM events""")
def stream_budget_gate(spark, d):
    run = Run(spark, "stream-budget")
    e, part = _events(spark, d)
    rows = e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), part.alias("part"))
    run.drain(ST.budget_gate(run.stream(rows, F.col("part")), run.path("gate"), run.path("cp"), 0.5, 1500.0))
    return ST.Parts(spark, run.path("gate/posts")).read(ST.GATED)


_HELD = Q._OPS + """, held AS (SELECT *, last_value(CASE WHEN op = 'add' THEN action END IGNORE NULLS) OVER (PARTITION BY user_id, news_id, slot ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS added FROM ops),
fin AS (SELECT user_id, news_id, slot, arg_max(op, id) AS op, arg_max(action, id) AS action FROM held WHERE NOT (op = 'delete' AND action IS DISTINCT FROM added) GROUP BY 1, 2, 3),
now AS (SELECT user_id, news_id, action FROM fin WHERE op = 'add') """


@Q.query(_HELD + Q._AFFINITY.replace("FROM feedback f", "FROM now f") + "SELECT user_id, kind, tag, round(score, 9) AS score FROM affinity")
def stream_affinity(spark, d):
    """Feedback that is added and deleted in three batches."""
    run = Run(spark, "stream-affinity")
    f = V.feedback(spark, d).withColumn("op", F.when(F.col("id") % 4 == 0, "delete").otherwise("add"))
    n = f.count()
    rows = f.withColumn("part", F.least(F.lit(BATCHES - 1), F.floor(F.col("id") * BATCHES / n)))
    run.drain(ST.affinity_refresh(run.stream(rows, F.col("part")), V.articles(spark, d), run.path("affinity"), run.path("cp"), compact_every=2, availableNow=True))
    return ST.Affinity(spark, run.path("affinity")).read().select("user_id", "kind", "tag", F.round("score", 9).alias("score"))


@Q.query(Q._DISPATCH + "SELECT 'article' AS kind, id AS key FROM outc WHERE outcome IN ('sent', 'cluster_dedup') UNION ALL SELECT 'sent', id FROM outc WHERE outcome = 'sent' UNION ALL SELECT 'cluster', cluster_rep_id FROM outc JOIN stories USING (id) WHERE outcome = 'sent' AND cluster_rep_id IS NOT NULL")
def stream_alert_throttle(spark, d):
    """The marks of one batch against a ledger that other batches left."""
    run = Run(spark, "stream-alerts")
    ledger = ST.Parts(spark, run.path("ledger"))
    ledger.write(Q._ledger(spark, d), -1, "c")
    rows = V.stories(V.articles(spark, d))
    run.drain(ST.alert_throttle(run.stream(rows), run.path("ledger"), run.path("cp"), schema.LEDGER, V.as_of(), 50, Q._PARAMS, lambda df: None))
    return spark.read.schema(schema.LEDGER).parquet(run.path("ledger/v0")).select("kind", "key")


_WINDOWS = """SELECT epoch(s)::BIGINT AS start, count(*) AS total, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (sentiment_label = 'neutral') AS neutral
 FROM (SELECT sentiment_label, unnest(list_transform(range({n}), lambda k: time_bucket(INTERVAL {slide} HOUR, effective_published, TIMESTAMP '1970-01-01') - to_hours({slide} * k::INT))) AS s FROM articles) GROUP BY 1"""


@Q.query("SELECT * FROM (" + _WINDOWS.format(n=2, slide=12) + ") WHERE start + 86400 <= (SELECT epoch(max(effective_published))::BIGINT - 3600 FROM articles)")
def stream_rolling_summary(spark, d):
    """The windows that no late row can reach any more."""
    run = Run(spark, "stream-summary")
    rows = V.articles(spark, d).select("id", "published_at", "first_seen_at", "sentiment_label")
    out = ST.rolling_summary(run.stream(rows.orderBy(F.coalesce("published_at", "first_seen_at"))), 24, "12 hours")
    run.drain(out.writeStream.format("parquet").option("path", run.path("out")).option("checkpointLocation", run.path("cp")).trigger(availableNow=True).start())
    return spark.read.schema(out.schema).parquet(run.path("out")).select(Q.secs("start"), "total", "positive", "negative", "neutral")


@Q.query(_WINDOWS.format(n=60, slide=12))
def rolling_summary_month(spark, d):
    return ST.rolling_summary(V.articles(spark, d), 720, "12 hours").select(Q.secs("start"), "total", "positive", "negative", "neutral")


@Q.query("""SELECT id, CASE WHEN (id * 37) % 100 <= 60 THEN sentiment END AS sentiment, CASE WHEN (id * 37) % 100 <= 60 THEN epoch(first_seen_at)::BIGINT + 60 * ((id * 37) % 100) END AS scored_at FROM articles""")
def scored_articles(spark, d):
    """Scores 0 to 99 minutes after their articles, repeated."""
    a = V.articles(spark, d)
    minutes = F.col("id") * 37 % 100
    scores = a.select("id", (F.col("first_seen_at") + F.make_dt_interval(mins=minutes.cast("int"))).alias("scored_at"), "sentiment")
    out = ST.scored_articles(a.drop("sentiment").unionByName(a.drop("sentiment").where("id % 3 = 0")), scores.unionByName(scores.where("id % 5 = 0")))
    return out.select("id", "sentiment", Q.secs("scored_at"))


@Q.query("SELECT id, title, url, epoch(first_seen_at)::BIGINT AS first_seen_at, array_to_string(tickers, ',') AS tickers, sentiment FROM articles")
def read_articles(spark, d):
    scratch = Scratch(spark, "read")
    path = scratch.save(V.articles(spark, d))._scratch_path
    return R.read_articles(spark, path).select("id", "title", "url", Q.secs("first_seen_at"), F.array_join("tickers", ",").alias("tickers"), "sentiment")


@Q.query("SELECT n_nationkey::BIGINT AS id, n_name AS name, lower(n_name) AS slug FROM nation")
def read_topics(spark, d):
    topics = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"))
    return R.read_topics(spark, Scratch(spark, "read").save(topics)._scratch_path).select("id", "name", "slug")


@Q.query("SELECT id, user_id, news_id, action, floor(epoch(created_at))::BIGINT AS created_at FROM feedback")
def read_feedback(spark, d):
    return R.read_feedback(spark, Scratch(spark, "read").save(V.feedback(spark, d))._scratch_path).select("id", "user_id", "news_id", "action", Q.secs("created_at"))


QUERIES, ORACLES = Q.QUERIES, Q.ORACLES
