"""Which articles raise an alert, which of these are sent, and what is sent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.payload import is_breaking_payload
from newsloom.functions.score import hour_bucket
from newsloom.functions.text import blank_to_null, strip, truncate
from newsloom.operators.filters import recent_window
from newsloom.operators.running import running_sums

ARTICLE_DAYS, CLUSTER_HOURS = 30, 24
#: Fixed values of the payload: badges by trigger in order of weight, colours by label, and its labels.
BADGES = (("breaking", "🚨 BREAKING"), ("strong_sentiment", "💢 강한 신호"), ("ticker_watch", "💹 관심 티커"))
COLORS = {"positive": 0x22C55E, "negative": 0xEF4444}
NEUTRAL_COLOR = 0x6B7280
TAGS = 10
#: Up to this cap the hour's winners are taken and ranked in one task and broadcast.
SMALL_CAP = 10_000


@dataclass(frozen=True)
class AlertParams:
    lookback_min: int = 60
    min_abs_sentiment: float = 0.7
    rescue: float = 0.8
    min_cluster: int = 3
    min_cluster_en: int = 2
    max_cluster: int = 50
    require_sectors: bool = True
    watch: tuple[str, ...] = ()
    watch_abs_sentiment: float = 0.3


def trigger_reasons(p: AlertParams, breaking: Column) -> Column:
    """Array of breaking, strong_sentiment and ticker_watch. A zero counts as positive when signs are compared."""
    s, llm = F.col("sentiment"), F.col("llm_sentiment")
    strong = F.coalesce(F.abs(s) >= p.min_abs_sentiment, F.lit(False))
    agree = strong & (F.abs(llm) >= p.min_abs_sentiment) & ((s >= 0) == (llm >= 0))
    sure = F.when(llm.isNull(), strong).otherwise(F.coalesce(agree, F.lit(False)) | (F.abs(llm) >= p.rescue))
    size = F.when(F.coalesce("cluster_size", F.lit(0)) == 0, 1).otherwise(F.col("cluster_size"))
    least = F.when(F.col("language").eqNullSafe("en"), p.min_cluster_en).otherwise(p.min_cluster)
    tagged = F.lit(not p.require_sectors) | (F.coalesce(F.size("sectors"), F.lit(0)) > 0)
    watch = F.array(*(F.lit(w.strip().upper()) for w in p.watch)) if p.watch else F.array().cast("array<string>")
    seen = F.arrays_overlap(F.transform("tickers", lambda t: F.upper(t)), watch) & (F.abs(s) >= p.watch_abs_sentiment)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(yes(breaking), "breaking"), F.when(yes(sure & (size >= least) & (size < p.max_cluster) & tagged), "strong_sentiment"), F.when(yes(seen), "ticker_watch"),
    ))


def evaluate_triggers(df: DataFrame, p: AlertParams = AlertParams()) -> DataFrame:
    """``raw_data`` may be JSON text or a variant."""
    return df.withColumn("reasons", trigger_reasons(p, is_breaking_payload(df))).withColumn("should_alert", F.size("reasons") > 0)


def live_marks(ledger: DataFrame, as_of: Column) -> DataFrame:
    """The marks that still count: articles' for ``ARTICLE_DAYS``, stories' for ``CLUSTER_HOURS``, sendings' for the rest of their UTC hour."""
    since = {"article": as_of - F.make_dt_interval(days=F.lit(ARTICLE_DAYS)), "cluster": as_of - F.make_dt_interval(hours=F.lit(CLUSTER_HOURS)), "sent": hour_bucket(as_of)}
    live = F.lit(False)
    for kind, at in since.items():
        live = live | ((F.col("kind") == kind) & (F.col("marked_at") >= at))
    return ledger.where(live)


def alert_outcomes(articles: DataFrame, ledger: DataFrame, as_of: Column, cap: int = 50, p: AlertParams = AlertParams()) -> DataFrame:
    """Outcome of each candidate of the lookback window.

    Newest first: one in the ledger is ``already_sent``; one whose story was alerted within a day is ``cluster_dedup`` and marked; of the others the
    first of each story leads, the first leaders up to what is left of this UTC hour's cap are ``sent``, later ones ``hourly_cap`` and unmarked;
    a follower shares its leader's fate. Marks that no longer count are passed over, and so are marks after ``as_of`` of another hour's sendings.
    """
    marks = live_marks(ledger, as_of)
    due = evaluate_triggers(recent_window(articles, "first_seen_at", p.lookback_min, "minutes", as_of), p).where("should_alert").select("id", "first_seen_at", "cluster_rep_id", "reasons")
    old = marks.where("kind = 'article'").groupBy(F.col("key").alias("id")).agg(F.lit(True).alias("old"))
    live = marks.where("kind = 'cluster'").groupBy(F.col("key").alias("cluster_rep_id")).agg(F.lit(True).alias("live"))
    used = marks.where((F.col("kind") == "sent") & (hour_bucket(F.col("marked_at")) == hour_bucket(as_of))).agg(F.count("*").alias("used"))
    rows = due.join(old, "id", "left").join(live, "cluster_rep_id", "left")
    rows = rows.withColumn("open", F.col("old").isNull() & F.col("live").isNull()).withColumn("story", F.coalesce(F.concat(F.lit("c"), F.col("cluster_rep_id").cast("string")), F.concat(F.lit("a"), F.col("id").cast("string"))))
    newest = [F.desc("first_seen_at"), F.desc("id")]
    leads = rows.where("open").withColumn("n", F.row_number().over(Window.partitionBy("story").orderBy(*newest))).where("n = 1")
    if cap <= SMALL_CAP:  # the winners are one TakeOrdered and need no ordering of all leaders
        ranked = leads.orderBy(*newest).limit(cap).withColumn("rank", F.row_number().over(Window.orderBy(*newest)))
    else:
        ranked = running_sums(leads, [], newest, F.lit(1), "__before").withColumn("rank", F.col("__before") + 1)
    winners = ranked.crossJoin(F.broadcast(used)).where(F.col("rank") + F.col("used") <= cap).select("story", F.col("id").alias("lead_id"))  # used is one row
    out = rows.join(F.broadcast(winners) if cap <= SMALL_CAP else winners, "story", "left")  # at most cap rows
    outcome = (
        F.when(F.col("old"), "already_sent").when(F.col("live"), "cluster_dedup").when(F.col("id") == F.col("lead_id"), "sent")
        .when(F.col("lead_id").isNotNull(), "cluster_dedup").otherwise("hourly_cap")
    )
    return out.select("id", "cluster_rep_id", "first_seen_at", "reasons", outcome.alias("outcome"))


def alert_marks(out: DataFrame, as_of: Column) -> DataFrame:
    """What outcomes add to the ledger."""
    mark = lambda kind, key, cond: out.where(cond).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), as_of.alias("marked_at"))
    sent = F.col("outcome") == "sent"
    return mark("article", "id", sent | (F.col("outcome") == "cluster_dedup")).unionByName(mark("cluster", "cluster_rep_id", sent & F.col("cluster_rep_id").isNotNull())).unionByName(mark("sent", "id", sent))


def dispatch_alerts(articles: DataFrame, ledger: DataFrame, as_of: Column, cap: int = 50, p: AlertParams = AlertParams()) -> tuple[DataFrame, DataFrame]:
    """Outcomes, and the ledger after them: the marks that still count and the new ones."""
    out = alert_outcomes(articles, ledger, as_of, cap, p)
    return out, live_marks(ledger, as_of).unionByName(alert_marks(out, as_of))


def dispatch_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def _signal(label: str, score: str) -> Column:
    text = F.format_string("%+.2f", F.col(score))
    return F.when(F.col(score).isNull(), F.col(label)).when(F.col(label).isNull(), text).otherwise(F.concat(F.col(label), F.lit(" ("), text, F.lit(")")))


def alert_payloads(df: DataFrame) -> DataFrame:
    """``(id, payload)``: the alert as JSON. Sending is the caller's: hand it rows in ``foreachBatch``."""
    own = lambda c: blank_to_null(strip(F.col(c)))
    en = F.lower(F.coalesce("language", F.lit(""))) == "en"
    title = F.coalesce(blank_to_null(F.col("title")), F.lit("(제목 없음)"))
    badge = F.lit(None).cast("string")
    for reason, text in reversed(BADGES):
        badge = F.when(F.array_contains("reasons", reason), text).otherwise(badge)
    head = F.when(en & (own("translated_title") != title), F.concat(F.lit("**🌐 "), own("translated_title"), F.lit("**")))
    body = F.coalesce(F.when(en, own("translated_summary")), own("ai_summary"), own("summary"))
    local, llm = _signal("sentiment_label", "sentiment"), _signal("llm_sentiment_label", "llm_sentiment")
    both = F.coalesce(F.concat(F.lit("🧠 Local: "), local, F.lit("\n☁️ LLM:   "), llm), local, F.concat(F.lit("☁️ LLM: "), llm))
    tags = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, TAGS), ", "))
    field = lambda name, value, inline: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline")))
    english = F.when(en & ~own("ai_summary").eqNullSafe(own("translated_summary")), truncate(own("ai_summary"), 1024))
    link = F.concat(F.lit("[🔗 원문 보기]("), F.col("url"), F.lit(")"))
    fields = F.array_compact(F.array(
        field("🇺🇸 English AI Summary", english, False), field("💹 Tickers", tags("tickers"), True), field("🏷️ Sectors", tags("sectors"), True),
        field("감성", both, True), field("링크", link, False),
    ))
    color = F.when(F.col("sentiment_label") == "positive", COLORS["positive"]).when(F.col("sentiment_label") == "negative", COLORS["negative"]).otherwise(NEUTRAL_COLOR)
    foot = F.concat_ws("  ·  ", blank_to_null(F.col("source_type")), blank_to_null(F.col("language")), blank_to_null(F.array_join("reasons", "/")))
    payload = F.struct(
        F.concat(F.coalesce(badge, F.lit("📰")), F.lit(" · "), truncate(title, 200)).alias("title"), color.alias("color"),
        blank_to_null(truncate(F.concat_ws("\n\n", head, body), 1200)).alias("description"), F.col("url"), fields.alias("fields"),
        F.when(foot != "", F.struct(foot.alias("text"))).alias("footer"),
        F.date_format(F.coalesce("published_at", "last_seen_at"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
    )
    return df.select("id", F.to_json(payload).alias("payload"))
