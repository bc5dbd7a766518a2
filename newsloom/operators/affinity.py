"""What users lean to, from their signed feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each action, rows added to every user's count, and the two kinds' shares of a boost.
WEIGHTS = {"like": 1.0, "bookmark": 0.5, "dislike": -1.0, "dismiss": -0.3}
PRIOR = 5.0
SECTOR_SHARE, TICKER_SHARE, LIMIT = 0.6, 0.4, 0.5


def feedback_with_tags(feedback: DataFrame, articles: DataFrame) -> DataFrame:
    return feedback.join(articles.select(F.col("id").alias("news_id"), "tickers", "sectors"), "news_id")


def affinity_sums(feedback: DataFrame, articles: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``(user_id, kind, tag, sum, n)``: signed sums of a user's tags with their number of rows, and with an empty kind and tag the number of the user's rows of a known action, those without
    tags included. Sums of parts of a log add up to the sums of the log."""
    return signed_sums(feedback_with_tags(feedback, articles).withColumn("sign", F.lit(1)), weights)


def signed_sums(changes: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The same of ``changes(user_id, action, sign, tickers, sectors)``: rows with sign -1 take back what one with sign 1 added."""
    known = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    rows = changes.withColumn("weight", F.try_element_at(known, F.col("action"))).where("weight is not null")
    fold = lambda c: F.transform(c, lambda t: F.upper(t))
    tag = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tag")))
    named = F.filter(F.concat(tag("ticker", fold("tickers")), tag("sector", F.col("sectors"))), lambda t: t["tag"] != "")
    each = F.concat(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("tag"))), named)
    value = F.col("sign") * F.when(F.col("t.kind") == "", 1.0).otherwise(F.col("weight"))
    return rows.select("user_id", "weight", "sign", F.explode(each).alias("t")).groupBy("user_id", "t.kind", "t.tag").agg(F.sum(value).alias("sum"), F.sum("sign").alias("n"))


def affinity_scores(sums: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``(user_id, kind, tag, score)`` from sums that may come in parts."""
    whole = sums.groupBy("user_id", "kind", "tag").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).where("n > 0")  # not what was taken back
    total = whole.where("kind = ''").select("user_id", F.col("sum").alias("rows"))
    return whole.where("kind <> ''").join(total, "user_id").select("user_id", "kind", "tag", (F.col("sum") / (F.col("rows") + prior)).alias("score"))


def user_affinity(feedback: DataFrame, articles: DataFrame, weights: dict[str, float] = WEIGHTS, prior: float = PRIOR) -> DataFrame:
    """``(user_id, kind, tag, score)`` for all users: signed sums over the user's rows of a known action, those without tags included, plus ``prior``."""
    return affinity_scores(affinity_sums(feedback, articles, weights), prior)


def affinity_snapshot(affinity: DataFrame, k: int = 5) -> DataFrame:
    """The k best-liked and k least-liked tags of each kind."""
    by = Window.partitionBy("user_id", "kind")
    ranked = affinity.withColumn("up", F.row_number().over(by.orderBy(F.desc("score"), "tag"))).withColumn("down", F.row_number().over(by.orderBy("score", "tag")))
    return ranked.where((F.col("up") <= k) | (F.col("down") <= k))


def with_boost(df: DataFrame, affinity: DataFrame, user: str) -> DataFrame:
    """Adds ``boost``: the means of the article's tags' scores (unknown 0, repeats count), weighted and held within the limit; 0 without feedback."""
    own = affinity.where(F.col("user_id") == user)
    mean = lambda kind, column, fold: (
        df.select("id", F.explode(column).alias("raw")).select("id", fold(F.col("raw")).alias("tag"))
        .join(own.where(F.col("kind") == kind).select("tag", "score"), "tag", "left").groupBy("id").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias(kind))
    )
    out = df.join(mean("sector", "sectors", lambda c: c), "id", "left").join(mean("ticker", "tickers", F.upper), "id", "left")
    raw = SECTOR_SHARE * F.coalesce("sector", F.lit(0.0)) + TICKER_SHARE * F.coalesce("ticker", F.lit(0.0))
    return out.withColumn("boost", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), raw))).drop("sector", "ticker")
