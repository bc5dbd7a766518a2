"""Scores, vectors, tags and parsed model answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import norm_tickers, strip
from newsloom.schema import ENRICHMENT

#: The rounded base of the feed's decay, and the decay time of both in days.
FEED_E = 2.718281828
TAU_DAYS = 7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either is null; a zero vector gives 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).when(norm == 0, F.lit(0.0))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(1e6)


def recency(ts: Column, as_of: Column, tau_days: float = TAU_DAYS, clamp: bool = False, base: float | None = None) -> Column:
    """``exp(-age / tau)``: tau is a time constant. Unclamped, a time after ``as_of`` scores above 1."""
    age = age_seconds(ts, as_of)
    age = F.greatest(age, F.lit(0.0)) if clamp else age
    power = -age / F.lit(86400.0 * tau_days)
    return F.exp(power) if base is None else F.pow(F.lit(base), power)


def hybrid_score(fts: Column, cos: Column, recent: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    return F.lit(weights[0]) * fts + F.lit(weights[1]) * cos + F.lit(weights[2]) * recent


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def month_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def contains_all(c: Column, values: list[str]) -> Column:
    """All wanted tags present; a null array never matches, nothing wanted always does."""
    if not values:
        return F.lit(True)
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, values)), c)) == 0, F.lit(False)) & c.isNotNull()


def enrich_eligible(language: Column, sentiment: Column, languages=("en", "ko"), least: float = 0.05) -> Column:
    return F.coalesce(F.coalesce(language, F.lit("en")).isin(*languages) & (F.abs(sentiment) >= least), F.lit(False))


def label_of(score: Column, least: float = 0.2) -> Column:
    return F.when(score >= least, "positive").when(score <= -least, "negative").when(score.isNotNull(), "neutral")


def parse_enrichment(raw: Column) -> Column:
    """Struct of a model's JSON answer: the text itself, or else what its outermost braces hold; defaults where neither parses."""
    parsed = lambda c: F.from_json(c, ENRICHMENT)
    body = F.when(F.try_parse_json(strip(raw)).isNotNull(), strip(raw)).otherwise(F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    p = parsed(F.coalesce(body, F.lit("{}")))
    text = lambda k: F.coalesce(strip(p[k]), F.lit(""))
    names = lambda k: F.coalesce(F.from_json(p[k], "array<string>"), F.array().cast("array<string>"))
    value = p["sentiment"].try_cast("double")
    score = F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    label = F.lower(strip(F.coalesce(p["sentiment_label"], F.lit(""))))
    return F.struct(
        text("ai_summary").alias("ai_summary"), text("translated_title").alias("translated_title"), text("translated_summary").alias("translated_summary"),
        norm_tickers(names("tickers")).alias("tickers"),
        F.filter(F.transform(names("sectors"), strip), lambda s: F.coalesce(s != "", F.lit(False))).alias("sectors"),
        score.alias("sentiment"), F.when(label.isin("positive", "negative", "neutral"), label).otherwise(label_of(score)).alias("sentiment_label"),
    )


def parse_tag_metadata(raw: Column) -> Column:
    """Tickers and sectors of a JSON answer, or of its first brace block."""
    body = F.when(F.try_parse_json(strip(raw)).isNotNull(), strip(raw)).otherwise(F.regexp_extract(raw, r"(?s)\{.*?\}", 0))
    p = parse_enrichment(F.coalesce(body, F.lit("{}")))
    return F.struct(p["tickers"].alias("tickers"), p["sectors"].alias("sectors"))


def class_probs_to_sentiment(logits: Column, order: tuple[str, ...] = ("positive", "negative", "neutral")) -> Column:
    """Softmax of class scores: P(positive) - P(negative) to six places, the likeliest label and its probability; null gives 0, neutral, 1."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    p = lambda k: F.get(e, F.lit(order.index(k))) / total
    labels = F.array(*map(F.lit, order))
    empty = logits.isNull() | (F.size(logits) == 0)
    return F.struct(
        F.when(empty, 0.0).otherwise(F.round(p("positive") - p("negative"), 6)).alias("score"),
        F.when(empty, "neutral").otherwise(F.get(labels, (F.array_position(logits, top) - 1).cast("int"))).alias("label"),
        F.when(empty, 1.0).otherwise(F.array_max(e) / total).alias("confidence"),
    )
