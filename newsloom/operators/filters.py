"""Optional predicates on articles. All are plain column expressions, so they reach the Parquet scan where its statistics can serve them."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.payload import is_breaking_payload
from newsloom.functions.score import contains_all

#: One collector names its source otherwise than the filter does.
SOURCE_NAMES = {"api": ("api", "newsapi"), "newsapi": ("api", "newsapi")}


@dataclass(frozen=True)
class ArticleFilter:
    source_type: str | None = None
    language: str | None = None
    sentiment_label: str | None = None
    llm_sentiment_label: str | None = None
    ticker: str | None = None
    sector: str | None = None
    date_from: str | None = None
    date_to: str | None = None


@dataclass(frozen=True)
class SearchFilter:
    source_type: str | None = None
    language: str | None = None
    sentiment_label: str | None = None
    tickers: list[str] = field(default_factory=list)
    sectors: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None


def effective_published() -> Column:
    return F.coalesce("published_at", "first_seen_at")


def representatives_only() -> Column:
    return F.col("cluster_rep_id").isNull() | (F.col("cluster_rep_id") == F.col("id"))


def _day(text: str | None) -> date | None:
    """An ISO date or time; anything else counts as not given."""
    try:
        return date.fromisoformat((text or "")[:10])
    except ValueError:
        return None


def _range(c: Column, low: str | None, high: str | None) -> list[Column]:
    out = []
    if day := _day(low):
        out.append(c >= F.lit(str(day)).cast("timestamp"))
    if day := _day(high):
        out.append(c < F.lit(str(day + timedelta(days=1))).cast("timestamp"))
    return out


def _equal(f, names) -> list[Column]:
    out = [F.col(n) == getattr(f, n) for n in names if getattr(f, n, None)]
    if f.source_type:
        out.append(F.col("source_type").isin(*SOURCE_NAMES.get(f.source_type, (f.source_type,))))
    return out


def article_predicates(f: ArticleFilter) -> list[Column]:
    out = _equal(f, ("language", "sentiment_label", "llm_sentiment_label"))
    out += [F.array_contains(c, v) for c, v in (("tickers", f.ticker), ("sectors", f.sector)) if v]
    return out + _range(effective_published(), f.date_from, f.date_to)


def search_predicates(f: SearchFilter) -> list[Column]:
    out = _equal(f, ("language", "sentiment_label"))
    out += [contains_all(F.col(c), v) for c, v in (("tickers", f.tickers), ("sectors", f.sectors)) if v]
    return out + _range(F.col("first_seen_at"), f.date_from, f.date_to)


def where_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def apply_filters(df: DataFrame, f: ArticleFilter) -> DataFrame:
    return where_all(df, article_predicates(f))


def search_filters(df: DataFrame, f: SearchFilter) -> DataFrame:
    return where_all(df, search_predicates(f))


def recent_window(df: DataFrame, column: str, n: int, unit: str, as_of: Column) -> DataFrame:
    seconds = {"minutes": 60, "hours": 3600, "days": 86400}[unit] * n
    return df.where(F.col(column) >= as_of - F.make_dt_interval(secs=F.lit(seconds)))


def pending_sentiment(df: DataFrame, limit: int = 200) -> DataFrame:
    return df.where("sentiment is null").orderBy(F.desc("first_seen_at"), F.desc("id")).limit(limit)


def enrichment_candidates(df: DataFrame, as_of: Column, limit: int = 100, languages=("en", "ko"), least: float = 0.05, attempts: int = 5, pause_min: int = 30) -> DataFrame:
    """Scored and not summarised, not given up on and not tried of late. A null language is left out."""
    last = F.col("llm_last_attempt_at")
    ready = (
        F.col("sentiment").isNotNull() & (F.abs("sentiment") >= least) & F.col("language").isin(*languages) & F.col("ai_summary").isNull()
        & (F.col("llm_enrich_attempts") < attempts) & (last.isNull() | (last < as_of - F.make_dt_interval(mins=F.lit(pause_min))))
    )
    return df.where(ready).orderBy(F.desc("first_seen_at"), F.desc("id")).limit(limit)


def thin_bodies(df: DataFrame) -> DataFrame:
    """The summary only repeats the title."""
    return df.where(F.col("title") == F.col("summary"))


def requeue_candidates(df: DataFrame, sources: list[str], min_len: int = 100) -> DataFrame:
    return df.where((F.length("summary") >= min_len) & F.col("source_url").isin(*sources))


def by_id(df: DataFrame, article_id: int) -> DataFrame:
    return df.where(F.col("id") == article_id)


def breaking_posts(df: DataFrame) -> DataFrame:
    """Articles whose payload (JSON text or variant) says so."""
    return df.where(is_breaking_payload(df))


def language_route(c: Column, known=("en", "ko")) -> Column:
    """Which scorer a row goes to; a null or empty language counts as English, an unknown one as other."""
    lang = F.coalesce(F.when(c != "", c), F.lit("en"))
    return F.when(lang.isin(*known), lang).otherwise("other")


def changed_rows(df: DataFrame, column: str, cleaned: Column) -> DataFrame:
    return df.withColumn("cleaned", cleaned).where(~F.col(column).eqNullSafe(F.col("cleaned")))
