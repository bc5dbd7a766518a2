"""Schemas of the tables that the operators read and write."""

from pyspark.sql import types as T

L, S, D, I, TS = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampType()
STRINGS = T.ArrayType(S)


def _struct(**columns) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


ARTICLE = _struct(
    id=L, topic_id=L, title=S, summary=S, url=S, source_url=S, published_at=TS, first_seen_at=TS, last_seen_at=TS, hit_count=I,
    sentiment=D, sentiment_label=S, llm_sentiment=D, llm_sentiment_label=S, source_type=S, language=S, translated_title=S,
    translated_summary=S, ai_summary=S, llm_enrich_attempts=I, llm_last_attempt_at=TS, tickers=STRINGS, sectors=STRINGS,
    embedding=T.ArrayType(T.FloatType()), cluster_rep_id=L, cluster_size=I, similarity_to_rep=D, raw_data=S, created_at=TS, updated_at=TS,
)
#: What every source's normaliser gives.
RECORD = _struct(title=S, url=S, source_url=S, source_type=S, language=S, summary=S, published_at=TS, tickers=STRINGS, sectors=STRINGS, raw_data=S)
TOPIC = _struct(id=L, name=S, slug=S, description=S, created_at=TS)
FEEDBACK = _struct(id=L, user_id=S, news_id=L, action=S, created_at=TS)
LEDGER = _struct(kind=S, key=L, marked_at=TS)

_NAMED_URL = _struct(url=S, expanded_url=S)
FEED_ENTRY = _struct(title=S, link=S, links=T.ArrayType(_struct(href=S)), summary=S, description=S, published=S, updated=S, tags=T.ArrayType(_struct(term=S)), feed_url=S)
NEWS_RESPONSE = _struct(status=S, code=S, message=S, articles=T.ArrayType(_struct(title=S, url=S, description=S, content=S, publishedAt=S, source=_struct(id=S, name=S))))
POST = _struct(id=L, text=S, created_at=TS, lang=S, entities=_struct(urls=T.ArrayType(_NAMED_URL)), username=S)
_IMAGE = _struct(image=_struct(thumbnails=T.ArrayType(_struct(url=S))))
_RUNS = T.ArrayType(_struct(text=S))
CHANNEL_POST = _struct(
    postId=S, contentText=_struct(runs=_RUNS), publishedTimeText=_struct(runs=_RUNS, simpleText=S),
    voteCount=_struct(accessibility=_struct(accessibilityData=_struct(label=S))),
    backstageAttachment=_struct(backstageImageRenderer=_IMAGE, postMultiImageRenderer=_struct(images=T.ArrayType(_struct(backstageImageRenderer=_IMAGE)))), handle=S,
)
PAGE = _struct(url=S, final_url=S, http_status=I, content_type=S, html=S)
ENRICHMENT = _struct(ai_summary=S, translated_title=S, translated_summary=S, tickers=S, sectors=S, sentiment=S, sentiment_label=S)

ACTIONS = ("bookmark", "like", "dislike", "dismiss")
LABELS = ("positive", "negative", "neutral")
LANGUAGES = ("en", "ko")
