import datetime as dt
import json

from pyspark.sql import functions as F

from newsloom import schema
from newsloom.sources import records as R

NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


def load(spark, kind, *objects):
    rows = [(json.dumps(o),) for o in objects]
    return spark.createDataFrame(rows, "j string").select(F.from_json("j", kind).alias("r")).select("r.*")


def test_feed_entries(spark):
    e = load(
        spark, schema.FEED_ENTRY,
        {"title": "<b>A</b> &amp; B", "link": "", "links": [{"href": None}, {"href": " http://l "}], "summary": "", "description": "d <i>x</i>", "published": "Wed, 31 Jan 2024 12:00:00 GMT", "tags": [{"term": "$AAPL"}, {"term": "news"}], "feed_url": "f"},
        {"title": "<p></p>", "link": "u", "feed_url": "f"}, {"title": "no link", "feed_url": "f"}, {"title": "other feed", "link": "u2", "feed_url": "g"},
    )
    out = {r.url: r for r in R.normalize_feed_entries(e, spark.createDataFrame([("f", "ko")], "feed_url string, language string")).collect()}
    assert set(out) == {"http://l", "u2"} and out["u2"].language == "en" and out["u2"].tickers == []
    r = out["http://l"]
    assert (r.title, r.summary, r.published_at, r.tickers, r.language, r.source_type) == ("A & B", "d x", NOW, ["AAPL"], "ko", "rss")


def test_news_api(spark):
    a = {"title": " T ", "url": "u", "description": "[Removed]", "content": "c", "publishedAt": "2024-01-31T12:00:00Z", "source": {"id": "i", "name": ""}}
    n = load(spark, schema.NEWS_RESPONSE, {"status": "ok", "articles": [a, a | {"title": "[Removed]"}, a | {"url": " "}]}, {"status": "error", "articles": [a]})
    out = R.normalize_news_api(n).collect()
    assert [(r.title, r.summary, r.published_at, r.source_type) for r in out] == [("T", "c", NOW, "newsapi")] and json.loads(out[0].raw_data)["_source_name"] == "i"


def test_posts(spark):
    p = load(spark, schema.POST, {"id": 7, "text": " BREAKING: " + "x" * 120, "username": "Me", "entities": {"urls": [{"url": "s", "expanded_url": "e"}]}}, {"id": 8, "text": " ", "username": "Me"}, {"id": 9, "text": "hi", "lang": "ko", "username": "Me"})
    out = {r.url.rsplit("/", 1)[1]: r for r in R.normalize_posts(p).collect()}
    assert set(out) == {"7", "9"} and out["9"].language == "ko" and out["7"].language == "en" and len(out["7"].title) == 101
    x = json.loads(out["7"].raw_data)["x"]
    assert x["breaking"] is True and x["linked_url"] == "e" and x["tweet_id"] == 7


def test_channel_posts(spark):
    thumbs = lambda *u: {"image": {"thumbnails": [{"url": x} for x in u]}}
    p = load(
        spark, schema.CHANNEL_POST,
        {"postId": "p1", "contentText": {"runs": [{"text": "🚨 short\n"}, {"text": "and a longer second line"}]}, "publishedTimeText": {"runs": [{"text": "2시간 전"}]}, "voteCount": {"accessibility": {"accessibilityData": {"label": "1,024 votes"}}},
         "backstageAttachment": {"postMultiImageRenderer": {"images": [{"backstageImageRenderer": thumbs("a", "b")}, {"backstageImageRenderer": thumbs()}]}}, "handle": "h"},
        {"postId": "p2", "contentText": {"runs": [{"text": "a first line that is long enough\nmore"}]}, "backstageAttachment": {"backstageImageRenderer": thumbs("z")}, "handle": "h"}, {"postId": "p3", "contentText": {"runs": [{"text": " "}]}}, {"contentText": {"runs": [{"text": "no id"}]}},
    )
    out = {r.url[-2:]: r for r in R.normalize_channel_posts(p, F.lit("2024-01-31 12:00:00").cast("timestamp")).collect()}
    assert set(out) == {"p1", "p2"} and out["p1"].title == "🚨 short\nand a longer second line" and out["p2"].title == "a first line that is long enough" and out["p1"].published_at == NOW - dt.timedelta(hours=2) and out["p2"].published_at is None
    y = json.loads(out["p1"].raw_data)["youtube"]
    assert y["category"] == "breaking" and y["vote_count"] == 1024 and y["image_urls"] == ["b"]
    assert json.loads(out["p2"].raw_data)["youtube"]["image_urls"] == ["z"]


def test_pages(spark):
    body = "<p>This is a page with enough of a body to be taken in.</p>"
    rows = [("u1", None, 200, "text/html", f"<html lang='en-GB'><title>A title of some length</title>{body}"), ("u2", "u2/login", 200, "text/html", body), ("u3", None, 200, "image/png", ""), ("u4", None, 404, "text/html", body), ("u5", None, None, None, "<p>thin</p>"), ("u6", None, 200, "text/html", None)]
    out = {r.url: r for r in R.ingest_pages(spark.createDataFrame(rows, schema.PAGE), F.lit("2024-01-31 12:00:00").cast("timestamp")).collect()}
    assert {u: r.status for u, r in out.items()} == {"u1": "ok", "u2/login": "login_required", "u3": "unsupported", "u4": "error", "u5": "error", "u6": "error"}
    assert (out["u1"].title, out["u1"].language, out["u1"].published_at) == ("A title of some length", "en", NOW) and out["u4"].title is None


def test_union_variant_and_view(spark):
    a = spark.createDataFrame([(1, '{"a": {"b": 2}}'), (2, "{}"), (3, "plain \"text\""), (4, None)], "id long, raw_data string")
    out = R.raw_to_variant(a, "raw_data")
    got = {r.id: r.v for r in out.select("id", F.to_json("raw_data").alias("v")).collect()}
    assert json.loads(got[1]) == {"a": {"b": 2}} and got[2] is None and got[4] is None and json.loads(got[3]) == 'plain "text"'
    s = R.raw_to_variant(a.select("id", F.struct("id").alias("raw_data")), "raw_data")
    assert s.where("variant_get(raw_data, '$.id', 'long') = 3").count() == 1
    assert R.article_view(a).columns == ["id"]
    assert R.union_sources(a, a.select("id")).count() == 8


def test_readers(spark, tmp_path):
    spark.createDataFrame([(2, "b", "sb", None, None), (1, "a", "sa", None, None)], schema.TOPIC).write.parquet(str(tmp_path / "t"))
    assert [r.name for r in R.read_topics(spark, str(tmp_path / "t")).collect()] == ["a", "b"]
    spark.createDataFrame([], schema.ARTICLE).write.parquet(str(tmp_path / "a"))
    assert R.read_articles(spark, str(tmp_path / "a")).count() == 0
    spark.createDataFrame([(1, "u", 2, "like", NOW)], schema.FEEDBACK).write.parquet(str(tmp_path / "f"))
    assert R.read_feedback(spark, str(tmp_path / "f")).count() == 1 and R.read_feedback(spark, str(tmp_path / "f"), stream=True).isStreaming


def test_payload_fields_of_text_and_variant(spark):
    from newsloom.functions.payload import is_breaking_payload, payload_field, payload_schema
    from newsloom.sources.records import raw_to_variant

    rows = [(1, '{"x": {"breaking": true, "n": 5}}'), (2, '{"youtube": {"category": "breaking"}}'), (3, '{"x": {"breaking": "maybe", "n": "7"}}'), (4, None), (5, ""), (6, "no json"), (7, '{"x": 3}')]
    df = spark.createDataFrame(rows, "id long, raw_data string")
    for kind in (df, raw_to_variant(df, "raw_data")):
        out = {r.id: (r.b, r.n) for r in kind.select("id", is_breaking_payload(kind).alias("b"), payload_field(kind, "raw_data", "$.x.n", "long").alias("n")).collect()}
        assert out == {1: (True, 5), 2: (True, None), 3: (False, 7), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None)}
    schema = payload_schema(raw_to_variant(df.where("id < 3"), "raw_data")).first().schema
    assert "breaking: BOOLEAN" in schema and "category: STRING" in schema


def test_a_cut_reference_of_a_page_stays(spark):
    """Text, length and title are of the body with only ended references decoded, as in SQL."""
    html = "<html lang='en'><h1>A heading of some length &amp</h1><p>and a text that goes on, here &amp; there</p></html>"
    row = dict.fromkeys(schema.PAGE.fieldNames()) | {"url": "u", "html": html, "http_status": 200}
    page = spark.createDataFrame([tuple(row[f] for f in schema.PAGE.fieldNames())], schema.PAGE)
    r = R.ingest_pages(page, F.lit("2024-01-31 12:00:00").cast("timestamp")).first()
    body = "A heading of some length &amp\nand a text that goes on, here & there"
    assert (r.status, r.summary, r.extracted_len, r.title) == ("ok", body, len(body), "A heading of some length &amp")
