import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom import schema
from newsloom.operators import affinity as A
from newsloom.operators import alerts as AL
from newsloom.operators import cluster as C
from newsloom.operators import dedup as D
from newsloom.operators import feed as FE
from newsloom.operators import filters as FI
from newsloom.operators import quality as Q
from newsloom.operators import scoring as SC
from newsloom.operators import search as SE
from newsloom.operators.components import connected_components

NOW = dt.datetime(2024, 1, 31, 12, 0, 0)
AGO = lambda **kw: NOW - dt.timedelta(**kw)


def as_of():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


def articles(spark, *rows):
    """Rows given by what matters; all else null or a plain default."""
    base = {f.name: None for f in schema.ARTICLE} | {"first_seen_at": NOW, "last_seen_at": NOW, "cluster_size": 1, "hit_count": 1, "llm_enrich_attempts": 0}
    full = []
    for i, r in enumerate(rows):
        x = base | {"id": i + 1, "title": f"t{i + 1}", "url": f"u{i + 1}"} | r
        full.append(tuple(x[f.name] for f in schema.ARTICLE))
    return spark.createDataFrame(full, schema.ARTICLE)


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


# ---- components --------------------------------------------------------------------------------------------------------------


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("nodes, edges", [
    (range(50), [(i, i + 1) for i in range(49)]), (range(40), [(0, i) for i in range(1, 40)]), (range(10), [(0, 1), (2, 3), (1, 2), (5, 5), (7, 8), (8, 7), (7, 8)]), ([3], []),
    (range(120), [(a, b) for r in [random.Random(5)] for a, b in ((r.randrange(120), r.randrange(120)) for _ in range(90))]),
])
def test_components(spark, nodes, edges):
    v = spark.createDataFrame([(n,) for n in nodes], "id long")
    e = spark.createDataFrame(edges, "u long, v long")
    assert {r.id: r.component for r in connected_components(v, e).collect()} == brute_components(nodes, edges)


# ---- filters and feeds -------------------------------------------------------------------------------------------------------


def test_filters(spark):
    a = articles(
        spark, {"language": "en", "tickers": ["AAPL", "X"], "published_at": dt.datetime(2024, 1, 2, 23, 59)}, {"language": None, "tickers": None, "first_seen_at": dt.datetime(2024, 1, 3)},
        {"source_type": "newsapi", "tickers": ["aapl"]}, {"source_type": "api", "cluster_rep_id": 4}, {"cluster_rep_id": 4},
    )
    f = lambda **kw: sorted(ids(FI.apply_filters(a, FI.ArticleFilter(**kw))))
    assert f(ticker="AAPL") == [1] and f(source_type="api") == [3, 4] and f(date_to="2024-01-02") == [1] and f(date_from="2024-01-03", date_to="2024-01-03") == [2] and f(date_from="soon") == [1, 2, 3, 4, 5]
    assert ids(FI.search_filters(a, FI.SearchFilter(tickers=["X", "AAPL"]))) == [1]
    assert sorted(ids(a.where(FI.representatives_only()))) == [1, 2, 3, 4]
    routes = [r[0] for r in a.select(FI.language_route(F.col("language"))).collect()]
    assert routes == ["en"] * 5


def test_work_queues(spark):
    a = articles(
        spark, {"sentiment": 0.05, "language": "en"}, {"sentiment": 0.04, "language": "en"}, {"sentiment": -0.9, "language": None}, {"sentiment": 0.9, "language": "ko", "llm_enrich_attempts": 5},
        {"sentiment": 0.9, "language": "ko", "llm_last_attempt_at": AGO(minutes=29)}, {"sentiment": 0.9, "language": "ko", "llm_last_attempt_at": AGO(minutes=31)}, {"sentiment": 0.9, "language": "en", "ai_summary": ""}, {},
    )
    assert sorted(ids(FI.enrichment_candidates(a, as_of()))) == [1, 6] and ids(FI.pending_sentiment(a)) == [8]
    claimed, stamped = SC.claim_pending(a, as_of())
    assert sorted(ids(claimed)) == [1, 6] and sorted(ids(FI.enrichment_candidates(stamped, as_of()))) == []


def test_feed_sorts_and_pages(spark):
    a = articles(
        spark, {"published_at": AGO(hours=1), "sentiment": -0.9}, {"published_at": AGO(hours=2), "cluster_size": 5, "cluster_rep_id": 2, "sentiment": 0.1}, {"cluster_rep_id": 2, "cluster_size": 5},
        {"published_at": AGO(hours=1), "sentiment": None}, {"published_at": AGO(days=1), "sentiment": 0.5},
    )
    fb = spark.createDataFrame([(1, "u", 5, "dismiss", NOW), (2, "v", 1, "dismiss", NOW)], schema.FEEDBACK)
    get = lambda sort, **kw: ids(FE.feed(a, sort, **({"user": "u", "feedback": fb} | kw)))
    assert get("latest") == [4, 1, 2] == get("no such sort") and get("cluster_size") == [2, 4, 1] and get("sentiment_strength") == [1, 2, 4]
    assert get("latest", dedup=False) == [3, 4, 1, 2] and get("latest", hide_dismissed=False) == [4, 1, 2, 5] and get("latest", page=2, size=2) == [2] and get("latest", page=9) == []
    s = articles(spark, {"cluster_rep_id": 2, "similarity_to_rep": 0.9}, {"cluster_rep_id": 2, "similarity_to_rep": 1.0}, {"cluster_rep_id": 2}, {})
    assert ids(FE.cluster_siblings(s, 1)) == [2, 1, 3] and ids(FE.cluster_siblings(s, 4)) == [4]
    states = {r.id: r.actions for r in FE.feedback_states(fb, spark.createDataFrame([(5,), (1,)], "id long"), "u").collect()}
    assert states == {5: ["dismiss"], 1: []}


def test_personal_feed(spark):
    a = articles(spark, {"published_at": AGO(hours=1), "sectors": ["bad"]}, {"published_at": AGO(hours=2), "sectors": ["good", "none"], "tickers": ["aapl"]}, {"published_at": NOW + dt.timedelta(hours=5)})
    fb = spark.createDataFrame([(1, "u", 2, "like", NOW), (2, "u", 1, "dislike", NOW), (3, "u", 3, "bookmark", NOW), (4, "u", 3, "view", NOW)], schema.FEEDBACK)
    aff = A.user_affinity(fb, a)
    assert {(r.kind, r.tag): round(r.score, 6) for r in aff.collect()} == {("sector", "good"): 0.125, ("sector", "none"): 0.125, ("ticker", "AAPL"): 0.125, ("sector", "bad"): -0.125}
    boost = {r.id: round(r.boost, 6) for r in A.with_boost(a, aff, "u").collect()}
    assert boost == {1: -0.075, 2: 0.125, 3: 0.0} and {r.boost for r in A.with_boost(a, aff, "nobody").collect()} == {0.0}
    assert ids(FE.feed(a, "personalized", affinity=aff, user="u", as_of=as_of())) == [2, 3, 1]


def test_summary(spark):
    a = articles(spark, {"sentiment_label": "positive", "tickers": ["a", "", "A"], "ai_summary": ""}, {"sentiment_label": "odd", "tickers": [], "sectors": ["x"], "ai_summary": "s"}, {"first_seen_at": AGO(hours=25)})
    r = FE.feed_summary(a, 24, 3, as_of()).first()
    assert (r.total, r.with_tickers, r.with_sectors, r.enriched, r.positive, r.negative, r.neutral) == (2, 1, 1, 1, 1, 0, 0)
    assert r.top_tickers == [Row(name="A", n=2)] and r.top_sectors == [Row(name="x", n=1)]
    empty = FE.feed_summary(a.limit(0), 24, 3, as_of()).first()
    assert empty.total == 0 and empty.top_tickers == []


# ---- duplicates and state ----------------------------------------------------------------------------------------------------


def test_upsert(spark):
    have = articles(spark, {"url": "a", "title": "old"}, {"url": "b"})
    batch = spark.createDataFrame([(1, "a", "new"), (2, "a", "newer"), (3, "c", "first"), (4, "c", "second"), (5, "d", "d")], "position int, url string, title string")
    out, counts = D.upsert_articles(have, batch, as_of())
    got = {r.url: (r.id, r.title, r.hit_count, r.last_seen_at) for r in out.collect()}
    assert got["a"] == (1, "old", 2, NOW) and got["b"][2] == 1 and got["c"][1:3] == ("first", 1) and {got["c"][0], got["d"][0]} == {3, 4} and out.count() == 4
    assert tuple(counts.first()) == (2, 2) and out.schema == have.schema
    again, counts = D.upsert_articles(out, batch.limit(0), as_of())
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect())) and tuple(counts.first()) == (0, 0)


def test_feedback_log(spark):
    log = [(1, "like", "add"), (2, "like", "add"), (3, "bookmark", "add"), (4, "dislike", "add"), (5, "like", "delete"), (6, "dismiss", "delete"), (7, "view", "add"), (8, "bookmark", "delete"), (9, "bookmark", "add")]
    e = spark.createDataFrame([(i, "u", 1, a, op) for i, a, op in log], "id long, user_id string, news_id long, action string, op string")
    assert sorted(ids(D.current_feedback(e), "action")) == ["bookmark", "dislike"]


def test_posts_state(spark):
    posts = spark.createDataFrame([(10, "A", None), (11, "a", "u1"), (5, "B", "u9"), (6, "c", None)], "id long, username string, linked_url string")
    since = spark.createDataFrame([("a", 10), ("b", 7)], "username string, since_id long")
    assert sorted(ids(D.newer_than_since_id(posts, since))) == [6, 11]
    assert {tuple(r) for r in D.latest_post_id(posts, since).collect()} == {("a", 11), ("b", 7), ("c", 6)}
    assert sorted(ids(D.drop_linked_duplicates(posts, articles(spark, {"url": "u1"})))) == [5, 6, 10]


def test_enrichment_results(spark):
    a = articles(spark, {"ai_summary": "keep", "tickers": ["T"]}, {"tickers": []}, {})
    r = spark.createDataFrame([(1, "", "", "", ["N"], ["s"], 0.0, "neutral"), (2, "new", "", "", ["N"], [], None, None)], "id long, ai_summary string, translated_title string, translated_summary string, tickers array<string>, sectors array<string>, sentiment double, sentiment_label string")
    got = {x.id: (x.ai_summary, x.tickers, x.sectors, x.llm_sentiment) for x in D.apply_enrichment(a, r).collect()}
    assert got == {1: ("keep", ["T"], ["s"], 0.0), 2: ("new", ["N"], None, None), 3: (None, None, None, None)}


# ---- stories -----------------------------------------------------------------------------------------------------------------


def test_edge_reasons(spark):
    text = {"language": "en", "title": "Fed raises rates again", "summary": "one two three four five"}
    a = articles(spark, text, text | {"tickers": ["A"]}, text | {"tickers": ["b"]}, text | {"title": "other words here"}, text | {"title": "Fed raises something quite else entirely today"}, text | {"summary": "six seven eight nine"}, text | {"language": "ko"}, text | {"language": None}, text | {"language": None, "summary": " ", "ai_summary": "x y"})
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.99), (1, 1, 0.84), (1, 4, 0.9), (4, 5, 0.9), (1, 6, 0.9), (1, 7, 0.81), (8, 9, 0.9), (8, 8, 0.82)], "a_id long, b_id long, sim double")
    got = {(r.a_id, r.b_id): r.reason for r in C.edge_verdicts(edges, a).collect()}
    assert got == {(1, 2): None, (2, 3): "ticker_conflict", (1, 1): "cosine_below_same_lang", (1, 4): "overlap_count", (4, 5): "overlap_count", (1, 6): "body_jaccard", (1, 7): None, (8, 9): None, (8, 8): "cosine_below_same_lang"}
    ratio = {r.reason for r in C.edge_verdicts(spark.createDataFrame([(1, 5, 0.9)], "a_id long, b_id long, sim double"), a, C.ClusterParams(min_ratio=0.6)).collect()}
    assert ratio == {"overlap_ratio"}


def test_knn_is_exact_over_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 8))
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<float>")
    n = m.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    s = n @ n.T
    want = set()
    for i in range(90):
        best = sorted(((-s[i, j], j) for j in range(i + 1, 90) if s[i, j] >= 0.3))[:3]
        want |= {(i, j) for _, j in best}
    for block in (1000, 20):
        got = {(r.a_id, r.b_id) for r in C.knn_edges(v, 0.3, 3, block).collect()}
        assert got == want


def test_stories(spark):
    e1, e2 = [1.0, 0.0], [0.0, 1.0]
    t = {"language": "en", "title": "big bank merger news"}
    a = articles(spark, t | {"embedding": e1, "last_seen_at": AGO(hours=3)}, t | {"embedding": e1, "last_seen_at": AGO(hours=1)}, t | {"embedding": e1, "last_seen_at": AGO(hours=1)}, t | {"embedding": e2}, t | {"embedding": e1, "last_seen_at": AGO(days=8), "cluster_size": 9}, t)
    got = {r.id: (r.cluster_rep_id, r.cluster_size, r.similarity_to_rep) for r in C.cluster_articles(a, as_of()).collect()}
    assert got == {1: (3, 3, 1.0), 2: (3, 3, 1.0), 3: (3, 3, 1.0), 4: (None, 1, None)}
    done = {r.id: (r.cluster_rep_id, r.cluster_size) for r in C.apply_assignments(a, C.cluster_articles(a, as_of())).collect()}
    assert done[5] == (None, 9) and done[6] == (None, 1) and done[1] == (3, 3)


# ---- search ------------------------------------------------------------------------------------------------------------------


def test_query_groups(spark):
    lex = spark.createDataFrame([("fed", ["FOMC", "fed"]), ("s&p", ["spx"])], "token string, synonyms array<string>")
    q = spark.createDataFrame([(1, " Fed s&p "), (2, ""), (3, "?!"), (4, None)], "query_id long, text string")
    got = {(r.query_id, r.group_no): (r.terms, r.expanded) for r in SE.expand_queries(q, lex).collect()}
    assert got == {(1, 0): (["fed", "fomc"], True), (1, 1): (["s"], False), (1, 2): (["p"], False)}


def test_covers():
    a = [(1, 0, "A"), (4, 1, "A")]
    assert SE.covers(a, 2) == pytest.approx(2 / 2 / (1 + 2))  # two places between are filled by no group
    assert SE.covers([(1, 0, "C"), (2, 1, "B")], 2) == pytest.approx(2 / (1 / 0.2 + 1 / 0.4))
    assert SE.covers([(1, 0, "A"), (2, 0, "A")], 2) == 0 and SE.covers([(1, 0, "A"), (3, 0, "B")], 1) == pytest.approx(1.4)
    assert SE.covers([(1, 0, "A"), (2, 1, "A"), (3, 0, "A")], 2) == pytest.approx(2.0)


def test_hybrid(spark):
    a = articles(
        spark, {"title": "Fed hikes", "language": "en"}, {"title": "other", "summary": "fed fed", "language": "ko"}, {"title": "near", "embedding": [1.0, 0.1], "language": "en"}, {"title": "far", "embedding": [0.0, 1.0]},
        {"title": "fomc", "last_seen_at": NOW + dt.timedelta(days=7), "language": "en"},
    )
    q = spark.createDataFrame([(1, "fed", [1.0, 0.0])], "query_id long, text string, vector array<float>")
    lex = spark.createDataFrame([("fed", ["fomc"])], "token string, synonyms array<string>")
    run = lambda **kw: SE.hybrid_search(a, SE.search_postings(a), q, lex, as_of(), **kw).orderBy("position").collect()
    rows = run()
    assert {r.id for r in rows} == {1, 2, 3, 5} and all(r.total == 4 for r in rows)
    by = {r.id: r for r in rows}
    assert by[5].recency == pytest.approx(2.718281828) and by[5].fts_score == 1.0 and by[3].fts_score == 0 and by[3].cos_score > 0.99 and by[1].cos_score == 0
    en = {r.id: r for r in run(filters=FI.SearchFilter(language="ko"))}
    assert en[2].fts_score == 1.0 and by[2].fts_score < 1.0  # the maximum is taken after the filters
    assert run(page=9) == [] and [r.id for r in run(size=2, page=2)] == [r.id for r in rows[2:]]


# ---- alerts ------------------------------------------------------------------------------------------------------------------


def test_triggers(spark):
    p = AL.AlertParams(watch=("aapl",))
    base = {"cluster_size": 3, "sectors": ["s"], "sentiment": 0.7, "language": "ko"}
    a = articles(
        spark, base, base | {"cluster_size": 2}, base | {"cluster_size": 2, "language": "en"}, base | {"cluster_size": 50}, base | {"sectors": []}, base | {"llm_sentiment": -0.75}, base | {"llm_sentiment": -0.8}, base | {"sentiment": 0.1, "llm_sentiment": 0.8},
        base | {"sentiment": None, "llm_sentiment": 0.7}, {"raw_data": '{"x": {"breaking": true}}', "tickers": ["Aapl"], "sentiment": 0.3}, {"raw_data": '{"youtube": {"category": "breaking"}}'}, base | {"sentiment": 0.7, "llm_sentiment": 0.0}, {"tickers": ["AAPL"], "sentiment": 0.29},
    )
    got = {r.id: r.reasons for r in AL.evaluate_triggers(a, p).collect()}
    s = ["strong_sentiment"]
    assert got == {1: s, 2: [], 3: s, 4: [], 5: [], 6: [], 7: s, 8: s, 9: [], 10: ["breaking", "ticker_watch"], 11: ["breaking"], 12: [], 13: []}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dispatch_is_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [{"first_seen_at": AGO(minutes=rng.randrange(60)), "cluster_rep_id": rng.choice([None, 100, 101, 102, 103, 104]), "raw_data": '{"x": {"breaking": true}}'} for _ in range(40)]
    ledger = [("article", 3, AGO(days=29)), ("article", 4, AGO(days=31)), ("cluster", 101, AGO(hours=23)), ("cluster", 102, AGO(hours=25)), ("sent", 1, NOW), ("sent", 2, AGO(hours=1))]
    cap = rng.randrange(2, 12)
    sent_ids, clusters, used = {3}, {101}, 1
    want = {}
    for i, r in sorted(enumerate(rows, 1), key=lambda x: (x[1]["first_seen_at"], x[0]), reverse=True):
        c = r["cluster_rep_id"]
        if i in sent_ids:
            want[i] = "already_sent"
        elif c is not None and c in clusters:
            want[i] = "cluster_dedup"
        elif used >= cap:
            want[i] = "hourly_cap"
        else:
            want[i], used = "sent", used + 1
            clusters.add(c)
    out, after = AL.dispatch_alerts(articles(spark, *rows), spark.createDataFrame(ledger, schema.LEDGER), as_of(), cap)
    assert {r.id: r.outcome for r in out.collect()} == want
    marked = {r.key for r in after.where("kind = 'article'").collect()} - {3, 4}
    assert marked == {i for i, o in want.items() if o in ("sent", "cluster_dedup")} - {3, 4} or marked | {4} == {i for i, o in want.items() if o in ("sent", "cluster_dedup")} | {4}


def test_large_cap_ranks_leaders_without_one_task(spark, monkeypatch):
    rows = [{"first_seen_at": AGO(minutes=i % 50), "cluster_rep_id": i % 9 if i % 2 else None, "raw_data": '{"x": {"breaking": true}}', "cluster_size": 1} for i in range(60)]
    ledger = spark.createDataFrame([("sent", 1, NOW), ("sent", 2, AGO(hours=2)), ("article", 5, AGO(days=29)), ("article", 6, AGO(days=31)), ("cluster", 3, AGO(hours=25)), ("cluster", 5, AGO(hours=3))], schema.LEDGER)
    found = []
    for small in (10_000, 1):
        monkeypatch.setattr(AL, "SMALL_CAP", small)
        out, after = AL.dispatch_alerts(articles(spark, *rows), ledger, as_of(), 20)
        found.append(({(r.id, r.outcome) for r in out.collect()}, {tuple(r) for r in after.collect()}))
    assert found[0] == found[1] and sum(o == "sent" for _, o in found[0][0]) == 19
    assert ("article", 5, AGO(days=29)) in found[0][1]
    assert ("article", 6, AGO(days=31)) not in found[0][1] and ("cluster", 3, AGO(hours=25)) not in found[0][1] and ("sent", 2, AGO(hours=2)) not in found[0][1]


def test_index_forms_few_pairs():
    shares = [(lambda bits, bands: bands / 2**bits)(*C.index_shape(n, 0.8, 500, 0.97)) for n in (20_000, 100_000, 10**6, 10**8)]
    assert shares[1] <= 0.1 and shares == sorted(shares, reverse=True) and shares[3] < 0.005


def test_index_by_default_finds_what_comparing_all_does(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=24) * 0.35]) for i in range(1200)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    exact = {(r.a_id, r.b_id) for r in C.similar_pairs(v, 0.8, C.ClusterParams(knn=2000, block_rows=400)).collect()}
    monkeypatch.setattr(C, "INDEX_FROM", 1000)
    found = {(r.a_id, r.b_id) for r in C.similar_pairs(v, 0.8, C.ClusterParams(knn=2000, block_rows=400)).collect()}
    asked = {(r.a_id, r.b_id) for r in C.similar_pairs(v, 0.8, C.ClusterParams(knn=2000, block_rows=400, indexed=False)).collect()}
    assert asked == exact and found <= exact and len(found) >= 0.95 * len(exact) > 1000


def test_payload(spark):
    import json

    a = articles(spark, {"language": "en", "title": "T", "translated_title": "번역", "translated_summary": "요약", "ai_summary": "Sum", "sentiment": 0.5, "sentiment_label": "positive", "llm_sentiment": -0.25, "llm_sentiment_label": "negative", "tickers": [str(i) for i in range(12)], "source_type": "rss"}, {"title": None, "url": None, "summary": "s" * 1300})
    out = {r.id: json.loads(r.payload) for r in AL.alert_payloads(a.withColumn("reasons", F.array(F.lit("ticker_watch"), F.lit("breaking")))).collect()}
    assert out[1]["title"] == "🚨 BREAKING · T" and out[1]["description"] == "**🌐 번역**\n\n요약" and out[1]["color"] == 0x22C55E
    fields = {f["name"]: f["value"] for f in out[1]["fields"]}
    assert fields["감성"] == "🧠 Local: positive (+0.50)\n☁️ LLM:   negative (-0.25)" and fields["💹 Tickers"].count(",") == 9 and fields["🇺🇸 English AI Summary"] == "Sum"
    assert out[1]["footer"]["text"] == "rss  ·  en  ·  ticker_watch/breaking" and len(out[2]["description"]) == 1200 and "url" not in out[2]


# ---- models and repairs ------------------------------------------------------------------------------------------------------


def test_model_calls(spark):
    a = articles(spark, {"title": "strong gain", "language": "en"}, {"title": "  ", "language": "en"}, {"title": "loss", "language": "xx"}, {"title": "loss", "language": ""})
    got = {r.id: (r.score, r.label) for r in SC.score_batch(a.select("id", "title", "language"), {"en": SC.lexicon_scorer}).collect()}
    assert got == {1: (1.0, "positive"), 2: (0.0, "neutral"), 3: (0.0, "neutral"), 4: (-1.0, "negative")}

    def broken(texts):
        raise RuntimeError

    assert {r.label for r in SC.score_batch(a.select("id", "title", "language"), broken).collect()} == {"neutral"}
    e = {r.id: r.embedding for r in SC.embed_batch(a.select("id", "title"), SC.hashing_embedder(8), 8, "h", F.col("title")).collect()}
    assert e[2] == [0.0] * 8 and e[3] == e[4] and len(e[1]) == 8
    with pytest.raises(ValueError):
        SC.same_model(spark.createDataFrame([("a",)], "model_id string"), spark.createDataFrame([("b",)], "model_id string"))


def test_repairs(spark):
    a = articles(spark, {"cluster_rep_id": 2}, {"cluster_rep_id": 2}, {"published_at": AGO(days=1)})
    fb = spark.createDataFrame([(1, "u", 2, "like", NOW), (2, "u", 3, "odd", NOW), (3, "u", 3, "odd", NOW)], schema.FEEDBACK)
    left, kept = Q.cascade_delete(a, fb, spark.createDataFrame([(2,)], "id long"))
    assert {r.id: r.cluster_rep_id for r in left.collect()} == {1: None, 3: None} and sorted(ids(kept)) == [2, 3]
    rules = {r.rule: r.violations for r in Q.check_constraints(a, fb).collect()}
    assert rules["unique_feedback"] == 1 and rules["feedback_action"] == 2 and rules["unique_topic_url"] == 0
    b = {r.id: (r.published_at, r.first_seen_at) for r in Q.backfill_published(a).collect()}
    assert b[1] == (NOW, NOW) and b[3] == (AGO(days=1), AGO(days=1))
    c = articles(spark, {"title": "<b>x</b>", "source_url": "s"}, {"title": "x", "summary": "a &lt; b", "source_url": "s"}, {"title": "ok", "source_url": "s"}, {"title": "<b>", "ai_summary": "s", "source_url": "s"})
    assert {tuple(r) for r in Q.backfill_clean(c, as_of()).collect()} == {(1, "x", None), (2, "x", "a < b")}


def test_star_of_many_leaves(spark):
    n = 100_000
    leaves = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    chain = spark.range(n + 1, n + 12).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    out = connected_components(spark.range(n + 20), leaves.union(chain))
    got = {r.component: r.n for r in out.groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got[0] == n + 1 and got[n + 1] == 12 and sum(got.values()) == n + 20


def test_knn_of_copies_leaves_k_an_article(spark):
    rng = random.Random(5)
    rows = [(i, [1.0, 0.0, i * 1e-4]) for i in range(60)] + [(100 + i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    sim = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    want = set()
    for i, a in rows:
        near = sorted((-round(s, 12), j) for j, b in rows if j > i and (s := sim(a, b)) >= 0.5)
        want |= {(i, j) for _, j in near[:4]}
    for block in (1000, 30):
        got = {(r.a_id, r.b_id): r.sim for r in C.knn_edges(v, 0.5, 4, block).collect()}
        assert len(got) == len(want) and {a for a, _ in got} == {a for a, _ in want}
        by = {i: sorted(s for (a, _), s in got.items() if a == i) for i in {a for a, _ in want}}
        vec = dict(rows)
        assert all(by[i] == pytest.approx(sorted(sim(vec[i], vec[j]) for a, j in want if a == i)) for i in by)


def test_cover_density_rank_by_all_minimal_windows(spark):
    rng = random.Random(2)
    weight = {"A": 1.0, "B": 0.4, "C": 0.2}
    hits, want = [], {}
    for q in range(4):
        groups = rng.randrange(2, 4)
        for i in range(25):
            n = rng.randrange(20, 60)
            rows = sorted({(p, rng.randrange(groups), rng.choice("ABC")) for p in rng.sample(range(1, n), rng.randrange(groups, 14))})
            if len({g for _, g, _ in rows}) < groups:
                continue
            total = 0.0
            full = lambda part: len({g for _, g, _ in part}) == groups  # noqa: E731,B023
            for a in range(len(rows)):
                for b in range(a, len(rows)):
                    part = rows[a : b + 1]
                    if full(part) and not full(part[1:]) and not full(part[:-1]):
                        total += len(part) / sum(1 / weight[w] for _, _, w in part) / (1 + part[-1][0] - part[0][0] - len(part) + 1)
            want[q, i] = total / (1 + math.log(n))
            hits += [(q, i, g, p, w, n, groups) for p, g, w in rows for _ in range(rng.randrange(1, 3))]
    df = spark.createDataFrame(hits, "query_id long, id long, group_no int, pos int, weight string, n_pos int, n_groups long")
    got = {(r.query_id, r.id): r.fts_raw for r in SE.cover_density_rank(df).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_postings_follow_a_write(spark):
    a = articles(spark, {"title": "one two", "summary": "three"}, {"title": "four", "summary": "five six"})
    p = SE.search_postings(a)
    changed = articles(spark, {"title": "seven", "summary": "eight two"})
    got = {(r.id, r.term, r.pos, r.weight, r.n_pos) for r in SE.renewed_postings(p, changed).collect()}
    assert got == {(1, "seven", 1, "A", 3), (1, "eight", 2, "B", 3), (1, "two", 3, "B", 3), (2, "four", 1, "A", 3), (2, "five", 2, "B", 3), (2, "six", 3, "B", 3)}
    assert {(r.id, r.term, r.n_pos) for r in SE.search_postings(a, stopwords=("two", "six")).collect()} == {(1, "one", 2), (1, "three", 2), (2, "four", 2), (2, "five", 2)}


def test_updated_at_follows_new_assignments(spark):
    a = articles(spark, {"updated_at": AGO(days=3)}, {"updated_at": AGO(days=3)}, {"updated_at": AGO(days=3)})
    new = spark.createDataFrame([(1, 2, 2, 0.9), (2, None, 1, None)], "id long, cluster_rep_id long, cluster_size int, similarity_to_rep double")
    got = {r.id: (r.cluster_rep_id, r.updated_at) for r in C.apply_assignments(a, new, as_of()).collect()}
    assert got == {1: (2, NOW), 2: (None, AGO(days=3)), 3: (None, AGO(days=3))}


def test_sweep_is_a_clustering_a_set(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [{"title": " ".join(rng.choices(words[:12], k=6)), "summary": " ".join(rng.choices(words, k=30)), "language": "en", "embedding": [1.0, 0.02 * (i % 4), 0.3 * (i % 3)]} for i in range(24)]
    a = articles(spark, *rows)
    sweep = {"default": {}, "loose": {"min_overlap": 0, "min_ratio": 0.0, "min_body_jaccard": 0.0}, "high": {"threshold": 0.99, "min_overlap": 0, "min_ratio": 0.0, "min_body_jaccard": 0.0}}
    got = sorted((r.params, r.size, r.stories) for r in C.cluster_param_sweep(a, sweep, as_of()).collect())
    want = []
    for name, change in sweep.items():
        one = C.cluster_articles(a, as_of(), replace(C.ClusterParams(), **change)).where("cluster_rep_id = id").groupBy("cluster_size").count().collect()
        want += [(name, r.cluster_size, r["count"]) for r in one]
    assert got == sorted(want) and len(want) > 1


def test_failed_scores_are_told(spark):
    def scorer(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [{"score": 0.5, "label": "positive", "confidence": 0.9} for _ in texts]

    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["good", "bad", "", None, "fine"])], "id long, title string, language string")
    got = {r.id: (r.score, r.label, r.failed) for r in SC.score_batch(df, scorer, batch=1).collect()}
    assert got == {0: (0.5, "positive", False), 1: (0.0, "neutral", True), 2: (0.0, "neutral", False), 3: (0.0, "neutral", False), 4: (0.5, "positive", False)}


def test_indexed_edges_against_exact_ones(spark):
    rng = random.Random(9)
    centre = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in centre[i % 40]]) for i in range(900)] + [(2000 + i, [1.0] * 16) for i in range(150)] + [(3000, None)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    sims = lambda df: {(r.a_id, r.b_id): r.sim for r in df.collect()}
    exact = sims(C.knn_edges(v, 0.8, 30, 100))
    got = sims(C.knn_edges_indexed(v, 0.8, 30, 60))  # the 150 equal vectors are a bucket of several blocks in every band
    assert len(exact) > 5000 and len(got.keys() & exact.keys()) / len(exact) >= 0.95
    assert max(sum(1 for x, _ in got if x == a) for a, _ in got) <= 30 and all(s >= 0.8 - 1e-9 for s in got.values())
    assert C.knn_edges_indexed(v.limit(0), 0.8).collect() == []


def copies_of_a_vector():
    """Rows (id, vector) in no order, and the pairs of each of the copies with the five next ones."""
    rng = np.random.default_rng(3)
    one = rng.normal(size=64)
    rows = [(i, [float(x) for x in (one if i % 3 else rng.normal(size=64)).astype(np.float32)]) for i in range(400)]
    random.Random(5).shuffle(rows)
    copies = [i for i in range(400) if i % 3]
    return rows, {(a, b) for n, a in enumerate(copies) for b in copies[n + 1 : n + 6]}


def test_copies_of_a_vector_are_equally_similar(spark):
    """Of more copies than k the smallest ids are the nearest, wherever they stand in a block."""
    rows, want = copies_of_a_vector()
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    for edges in (C.knn_edges(v, 0.8, 5, 90), C.knn_edges_indexed(v, 0.8, 5, 60)):
        assert {(r.a_id, r.b_id) for r in edges.collect()} == want


def test_reject_counts_of_copies(spark):
    """The number of conflicts is that of the nearest pairs in the order that SQL gives copies."""
    rows, want = copies_of_a_vector()
    kind = "id long, embedding array<float>, title string, summary string, ai_summary string, language string, tickers array<string>"
    a = spark.createDataFrame([(i, v, "t", "s", None, "en", ["A" if i < 200 else "B"]) for i, v in rows], kind)
    loose = C.ClusterParams(min_overlap=0, min_ratio=0.0, min_body_jaccard=0.0)
    got = C.edge_reject_counts(C.edge_verdicts(C.knn_edges(a, 0.8, 5, 90), a, loose)).collect()
    assert [tuple(r) for r in got] == [("ticker_conflict", sum((a < 200) != (b < 200) for a, b in want))]


@pytest.mark.parametrize("n", [600, 640])
def test_index_in_rounds(spark, monkeypatch, n):
    """Where its copies are too many, the index goes band by band or compares all pairs; both write each vector a few times a round and find what one round does."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(30, 16))
    vectors = [centres[i % 30] + rng.normal(size=16) * (0.3 if i % 5 else 0) for i in range(n)]  # each fifth is a copy of its centre
    v = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(vectors)], "id long, embedding array<float>").localCheckpoint()
    pairs = lambda df: {(r.a_id, r.b_id): r.sim for r in df.collect()}
    exact, whole = pairs(C.knn_edges(v, 0.8, 5)), pairs(C.knn_edges_indexed(v, 0.8, 5, 60))
    made, dealt = C._products, []
    monkeypatch.setattr(C, "_products", lambda d, *rest: dealt.append(d.count()) or made(d, *rest))
    monkeypatch.setattr(C, "ROUND_BYTES", 1, raising=False)
    monkeypatch.setattr(C, "LEAST_ROWS", 40, raising=False)
    assert pairs(C.knn_edges_indexed(v, 0.8, 5, 60)) == exact and len(exact) > 2000
    assert len(dealt) == -(-n // 40) // 2 + 1 and max(dealt) <= 2 * n and sum(dealt) == -(-n // 40) * n
    monkeypatch.setattr(C, "WORTH", 9, raising=False)
    dealt.clear()
    assert pairs(C.knn_edges_indexed(v, 0.8, 5, 60)) == whole
    assert len(dealt) > 2 and max(dealt) <= 4 * n
