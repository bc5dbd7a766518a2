"""Queries see texts to their end."""

import random
import re

from newsloom.plans import queries as Q
from newsloom.plans import views as V


def test_words_after_the_first_2000_characters(spark, tmp_path):
    rng = random.Random(2)
    texts = {i: f"title {i}\n" + " ".join(f"w{rng.randrange(900)}" for _ in range(800)) + f" last{i} end" for i in range(6)}
    docs = [(i, t, "en", "src1") for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "last3 end"), (1, "last4 title")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in texts], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    whole = {r.id: r for r in V.articles(spark, str(tmp_path)).collect()}
    assert {i: r.summary for i, r in whole.items()} == texts
    count = {}
    for r in whole.values():
        for w in split(r.title) + split(r.summary) + split(r.ai_summary):
            count[w] = count.get(w, 0) + 1
    run = lambda name: Q.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.term: r.n for r in run("search_postings")} == count and "last3" in count
    assert {(r.query_id, r.id) for r in run("fts_candidates")} == {(r.query_id, r.id) for r in run("cover_density_rank")} == {(0, 3), (1, 4)}
    assert {(r.query_id, r.id) for r in run("single_group_rank")} == {(0, 3), (1, 4)}
    long = lambda t: [w for w in split(t) if len(w) > 1]
    pairs = {i: len({*zip(long(t), long(t)[1:])}) for i, t in texts.items()}
    assert {r.id: r.shingles for r in run("body_shingle_counts")} == pairs
    assert all(r.summary.endswith(" end") for r in run("normalize_feed_entries"))
    assert {(r.query_id, r.id) for r in run("hybrid_search") if r.fts_score > 0} == {(0, 3), (1, 4)}
