"""Stories over a moving window against clustering the whole window anew."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import moving as M
from newsloom.operators.cluster import ClusterParams, cluster_articles

START = dt.datetime(2024, 1, 1)
P = ClusterParams(window_days=3, threshold=0.6, same_lang_cosine=0.6, knn=3, min_overlap=0, min_ratio=0.0, min_body_jaccard=0.0, block_rows=16, indexed=False)


def test_ten_steps(spark, request):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", held))
    rng, py = np.random.default_rng(3), random.Random(3)
    topics = rng.normal(size=(6, 8))
    kind = "id long, title string, summary string, ai_summary string, language string, tickers array<string>, last_seen_at timestamp, embedding array<float>"
    rows, state = {}, None
    for step in range(10):
        now = START + dt.timedelta(days=step)
        for _ in range(40 if step == 0 else 8):
            i = len(rows) * 7 % 1009 + 1  # ids in no order of time
            topic = py.randrange(6)
            rows[i] = [i, f"title {topic} of it", "body", None, "en", py.choice([None, ["A"], ["B"]]), now - dt.timedelta(hours=py.randrange(20)), [float(x) for x in topics[topic] + rng.normal(size=8) * 0.55]]
        for i in py.sample(sorted(rows), 3):  # seen again
            rows[i][6] = now
        for i in py.sample(sorted(rows), 2):  # changed
            rows[i][5] = ["C"]
        if step == 6:
            for i in py.sample(sorted(rows), 5):  # deleted
                del rows[i]
        df = spark.createDataFrame([tuple(r) for r in rows.values()], kind).coalesce(2)
        at = F.lit(str(now)).cast("timestamp")
        before = {r.id for r in state.articles.select("id").collect()} if state else set()
        state = M.move_window(state or M.empty_window(df), df, at, P)
        want = {(r.id, r.cluster_rep_id, r.cluster_size, round(r.similarity_to_rep or 0, 6)) for r in cluster_articles(df, at, P).collect()}
        assert {(r.id, r.cluster_rep_id, r.cluster_size, round(r.similarity_to_rep or 0, 6)) for r in state.assigned.collect()} == want, step
        assert any(w[2] > 1 for w in want)
    assert M.move_window(state, df.limit(0), at, P).assigned.count() == 0


def test_pairs_grow_with_what_is_new(spark):
    rng = np.random.default_rng(4)
    window = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)], "id long, embedding array<float>")
    m = {r.id: np.array(r.embedding) for r in window.collect()}
    cos = lambda a, b: float(m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b]))
    some = [5, 150, 299]
    got = {(r.a_id, r.b_id): r.sim for r in M.delta_pairs(window.where(F.col("id").isin(some)).select("id"), window, 0.5, 300, 40).collect()}
    want = {(min(a, b), max(a, b)): cos(a, b) for a in some for b in range(300) if a != b and cos(a, b) >= 0.5}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
