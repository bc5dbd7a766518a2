"""Derived tables that follow a change log against tables made anew."""

import tempfile

import pytest
from pyspark.sql import functions as F

from newsloom import schema
from newsloom.functions.text import embedding_text
from newsloom.operators import scoring as SC
from newsloom.operators.cluster import apply_assignments
from newsloom.operators.dedup import upsert_articles
from newsloom.operators.quality import cascade_delete, reset_enrichment
from newsloom.operators.search import search_postings
from newsloom.scratch import Scratch
from newsloom.streaming.changes import ChangeLog, Derived, changed_rows

POSTINGS = "id long, term string, pos int, weight string, n_pos int"
VECTORS = "id long, embedding array<float>, model_id string"


@pytest.fixture
def at(spark):
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


def vectors(df):
    return SC.embed_batch(df.select("id", "title", "summary"), SC.hashing_embedder(8), 8, "hash-8", embedding_text(F.col("title"), F.col("summary"))).select("id", "embedding", "model_id")


@pytest.fixture
def few_partitions(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_derived_tables_follow_any_write(spark, at, few_partitions):
    folder = tempfile.mkdtemp(prefix="spark-changes-")
    scratch = Scratch(spark, "changes")
    log = ChangeLog(spark, f"{folder}/log", schema.ARTICLE)
    posted, told = Derived(spark, f"{folder}/postings", search_postings, POSTINGS), Derived(spark, f"{folder}/vectors", vectors, VECTORS)
    nobody = spark.createDataFrame([], schema.FEEDBACK)
    batch = lambda *rows: spark.createDataFrame([(i, u, t, s) for i, (u, t, s) in enumerate(rows)], "position int, url string, title string, summary string")
    wave = lambda n: batch(*((f"u{(7 * i + n) % 23}", f"title {i} of {n}", f"body {i * n} text") for i in range(8)))
    bodies = lambda ids: spark.createDataFrame([(i, "a much longer body " * 8) for i in ids], "id long, body string")
    stories = lambda ids: spark.createDataFrame([(i, ids[0], len(ids), 0.9) for i in ids], "id long, cluster_rep_id long, cluster_size int, similarity_to_rep double")
    steps = [
        lambda t: upsert_articles(t, wave(0), at)[0], lambda t: upsert_articles(t, wave(1), at)[0], lambda t: reset_enrichment(t, bodies([1, 3])), lambda t: apply_assignments(t, stories([2, 4, 5]), at),
        lambda t: cascade_delete(t, nobody, t.where("id in (2, 3)"))[0], lambda t: upsert_articles(t, wave(2), at)[0], lambda t: t, lambda t: reset_enrichment(t, bodies([6, 9, 99])),
        lambda t: cascade_delete(t, nobody, t)[0], lambda t: upsert_articles(t, wave(3), at)[0],
    ]
    table = spark.createDataFrame([], schema.ARTICLE)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    for n, step in enumerate(steps):
        after = scratch.save(step(table).select(*(F.col(f.name).cast(f.dataType) for f in schema.ARTICLE)))
        table = log.replace(table, after, n)
        posted.follow(log, f"{folder}/cp-postings").awaitTermination()
        assert same(posted.read(), search_postings(table)), n
        if n in (3, 9):  # a follower that was away catches up, a version a batch
            told.follow(log, f"{folder}/cp-vectors", files=1).awaitTermination()
            assert same(told.read(), vectors(table)), n
    assert posted.read().count() > 20
    # a batch that is replayed, and a version that is recorded again, change nothing
    before = sorted(map(str, posted.read().collect()))
    posted.apply(spark.read.schema(log.schema).parquet(f"{log.path}/v5"), 5)
    log.record(changed_rows(table.limit(0), table), 3)
    posted.follow(log, f"{folder}/cp-postings").awaitTermination()
    posted.compact(7)
    assert sorted(map(str, posted.read().collect())) == before and posted.rows.names()[0] == "c6"


def test_changed_rows(spark):
    kind = "id long, a string, b array<string>"
    was = spark.createDataFrame([(1, "x", None), (2, "y", ["p"]), (3, None, []), (None, "z", None)], kind)
    now = spark.createDataFrame([(1, "x", None), (2, "y", ["q"]), (4, "new", None)], kind)
    got = {(r.id, r.a, r.gone) for r in changed_rows(was, now).collect()}
    assert got == {(2, "y", False), (3, None, True), (4, "new", False)}
    assert changed_rows(now, now).collect() == [] and changed_rows(was.limit(0), was.limit(0)).collect() == []
