"""The driver's contract, and a sample of queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["feed_summary", "feed_personalized", "upsert_articles", "user_affinity", "cluster_articles", "hybrid_search", "dispatch_alerts", "title_tokens", "rolling_summary"]


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = want.fetchall()
    at = [want.columns.index(c) for c in columns]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
