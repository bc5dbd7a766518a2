"""Each stream against its batch twin, over files that arrive in several micro-batches."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from newsloom import schema
from newsloom.operators.affinity import user_affinity
from newsloom.operators.alerts import AlertParams, dispatch_alerts
from newsloom.operators.dedup import current_feedback, upsert_articles
from newsloom.operators.search import search_postings
from newsloom.streaming import streams as ST

NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


def as_of():
    return F.lit("2024-01-31 12:00:00").cast("timestamp")


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-streams-")


def landed(spark, folder, rows, kind, parts=3):
    """A stream of one file a trigger."""
    path = f"{folder}/in"
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if kind is not None and isinstance(rows, list) else rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


def memory(spark, df, name, folder, mode="append"):
    drain(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    return spark.table(name)


def landing(spark, path, kind, batches):
    """Lands one file a batch, in order, and gives a stream that takes one a trigger."""
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_upsert(spark, folder):
    kind = "position int, url string, title string, tickers array<string>"
    rows = [(i, f"u{i % 7}", f"t{i}", ["A"] if i % 2 else None) for i in range(30)] + [(30 + i, f"v{i}", "new", None) for i in range(3)] + [(50, None, "no url", None)]
    stream, _ = landed(spark, folder, rows, kind)
    drain(ST.stream_upsert(stream, f"{folder}/table", f"{folder}/cp", schema.ARTICLE, as_of, index=True))
    table = ST.Articles(spark, f"{folder}/table", schema.ARTICLE)
    want = spark.createDataFrame([], schema.ARTICLE)
    for k in range(3):  # the batch twin
        batch = spark.createDataFrame([r for r in rows[k::3] if r[1]], kind)
        want = spark.createDataFrame(upsert_articles(want, batch, as_of())[0].collect(), schema.ARTICLE)
    same = lambda df: sorted((r.url, r.title, r.tickers or [], r.hit_count, r.last_seen_at, r.updated_at) for r in df.collect())
    assert same(table.read()) == same(want) and len(same(want)) == 10
    ids = [r.id for r in table.read().collect()]
    assert len(set(ids)) == 10 and min(ids) > 0
    assert {tuple(r) for r in table.postings().collect()} == {tuple(r) for r in search_postings(table.read()).collect()}
    # each batch wrote its own part and nothing else
    assert [table.rows.names(), table.bumps.names(), table.index.names()] == [["v0", "v1", "v2"]] * 3
    assert [spark.read.parquet(f"{folder}/table/rows/v{k}").count() for k in range(3)] == [8, 1, 1]
    before = same(table.read())
    table.compact(2)
    assert same(table.read()) == before and table.rows.names() == ["c1", "v2"] and table.bumps.names() == ["v2"]
    table.compact(2)
    assert same(table.read()) == before


@pytest.fixture
def one_partition(spark):
    """A stream's number of partitions is that of its first batch."""
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", held)


def test_upsert_reads_nothing_of_the_table(spark, folder, one_partition):
    """Twenty batches over a table whose files are gone, with a restart in the middle: a batch costs what it brings."""
    kind = "position int, url string, title string"
    table = ST.Articles(spark, f"{folder}/table", schema.ARTICLE)
    base = {f.name: None for f in schema.ARTICLE}
    held = [tuple((base | {"id": 100 + i, "url": f"old{i}", "title": "held", "hit_count": 5})[f.name] for f in schema.ARTICLE) for i in range(40)]
    table.rows.write(spark.createDataFrame(held, schema.ARTICLE), 0, "c")
    batches = [[(i, f"old{(n * 7 + i) % 45}", f"t{n}") for i in range(3)] + [(9, f"new{n}", "x"), (10, f"new{n}", "y")] for n in range(20)]
    seen = {f"old{i}": (100 + i, 5) for i in range(40)}
    got_rows, got_bumps = [], []
    for part in (batches[:8], batches[8:]):
        stream = landing(spark, f"{folder}/in", kind, part)
        query = ST.stream_upsert(stream, f"{folder}/table", f"{folder}/cp", schema.ARTICLE, as_of)
        drain(query)
        read = [p.numInputRows for p in query.recentProgress if p.numInputRows]
        assert max(read) <= 5  # the state's beginning is no input; the table is none of any batch
        for n in sorted(int(x[1:]) for x in os.listdir(f"{folder}/table/rows") if x[0] == "v"):
            got_rows += [(n, r.url, r.title, r.id) for r in spark.read.parquet(f"{folder}/table/rows/v{n}").collect()]
            got_bumps += [(n, r.url) for r in spark.read.parquet(f"{folder}/table/bumps/v{n}").collect()]
        os.rename(f"{folder}/table", f"{folder}/gone{len(part)}")
    want_rows, want_bumps = [], []
    for n, rows in enumerate(batches):
        for url in dict.fromkeys(r[1] for r in rows):
            if url in seen:
                want_bumps.append((n, url))
            else:
                seen[url] = True
                want_rows.append((n, url, next(r[2] for r in rows if r[1] == url)))
    assert sorted(r[:3] for r in got_rows) == sorted(want_rows) and sorted(got_bumps) == sorted(want_bumps)
    ids = [r[3] for r in got_rows]
    assert len(set(ids)) == len(ids) == len(want_rows) > 20 and min(ids) > 139


def test_replayed_part(spark, folder):
    table = ST.Parts(spark, f"{folder}/t")
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    for n in (0, 1, 1, 2):
        table.write(one(n), n)
    assert sorted(r.id for r in table.read("id long").collect()) == [0, 1, 2] and [r.id for r in table.read("id long", 1).collect()] == [0]
    table.compact(table.read("id long", 2), 2)
    assert table.names() == ["c1", "v2"] and sorted(r.id for r in table.read("id long").collect()) == [0, 1, 2]


def test_old_versions_go(spark, folder):
    table = ST.Versions(spark, f"{folder}/t")
    for n in range(4):
        table.write(spark.createDataFrame([(n,)], "id long"), n)
        table.prune(n)
    assert sorted(os.listdir(f"{folder}/t")) == ["v2", "v3"] and [r.id for r in table.read("id long").collect()] == [3]


def test_channel_tiers(spark):
    day = spark.range(0, 24 * 60).select(F.timestamp_seconds(F.col("id") * 60).alias("at"))
    due = [(r.at.hour, r.at.minute) for r in day.where(ST.channel_due(F.col("at"))).select(F.col("at")).collect()]
    assert len([x for x in due if x[0] in (20, 21, 22, 23, 0, 1)]) == 12 and all(m in (0, 30) for _, m in due)
    assert sorted(h for h, _ in due if 2 <= h < 15) == [2, 4, 6, 8, 10, 12, 14] and sorted(h for h, _ in due if 15 <= h < 20) == [15, 19]


def test_replayed_batch_writes_the_same_version(spark, folder):
    table = ST.Versions(spark, f"{folder}/t")
    batch = spark.createDataFrame([(1, "a", "t")], "position int, url string, title string")
    for _ in range(2):  # version 0 is written again from what was before it
        table.write(upsert_articles(table.read(schema.ARTICLE, 0), batch, as_of())[0], 0)
    assert [r.hit_count for r in table.read(schema.ARTICLE).collect()] == [1] and table.newest() == 0


def test_feedback(spark, folder):
    acts = ["like", "dislike", "bookmark", "dismiss", "view"]
    rows = [(i, f"u{i % 3}", i % 4, acts[(i * 7) % 5], "delete" if i % 6 == 0 else "add") for i in range(60)]
    kind = "id long, user_id string, news_id long, action string, op string"
    path = f"{folder}/in"
    for k in range(3):  # in order of id
        spark.createDataFrame(rows[20 * k : 20 * k + 20], kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    states = memory(spark, ST.feedback_state(stream).withColumn("n", F.current_timestamp()), "feedback_states", folder, "update")
    last = states.groupBy("user_id", "news_id").agg(F.max_by("actions", "n").alias("actions"))
    got = {(r.user_id, r.news_id, a) for r in last.collect() for a in r.actions.split(",") if a}
    assert got == {tuple(r) for r in current_feedback(spark.read.parquet(path)).collect()}


def test_since(spark, folder):
    for ids in ([5, 3, 9], [4, 10], [10, 11]):
        spark.createDataFrame([(i, "Acc") for i in ids], "id long, username string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("id long, username string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    assert sorted(r.id for r in memory(spark, ST.since_marker(stream), "since", folder).collect()) == [3, 5, 9, 10, 11]


def test_budget(spark, folder):
    """The posts of a month that the budget allows are the first by id of each batch, after those of the batches before it."""
    kind = "id long, username string, created_at timestamp"
    months = [NOW, dt.datetime(2024, 2, 3), None]
    batches = [[(1000 * n + (i * 7919) % 500, "A", months[min(i % 5, 2)]) for i in range(400)] for n in range(3)]
    stream = landing(spark, f"{folder}/in", kind, batches)
    seen = []
    drain(ST.budget_gate(stream, f"{folder}/gate", f"{folder}/cp", 1.0, 500.0, keep=lambda df, n: seen.append((n, df.count()))))
    left, want = {}, {}
    for rows in batches:
        for i, _, at in sorted(rows, key=lambda r: r[0]):
            month = at and at.strftime("%Y-%m")
            want[i] = (month, left.setdefault(month, 0) < 500)
            left[month] += 1
    got = ST.Parts(spark, f"{folder}/gate/posts").read("month string, id long, allowed boolean").collect()
    assert {r.id: (r.month, r.allowed) for r in got} == want and seen == [(0, 400), (1, 400), (2, 400)]
    assert {r.month: r.posts for r in ST.Versions(spark, f"{folder}/gate/spent").read(ST.SPENT).collect()} == left


ALERT = {f.name: None for f in schema.ARTICLE} | {"cluster_size": 1, "raw_data": '{"x": {"breaking": true}}'}


def test_throttle(spark, folder):
    rows = [ALERT | {"id": i, "title": "t", "first_seen_at": NOW - dt.timedelta(minutes=i), "cluster_rep_id": i % 4 if i % 3 else None} for i in range(24)]
    full = [tuple(r[f.name] for f in schema.ARTICLE) for r in rows]
    stream, batch = landed(spark, folder, full, schema.ARTICLE)
    sent = []
    drain(ST.alert_throttle(stream, f"{folder}/ledger", f"{folder}/cp", schema.LEDGER, as_of(), 6, AlertParams(), lambda df: sent.extend(r.id for r in df.collect())))
    assert len(sent) == 6 == len(set(sent))
    ledger = ST.Parts(spark, f"{folder}/ledger").read(schema.LEDGER)
    out, _ = dispatch_alerts(batch, ledger, as_of(), 6)
    assert {r.outcome for r in out.collect()} <= {"already_sent", "cluster_dedup", "hourly_cap"}


def test_marks_expire_with_the_clock(spark, folder):
    """A batch every 20 hours for 45 days: the ledger holds what counts, and outcomes are those of the batch twin with the whole log of marks."""
    clock = [NOW + dt.timedelta(hours=20 * n) for n in range(54)]
    batches = [[tuple((ALERT | {"id": 10 * (n % 40) + k, "first_seen_at": at - dt.timedelta(minutes=k), "cluster_rep_id": 7 if k == 2 else None})[f.name] for f in schema.ARTICLE) for k in range(4)] for n, at in enumerate(clock)]
    log, sizes, now, got, want = spark.createDataFrame([], schema.LEDGER), [], [], [], []
    for n, rows in enumerate(batches[:54:6]):  # every fifth day
        at = F.lit(str(clock[6 * n])).cast("timestamp")
        stream = landing(spark, f"{folder}/in", schema.ARTICLE, [rows])
        sent = []
        drain(ST.alert_throttle(stream, f"{folder}/ledger", f"{folder}/cp", schema.LEDGER, at, 3, AlertParams(), lambda df: sent.extend(r.id for r in df.collect()), compact_every=2))  # noqa: B023
        out, marks = dispatch_alerts(spark.createDataFrame(rows, schema.ARTICLE), log, at, 3)
        want.append(sorted(r.id for r in out.where("outcome = 'sent'").collect()))
        got.append(sorted(sent))
        log = spark.createDataFrame(log.union(marks).distinct().collect(), schema.LEDGER)
        sizes.append(ST.Parts(spark, f"{folder}/ledger").read(schema.LEDGER).count())
    assert got == want and any(want)
    assert max(sizes[4:]) <= max(sizes[:5]) + 12 and log.count() > 1.5 * max(sizes)


def test_late_scores_and_articles(spark, folder):
    minute = lambda m: NOW + dt.timedelta(minutes=m)
    a_kind, s_kind = "id long, first_seen_at timestamp, title string", "id long, scored_at timestamp, sentiment double"
    articles = [[(1, minute(0), "a"), (2, minute(1), "b"), (3, minute(2), "c")], [(4, minute(30), "d"), (2, minute(1), "b")], [(5, minute(27), "late"), (6, minute(90), "e")], [(9, minute(300), "clock")], [(7, minute(28), "too late"), (8, minute(301), "clock")]]
    scores = [[(1, minute(1), 0.5)], [(2, minute(50), -0.4), (1, minute(1), 0.5)], [(4, minute(31), 0.1), (5, minute(88), 0.9)], [(3, minute(62) + dt.timedelta(seconds=1), 0.7), (6, minute(92), 0.2), (9, minute(300), 0.3)], [(8, minute(301), 0.4)]]
    left = landing(spark, f"{folder}/a", a_kind, articles)
    right = landing(spark, f"{folder}/s", s_kind, scores)
    got = {(r.id, r.title, r.sentiment) for r in memory(spark, ST.scored_articles(left, right), "scored", folder).collect()}
    flat = lambda rows: [r for part in rows for r in part]
    batch = ST.scored_articles(spark.createDataFrame(flat(articles), a_kind), spark.createDataFrame(flat(scores), s_kind))
    want = {(r.id, r.title, r.sentiment) for r in batch.collect()}
    assert {(1, "a", 0.5), (2, "b", -0.4), (4, "d", 0.1), (5, "late", None), (6, "e", 0.2)} <= want and (3, "c", None) in want
    assert got >= {(1, "a", 0.5), (2, "b", -0.4), (4, "d", 0.1), (6, "e", 0.2), (3, "c", None)} and all(g in want for g in got)
    assert 7 not in {g[0] for g in got}  # beyond the watermark


def test_rolling_summary(spark, folder):
    kind = "id long, published_at timestamp, first_seen_at timestamp, sentiment_label string"
    rows = [(i, None if i % 3 else NOW + dt.timedelta(minutes=10 * i), NOW + dt.timedelta(minutes=10 * i), ["positive", "odd", None][i % 3]) for i in range(90)]
    path = f"{folder}/in"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    got = {tuple(r) for r in memory(spark, ST.rolling_summary(stream, 2, "1 hour"), "rolling", folder).collect()}
    want = {tuple(r) for r in ST.rolling_summary(spark.read.parquet(path), 2, "1 hour").collect()}
    last = max(r[1] for r in got)
    assert got and got == {r for r in want if r[1] <= last}


def test_windows_of_panes_are_those_of_rows(spark):
    rng = random.Random(5)
    kind = "id long, published_at timestamp, first_seen_at timestamp, sentiment_label string"
    rows = [(i, None, NOW + dt.timedelta(seconds=rng.randrange(90 * 3600)), rng.choice(["positive", "negative", "neutral", None])) for i in range(400)]
    df = spark.createDataFrame(rows, kind)
    for hours, slide in ((24, "12 hours"), (720, "6 hours"), (1, "7 minutes"), (2, "30 minutes"), (5, "3 hours")):
        label = lambda k: F.count_if(F.col("sentiment_label") == k).alias(k)
        plain = df.groupBy(F.window("first_seen_at", f"{hours} hours", slide)).agg(F.count("*").alias("total"), label("positive"), label("negative"), label("neutral"))
        want = sorted((r.window.start, r.window.end, r.total, r.positive, r.negative, r.neutral) for r in plain.collect())
        assert sorted(map(tuple, ST.rolling_summary(df, hours, slide).collect())) == want
    assert ST.rolling_summary(df.limit(0), 24, "1 hour").collect() == []


def test_affinity_refresh(spark, folder):
    """Adds, deletes and flips over several batches: after each, the affinity is that of the feedback that holds."""
    kind = "id long, user_id string, news_id long, action string, op string"
    arts = spark.createDataFrame([(1, ["a"], ["s"]), (2, ["b", "a"], None), (3, None, None), (4, ["c"], ["s", "t"])], "id long, tickers array<string>, sectors array<string>")
    rng = random.Random(6)
    events = [(i, f"u{rng.randrange(5)}", rng.randrange(1, 6), rng.choice(["like", "dislike", "bookmark", "dismiss", "view"]), rng.choice(["add", "add", "delete"])) for i in range(240)]
    near = lambda df: {(r.user_id, r.kind, r.tag, round(r.score, 9)) for r in df.collect()}
    table = ST.Affinity(spark, f"{folder}/aff")
    for n in range(4):
        stream = landing(spark, f"{folder}/in", kind, [events[60 * n : 60 * n + 60]])
        drain(ST.affinity_refresh(stream, arts, f"{folder}/aff", f"{folder}/cp", compact_every=2, availableNow=True))
        want = user_affinity(current_feedback(spark.createDataFrame(events[: 60 * n + 60], kind)), arts)
        assert near(table.read()) == near(want)
    assert table.sums.names()[0] == "c1"  # parts before batch 2 were put together
    # one user's event touches no other user; all of a user's feedback taken back leaves nothing
    held = current_feedback(spark.createDataFrame(events, kind)).where("user_id = 'u1'").collect()
    stream = landing(spark, f"{folder}/in", kind, [[(1000 + i, r.user_id, r.news_id, r.action, "delete") for i, r in enumerate(held)]])
    drain(ST.affinity_refresh(stream, arts, f"{folder}/aff", f"{folder}/cp", compact_every=100, availableNow=True))
    assert {r.user_id for r in spark.read.parquet(f"{folder}/aff/scores/v4").collect()} == {"u1"} and "u1" not in {r.user_id for r in table.read().collect()}
