"""The operators that keep state, as Structured Streaming queries. Each has a batch twin that tests hold it to."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from newsloom.operators.affinity import affinity_scores, signed_sums
from newsloom.operators.alerts import AlertParams, alert_marks, alert_outcomes, live_marks
from newsloom.operators.dedup import GATED, bumped_articles, gate_posts, new_rows
from newsloom.operators.search import search_postings
from newsloom.schema import ACTIONS, LABELS
from newsloom.scratch import Scratch

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions:
    """A small table that one stream rewrites: version n is a folder, and the newest complete one counts. A replayed batch writes the same version again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def newest(self, below: int | None = None) -> int:
        fs, p = self._fs()
        if not fs.exists(p):
            return -1
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max([v for v in done if below is None or v < below], default=-1)

    def read(self, schema, below: int | None = None) -> DataFrame:
        v = self.newest(below)
        return self.spark.createDataFrame([], schema) if v < 0 else self.spark.read.schema(schema).parquet(f"{self.path}/v{v}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def prune(self, version: int) -> None:
        """Removes what no replay of batch ``version`` or of a later one reads."""
        last = self.newest(version)
        fs, p = self._fs()
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if int(s.getPath().getName()[1:]) < last:
                fs.delete(s.getPath(), True)


class Parts:
    """A table that grows by a part a batch: ``c<n>`` holds all up to batch n together, ``v<n>`` what batch n added. A replayed batch writes its part again.

    No part is rewritten but when parts are put together, which ``compact`` does before batch n for the batches before it.
    With ``by``, the files of a part lie in folders of these columns' values, and a read that picks values opens only theirs.
    """

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ()):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    def _of(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _held(self, below: int | None) -> list[tuple[int, str]]:
        fs = self._of().getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(self._of()):
            return []
        done = sorted((int(n[1:]), n[0]) for s in fs.listStatus(self._of()) if fs.exists(self._of(n := s.getPath().getName(), "_SUCCESS")))
        return [(v, kind) for v, kind in done if below is None or v < below]

    def last(self, below: int | None = None) -> int:
        """The last batch that is held together with those before it; what a table holds before its first batch is batch -1."""
        return max((v for v, kind in self._held(below) if kind == "c"), default=-1)

    def names(self, below: int | None = None, after: int | None = None) -> list[str]:
        """Folders that together are the table before batch ``below``, or what came to it after batch ``after``."""
        last = self.last(below)
        return [f"{kind}{v}" for v, kind in self._held(below) if (after is None or v > after) and (v > last if kind == "v" else v == last)]

    def read(self, schema, below: int | None = None, after: int | None = None) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in self.names(below, after)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        one = self.spark.read.schema(schema)
        return reduce(DataFrame.unionByName, (one.parquet(p) for p in paths)) if self.by else one.parquet(*paths)

    def write(self, df: DataFrame, version: int, kind: str = "v") -> None:
        df.write.mode("overwrite").partitionBy(*self.by).parquet(f"{self.path}/{kind}{version}")

    def compact(self, whole: DataFrame, before: int) -> None:
        """Writes ``whole`` as all that is held before batch ``before`` and removes the parts of it; done once."""
        if self.last(before) < before - 1:
            self.write(whole, before - 1, "c")
        self.remove(before, {f"c{before - 1}"})

    def remove(self, before: int, but: set[str] = frozenset()) -> None:
        fs = self._of().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v, kind in self._held(before):
            if f"{kind}{v}" not in but:
                fs.delete(self._of(f"{kind}{v}"), True)


BUMPS = "url string, hits long, at timestamp"


class Articles:
    """The articles that ``stream_upsert`` keeps: rows of new URLs, bumps of known ones, and perhaps postings, each batch's beside the others.

    Reading lays the bumps over the rows. Both are parts of a table, so a batch writes as much as it brings, however large the table is.
    """

    def __init__(self, spark: SparkSession, path: str, schema):
        self.schema = schema
        self.rows, self.bumps, self.index = (Parts(spark, f"{path.rstrip('/')}/{x}") for x in ("rows", "bumps", "postings"))

    def read(self, below: int | None = None) -> DataFrame:
        bumps = self.bumps.read(BUMPS, below, self.rows.last(below))
        return bumped_articles(self.rows.read(self.schema, below), bumps.groupBy("url").agg(F.sum("hits").alias("hits"), F.max("at").alias("at")))

    def postings(self, below: int | None = None) -> DataFrame:
        return self.index.read("id long, term string, pos int, weight string, n_pos int", below)

    def compact(self, before: int) -> None:
        """Writes the rows before batch ``before`` with their bumps laid over; bumps of batches that are in the rows no longer count, and go."""
        if self.rows.last(before) < before - 1:
            with Scratch(self.rows.spark, "articles") as scratch:
                self.rows.compact(scratch.save(self.read(before)), before)
        self.bumps.remove(before)


def _as_of(as_of: Callable[[], Column] | Column) -> Column:
    return as_of() if callable(as_of) else as_of


URL_BUCKETS = 1024


def first_of_batch(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Of each Arrow batch of a task the first row of each key by ``order``, so that a key that holds a third of all rows isn't shuffled row by row. Other repeats stay."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            at = pc.sort_indices(rows, sort_keys=[(key, "ascending"), (order, "ascending")])
            names = rows.column(key).take(at).combine_chunks()
            new = np.r_[True, np.asarray(pc.not_equal(names[1:], names[:-1]))] if len(names) else np.zeros(0, dtype=bool)
            yield from rows.take(at.filter(pa.array(new))).to_batches()

    return stream.mapInArrow(firsts, stream.schema)


class _Upsert(StatefulProcessor):
    """State per bucket of URLs: each URL's id and hits, and how many ids the bucket gave out.

    Bucket k of n gives ids that leave k when divided by n, from above the ids that there were: no two buckets agree, and none has to ask another.
    """

    def __init__(self, top: int, buckets: int):
        self.top, self.buckets = top, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", "url string", "id long, hits long")
        self.given = handle.getValueState("given", "next long")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.urls.updateValue((initialState.url,), (initialState.id, initialState.hits))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first: dict[str, Row] = {}
        for r in rows:
            if r.url not in first or r.position < first[r.url].position:
                first[r.url] = r
        following = self.given.get()[0] if self.given.exists() else self.top // self.buckets + 1
        before = following
        for url, r in sorted(first.items()):
            held = self.urls.getValue((url,))
            if held is None:
                self.urls.updateValue((url,), (following * self.buckets + key[0], 1))
                yield Row(url=url, id=following * self.buckets + key[0], hits=1, at=r.at, record=r.record)
                following += 1
            else:
                self.urls.updateValue((url,), (held[0], held[1] + 1))
                yield Row(url=url, id=held[0], hits=held[1] + 1, at=r.at, record=None)
        if following > before:
            self.given.update((following,))

    def close(self) -> None:
        pass


def upsert_changes(stream: DataFrame, held: DataFrame, as_of: Column, buckets: int = URL_BUCKETS) -> DataFrame:
    """``url, id, hits, at, record`` of each URL of each micro-batch; ``record`` is null where the URL was known, else its first row by ``position``.

    ``held(id, url, hit_count)`` is read once, as the state's beginning. A null URL is no article and drops.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).alias("bucket")
    top = held.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    begin = held.where("url is not null").select(bucket, "url", "id", F.coalesce("hit_count", F.lit(0)).cast("long").alias("hits"))
    record = F.struct(*(c for c in stream.columns if c not in ("position", "id", "at")))
    rows = first_of_batch(stream.where("url is not null"), "url", "position").select(bucket, "url", "position", as_of.alias("at"), record.alias("record"))
    kind = f"url string, id long, hits long, at timestamp, record {rows.schema['record'].dataType.simpleString()}"
    return rows.groupBy("bucket").transformWithState(_Upsert(int(top), buckets), kind, "Append", "None", initialState=begin.groupBy("bucket"))


def stream_upsert(
    stream: DataFrame, path: str, checkpoint: str, schema, as_of: Callable[[], Column] = F.current_timestamp, position: str = "position", index: bool = False, **trigger
) -> StreamingQuery:
    """Upserts each micro-batch of records into the ``Articles`` at ``path``: new URLs are added with ids of their bucket, known ones bumped once a batch.

    Which URLs are known is keyed state, so a batch reads nothing of the table, however large it is; what the table holds when the stream first starts is the state's beginning.
    With ``index``, the new articles' search postings are added too (a bump changes no text).
    """
    table = Articles(stream.sparkSession, path, schema)
    changes = upsert_changes(stream.withColumnRenamed(position, "position"), table.read(), _as_of(as_of))

    def apply(batch: DataFrame, n: int) -> None:
        with Scratch(batch.sparkSession, "upsert") as scratch:
            batch = scratch.save(batch)  # the state is asked once
            table.bumps.write(batch.where("record is null").select("url", F.lit(1).cast("long").alias("hits"), "at"), n)
            table.rows.write(new_rows(batch.where("record is not null").select("record.*", "id", "at"), schema), n)
        if index:
            new = stream.sparkSession.read.schema(schema).parquet(f"{table.rows.path}/v{n}")
            table.index.write(search_postings(new), n)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Minutes between runs of a channel's collection by hours of the day (UTC): around the market's close, by day, by night.
CHANNEL_TIERS = ((30, (20, 21, 22, 23, 0, 1)), (120, tuple(range(2, 15))), (240, tuple(range(15, 20))))


def channel_due(at: Column) -> Column:
    """Whether a channel's collection runs in this minute: a trigger by the clock for a scheduler of ``availableNow`` runs. Every 30 minutes, every second or every fourth hour of its tier."""
    hour, minute = F.hour(at), F.minute(at)
    due = F.lit(False)
    for every, hours in CHANNEL_TIERS:
        step = (minute % every == 0) if every < 60 else (minute == 0) & ((hour - hours[0]) % (every // 60) == 0)
        due = due | (hour.isin(*hours) & step)
    return due


def alert_throttle(
    stream: DataFrame, path: str, checkpoint: str, schema, as_of: Callable[[], Column] | Column, cap: int, params: AlertParams, send: Callable[[DataFrame], None],
    compact_every: int = 96, **trigger,
) -> StreamingQuery:
    """Dispatches each micro-batch against the ledger at ``path``. A batch's marks are a part of their own, written after ``send``, so a failed send leaves no mark.

    Marks expire with ``as_of`` (an article's after 30 days, a story's after a day, sendings with their hour): expired ones are passed over at once and leave the
    ledger when its parts are put together, every ``compact_every`` batches. The ledger holds what counts and the marks of so many batches, never more.
    """
    ledger = Parts(stream.sparkSession, path)

    def apply(batch: DataFrame, n: int) -> None:
        at = _as_of(as_of)
        with Scratch(batch.sparkSession, "alerts") as scratch:
            if n and n % compact_every == 0 and ledger.last(n) < n - 1:
                ledger.compact(scratch.save(live_marks(ledger.read(schema, n), at)), n)
            out = scratch.save(alert_outcomes(scratch.save(batch), ledger.read(schema, n), at, cap, params))
            send(out.where("outcome = 'sent'"))
            ledger.write(alert_marks(out, at), n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scored_articles(articles: DataFrame, scores: DataFrame, within: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Articles with the score that came within ``within`` of their first sight, each article once; one without a score comes when none can come any more.

    Two streams meet under their own watermarks: articles (``id``, ``first_seen_at``) and scores (``id``, ``scored_at``, and what they hold) may each be ``late``. Repeats of an id within
    the watermark drop. A row scored after its batch is so still seen by what follows, such as ``alert_throttle``. Works on batches too, where nothing is late:
    of repeated ids the earliest counts.
    """
    def once(df: DataFrame, at: str) -> DataFrame:
        if df.isStreaming:
            return df.withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])
        rest = F.struct(*(c for c in df.columns if c != "id"))
        return df.groupBy("id").agg(F.min_by(rest, F.struct(at, F.to_json(rest))).alias("__row")).select("id", "__row.*")

    a = once(articles, "first_seen_at").alias("a")
    s = once(scores.where("id is not null"), "scored_at").alias("s")
    met = (F.col("a.id") == F.col("s.id")) & (F.col("s.scored_at") >= F.col("a.first_seen_at")) & (F.col("s.scored_at") <= F.col("a.first_seen_at") + F.expr(f"interval {within}"))
    new = [c for c in scores.columns if c != "id"]
    return a.join(s, met, "left").select(*(F.col(f"a.{c}") for c in articles.columns if c not in new), *(F.col(f"s.{c}") for c in new))


class _Feedback(StatefulProcessor):
    """State per (user, article): the set of actions, as flags."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("actions", "actions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = set(filter(None, (self.state.get() or ("",))[0].split(","))) if self.state.exists() else set()
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            if r.op == "add":
                held -= {"like": {"dislike"}, "dislike": {"like"}}.get(r.action, set())
                held.add(r.action)
            else:
                held.discard(r.action)
        self.state.update((",".join(sorted(held)),))
        yield pd.DataFrame({"user_id": [key[0]], "news_id": [key[1]], "actions": [",".join(sorted(held))]})

    def close(self) -> None:
        pass


def feedback_state(stream: DataFrame) -> DataFrame:
    """``(id, user_id, news_id, action, op)`` -> the actions that hold after each micro-batch, comma-joined, for each touched pair."""
    known = stream.where(F.col("action").isin("bookmark", "like", "dislike", "dismiss")).select("id", "user_id", "news_id", "action", "op")
    return known.groupBy("user_id", "news_id").transformWithStateInPandas(_Feedback(), "user_id string, news_id long, actions string", "Update", "None")


SPENT = "month string, posts long"


def budget_gate(
    stream: DataFrame, path: str, checkpoint: str, price: float, budget: float, column: str = "created_at", keep: Callable[[DataFrame, int], None] = lambda df, n: None, **trigger
) -> StreamingQuery:
    """Per post of each micro-batch, by id, whether its month's budget still allowed it. The decisions are parts of the table at ``path/posts``; ``keep`` gets each batch's.

    What months have spent is one row a month (versions at ``path/spent``). Within a batch the posts of a month are counted by ``running_sums``, so a month that holds all posts is spread over tasks,
    and their order is by id whatever the shuffle's.
    """
    spark = stream.sparkSession
    spent, posts = Versions(spark, f"{path}/spent"), Parts(spark, f"{path}/posts")

    def apply(batch: DataFrame, n: int) -> None:
        with Scratch(spark, "budget") as scratch:
            rows = scratch.save(batch.select(F.date_format(column, "yyyy-MM").alias("month"), "id"))
            held = spent.read(SPENT, n)
            posts.write(gate_posts(rows, held, price, budget, scratch), n)
            spent.write(held.unionByName(rows.groupBy("month").agg(F.count("*").alias("posts"))).groupBy("month").agg(F.sum("posts").alias("posts")), n)
        keep(spark.read.schema(GATED).parquet(f"{posts.path}/v{n}"), n)
        spent.prune(n)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Since(StatefulProcessor):
    """State per account: the greatest id seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("since", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = int(self.state.get()[0]) if self.state.exists() else None
        top = since
        for part in rows:
            fresh = part if since is None else part[part["id"] > since]
            if len(fresh):
                top = max(int(fresh["id"].max()), top if top is not None else int(fresh["id"].min()))
                yield pd.DataFrame({"username": key[0], "id": fresh["id"]})
        if top is not None:
            self.state.update((top,))

    def close(self) -> None:
        pass


def since_marker(stream: DataFrame) -> DataFrame:
    """Posts above the greatest id that their account had before this micro-batch."""
    rows = stream.select(F.lower("username").alias("username"), "id")
    return rows.groupBy("username").transformWithStateInPandas(_Since(), "username string, id long", "Append", "None")


def _seconds(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds())


_COUNTS = ("total", *LABELS)
GRID_BLOCK = 4096


def rolling_summary(stream: DataFrame, hours: int, slide: str, late: str = "60 minutes") -> DataFrame:
    """Label counts over a sliding window of 1 to 720 hours of the publish time, late rows taken in up to ``late``. Works on a batch too.

    A row is counted once, into its pane: tumbling windows of the greatest length that divides window and slide. Windows are put together from panes. On a stream, a second
    aggregation adds the few finished panes to their windows; on a batch, a window is the difference of two running sums of panes, whatever its length.
    """
    hours = max(1, min(720, hours))
    pane = math.gcd(hours * 3600, _seconds(slide))
    rows = stream.withColumn("at", F.coalesce("published_at", "first_seen_at").cast("timestamp")).withWatermark("at", late)
    label = lambda k: F.count_if(F.col("sentiment_label") == k).alias(k)
    panes = rows.groupBy(F.window("at", f"{pane} seconds").alias("pane")).agg(F.count("*").alias("total"), *map(label, LABELS))
    if stream.isStreaming:
        out = panes.groupBy(F.window(F.window_time("pane"), f"{hours} hours", slide)).agg(*(F.sum(c).alias(c) for c in _COUNTS))
        return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *_COUNTS)
    return pane_windows(panes.select(F.unix_timestamp("pane.end").alias("end"), *_COUNTS), hours * 3600, _seconds(slide), pane)


def pane_windows(panes: DataFrame, length: int, slide: int, pane: int) -> DataFrame:
    """Sums of every window that holds a pane, from panes by their ``end`` in seconds. One row a grid place between the first and the last window, however long windows are."""
    span = panes.agg(F.min("end").alias("first"), F.max("end").alias("last"))
    grid = span.where("first is not null").select(F.explode(F.sequence(F.col("first") - pane - length, F.col("last") + length, F.lit(pane))).alias("end"))
    zero = grid.join(panes, "end", "left").select("end", *(F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS))
    # Running sums over blocks of the grid: the blocks' totals are few, and no window is over all rows.
    block = F.floor(F.col("end") / (pane * GRID_BLOCK)).alias("block")
    by = Window.partitionBy("block").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    local = zero.select("*", block).select("block", "end", *(F.sum(c).over(by).alias(c) for c in _COUNTS))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = zero.groupBy(block).agg(*(F.sum(c).alias(c) for c in _COUNTS)).select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in _COUNTS))
    sums = local.join(totals, "block").select("end", *((F.col(c) + F.col(f"__{c}")).alias(c) for c in _COUNTS))
    ends = sums.where(F.pmod("end", F.lit(slide)) == length % slide)  # a window starts at a multiple of the slide
    begin = sums.select((F.col("end") + length).alias("end"), *(F.col(c).alias(f"__{c}") for c in _COUNTS))
    out = ends.join(begin, "end").select("end", *((F.col(c) - F.col(f"__{c}")).alias(c) for c in _COUNTS)).where("total > 0")
    return out.select(F.timestamp_seconds(F.col("end") - length).alias("start"), F.timestamp_seconds("end").alias("end"), *_COUNTS)


class _FeedbackChanges(StatefulProcessor):
    """State per (user, article): the actions that hold, each with the tags that the article had when it came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "action string", "tags string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        now = dict(before)
        for r in sorted(rows, key=lambda r: r.id):
            if r.op == "delete":
                now.pop(r.action, None)
            else:
                now.pop({"like": "dislike", "dislike": "like"}.get(r.action), None)
                now.setdefault(r.action, r.tags)
        for action in sorted(before.keys() | now.keys()):
            if before.get(action, self) == now.get(action, self):
                continue
            for held, sign in ((before, -1), (now, 1)):
                if action in held:
                    yield Row(user_id=key[0], news_id=key[1], action=action, sign=sign, tags=held[action])
            if action in now:
                self.held.updateValue((action,), (now[action],))
            else:
                self.held.removeKey((action,))

    def close(self) -> None:
        pass


_TAGS = "tickers array<string>, sectors array<string>"


def feedback_changes(stream: DataFrame, articles: DataFrame) -> DataFrame:
    """``(id, user_id, news_id, action, op)`` -> signed changes ``(user_id, news_id, action, sign, tickers, sectors)`` of the feedback that holds: 1 where an action came, -1 where one was
    deleted, or replaced by its opposite. An article counts, and is taken back, with the tags that it had when the feedback came; feedback on unknown articles drops."""
    known = stream.where(F.col("action").isin(*ACTIONS)).select("id", "user_id", "news_id", "action", "op")
    tags = articles.select(F.col("id").alias("news_id"), F.to_json(F.struct("tickers", "sectors")).alias("tags"))
    rows = known.join(tags, "news_id").groupBy("user_id", "news_id")
    out = rows.transformWithState(_FeedbackChanges(), "user_id string, news_id long, action string, sign int, tags string", "Append", "None")
    return out.select("user_id", "news_id", "action", "sign", F.from_json("tags", _TAGS).alias("t")).select("user_id", "news_id", "action", "sign", "t.*")


SUMS = "user_id string, kind string, tag string, sum double, n long, bucket int"
SCORES = "user_id string, kind string, tag string, score double, batch long, bucket int"
USER_BUCKETS = 64


class Affinity:
    """Users' affinities: sums of signed changes and scores, each batch's beside the others, in buckets of users. A user's scores are those of the last batch that touched the user."""

    def __init__(self, spark: SparkSession, path: str):
        self.sums, self.scores = (Parts(spark, f"{path.rstrip('/')}/{x}", ("bucket",)) for x in ("sums", "scores"))

    def read(self, below: int | None = None) -> DataFrame:
        return self._newest(below).where("kind <> ''").select("user_id", "kind", "tag", "score")

    def _newest(self, below: int | None = None) -> DataFrame:
        all_ = self.scores.read(SCORES, below)
        last = all_.groupBy("user_id").agg(F.max("batch").alias("batch"))
        return all_.join(last, ["user_id", "batch"], "left_semi")

    def apply(self, changes: DataFrame, n: int, compact_every: int) -> None:
        """Adds batch n's changes. Reads and writes the sums of touched users' buckets, and writes touched users' scores."""
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).cast("int").alias("bucket")
        if n and n % compact_every == 0:
            self.sums.compact(self.sums.read(SUMS, n).groupBy("user_id", "kind", "tag", "bucket").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).where("n <> 0"), n)
            self.scores.compact(self._newest(n), n)
        self.sums.write(signed_sums(changes).select("*", bucket), n)
        new = self.sums.read(SUMS, n + 1, n - 1)
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most USER_BUCKETS
        users = new.select("user_id").distinct()
        own = self.sums.read(SUMS, n + 1).where(F.col("bucket").isin(touched) if touched else F.lit(False)).join(users, "user_id", "left_semi")
        scores = affinity_scores(own).select("user_id", "kind", "tag", "score")
        # a row without a kind tells that the user was touched, even where no tag is left
        mark = users.select("user_id", F.lit("").alias("kind"), F.lit("").alias("tag"), F.lit(0.0).alias("score"))
        self.scores.write(scores.unionByName(mark).select("*", F.lit(n).cast("long").alias("batch"), bucket), n)


def affinity_refresh(stream: DataFrame, articles: DataFrame, path: str, checkpoint: str, every: str = "300 seconds", compact_every: int = 96, **trigger) -> StreamingQuery:
    """Keeps the ``Affinity`` at ``path`` equal to ``user_affinity`` of the feedback that holds, from a log of ``(id, user_id, news_id, action, op)``, at most once in ``every``.

    A deleted or replaced action is taken back. Only users that a batch touches are read and written anew.
    """
    table = Affinity(stream.sparkSession, path)

    def apply(batch: DataFrame, n: int) -> None:
        with Scratch(batch.sparkSession, "affinity") as scratch:
            table.apply(scratch.save(batch), n, compact_every)

    return feedback_changes(stream, articles).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": every})).start()
