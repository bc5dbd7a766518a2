"""Stories over a moving window: what a step costs grows with the articles that come and go, not with the window squared.

What is kept between steps are the window's articles (as they were compared), their nearest neighbours, which of these edges pass the text tests, and the assignments. A step compares new articles with the
window, and once more those that lost one of their nearest neighbours, as a further one may take its place. The text tests are made for new edges only, and components
are made anew only where an edge or an article came or went. The result is that of ``cluster_articles`` over the window.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.cluster import ClusterParams, _best, _top, _unit, assignments, edge_verdicts
from newsloom.operators.filters import recent_window
from newsloom.scratch import Scratch

COMPARED = ["id", "title", "summary", "ai_summary", "language", "tickers", "last_seen_at", "embedding"]
EDGES = "a_id long, b_id long, sim double, kept boolean"
ASSIGNED = "id long, cluster_rep_id long, cluster_size int, similarity_to_rep double"


@dataclass
class StoryWindow:
    """State between steps, as written tables."""

    articles: DataFrame
    edges: DataFrame
    assigned: DataFrame


def empty_window(df: DataFrame) -> StoryWindow:
    """The state before the first step over articles like ``df``."""
    spark = df.sparkSession
    return StoryWindow(df.select(*COMPARED).limit(0), spark.createDataFrame([], EDGES), spark.createDataFrame([], ASSIGNED))


def delta_pairs(some: DataFrame, window: DataFrame, threshold: float, k: int, block_rows: int = 2000) -> DataFrame:
    """``(a_id, b_id, sim)``: pairs over the threshold of articles of ``some(id)`` with those of the window (itself included), a the lesser id, of each a the k most similar in each block.

    Both sides are dealt into blocks by hash; each pair of blocks is one matrix product. As many pairs are formed as ``some`` has rows times the window's.
    """
    blocks = lambda n: max(1, ceil(n / block_rows))
    left, right = blocks(some.count()), blocks(window.count())
    at = lambda n, name: F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of_some = window.join(some.select("id"), "id", "left_semi").select("id", "embedding", F.lit(True).alias("own"), at(left, "x")).withColumn("y", each(right))
    of_all = window.select("id", "embedding", F.lit(False).alias("own"), at(right, "y")).withColumn("x", each(left))

    def product(t: pa.Table) -> pa.Table:
        ids, own = t["id"].to_numpy(), np.asarray(t["own"].combine_chunks().cast(pa.int8())).astype(bool)
        m = _unit(t["embedding"].combine_chunks(), len(ids))
        mine, all_ = np.flatnonzero(own), np.flatnonzero(~own)
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        for s in range(0, len(mine), 512):
            part = mine[s : s + 512]
            sim = m[part] @ m[all_].T
            i, j = np.nonzero(sim >= threshold - 1e-12)
            p, q = ids[part[i]], ids[all_[j]]
            keep = p != q
            found = [np.minimum(p, q)[keep], np.maximum(p, q)[keep], sim[i, j][keep]]
            held = _best([np.concatenate([x, y]) for x, y in zip(held, found, strict=True)], 2 * k)  # a pair may come twice, once from each side
        return pa.table(dict(zip(("a_id", "b_id", "sim"), held, strict=True)))

    pairs = of_some.select("x", "y", "id", "embedding", "own").unionByName(of_all.select("x", "y", "id", "embedding", "own"))
    found = pairs.groupBy("x", "y").applyInArrow(product, "a_id long, b_id long, sim double")
    return found.groupBy("a_id", "b_id").agg(F.max("sim").alias("sim"))


def move_window(state: StoryWindow, df: DataFrame, as_of: Column, p: ClusterParams = ClusterParams()) -> StoryWindow:
    """The state after a step: ``df`` are all articles at ``as_of``, of which those of the window that have a vector count.

    An article that changed in what is compared goes and comes anew; one that was only seen again keeps its edges and has its story's representative chosen anew. An article has one row. A null id is
    no article. An empty window has no stories.
    """
    scratch = Scratch(df.sparkSession, "moving")
    now = scratch.save(recent_window(df, "last_seen_at", p.window_days, "days", as_of).where("embedding is not null and id is not null").select(*COMPARED))
    mark = lambda name: F.xxhash64(*(c for c in COMPARED if c not in ("id", "last_seen_at"))).alias(name)
    both = state.articles.select("id", mark("was"), F.col("last_seen_at").alias("was_seen")).join(now.select("id", mark("is"), F.col("last_seen_at").alias("is_seen")), "id", "full")
    both = scratch.save(both.where("was is null or is is null or was <> is or not (was_seen <=> is_seen)"))
    gone, new = both.where("was is not null and (is is null or was <> is)").select("id"), both.where("is is not null and (was is null or was <> is)").select("id")
    seen = both.where("was = is").select("id")

    # neighbours: of those that lost one of a full list, the next may be further away than any that is kept
    side = lambda c: gone.select(F.col("id").alias(c))
    rest = scratch.save(state.edges.join(side("a_id"), "a_id", "left_anti").join(side("b_id"), "b_id", "left_anti"))
    full = state.edges.groupBy("a_id").agg(F.count("*").alias("n")).where(F.col("n") >= p.knn).select("a_id")
    lost = state.edges.join(side("b_id"), "b_id", "left_semi").join(side("a_id"), "a_id", "left_anti").select("a_id").distinct().join(full, "a_id", "left_semi").select(F.col("a_id").alias("id"))
    again = scratch.save(new.union(lost).distinct())
    met = delta_pairs(again, now, p.threshold, p.knn, p.block_rows)
    old = rest.join(met.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select("a_id", "b_id", "sim")
    near = scratch.save(_top(old.unionByName(met), p.knn).select("a_id", "b_id", "sim"))
    fresh = near.join(rest.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    verdicts = edge_verdicts(fresh, now, p).select("a_id", "b_id", "sim", F.col("reason").isNull().alias("kept"))
    held = near.join(rest.select("a_id", "b_id", "kept"), ["a_id", "b_id"]).select("a_id", "b_id", "sim", "kept")
    edges = scratch.save(held.unionByName(verdicts))

    # stories: those that an edge or an article came to or left
    pairs = lambda e: e.where("kept").select("a_id", "b_id")
    moved = pairs(edges).exceptAll(pairs(state.edges)).union(pairs(state.edges).exceptAll(pairs(edges)))
    hit = moved.select(F.col("a_id").alias("id")).union(moved.select(F.col("b_id").alias("id"))).union(gone).union(new).union(seen)
    story = state.assigned.select("id", F.coalesce("cluster_rep_id", "id").alias("story"))
    touched = story.join(hit, "id", "left_semi").select("story").distinct()
    redo = scratch.save(story.join(touched, "story", "left_semi").select("id").union(hit).distinct().join(now.select("id"), "id", "left_semi"))
    own = now.join(redo, "id", "left_semi").select("id", "last_seen_at", "embedding")
    inner = pairs(edges).join(redo.select(F.col("id").alias("a_id")), "a_id", "left_semi")  # both ends of a kept edge are in one story
    made = assignments(own, inner, scratch)
    kept = state.assigned.join(redo, "id", "left_anti").join(gone, "id", "left_anti")
    return StoryWindow(now, edges, scratch.save(kept.unionByName(made.select(*kept.columns))))
