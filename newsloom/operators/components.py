"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from newsloom.scratch import Scratch

MAX_ROUNDS = 60
#: From so many edges on, each step of a round is written. A join of two written tables is one of two plain shuffles, which adaptive execution splits where a node is a
#: hub; a join over an aggregate by the same key can't be split. Results don't depend on it.
MANY_EDGES = 50_000


def _star(edges: DataFrame, keep) -> DataFrame:
    """Both star steps as joins with each node's least neighbour; no neighbour list is ever built. ``keep`` may write a step."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = keep(large.where("u <> v").distinct())
    # now every u > v; link the smaller neighbours of u, and u itself, with the least of them
    low = keep(large.groupBy("u").agg(F.min("v").alias("m")))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _counted(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and two sums of hashes, which are taken while they are written."""
    seen = Observation()
    hashes = F.sum(F.hash("u", "v").cast("long")).alias("s"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("t")
    out = scratch.save(edges.observe(seen, F.count("*").alias("n"), *hashes))
    got = seen.get
    return out, (got["n"], got["s"], got["t"])


def component_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` -> ``(u, v)`` with v the least node of u's component, for all u that aren't least themselves.

    Nulls and self edges are ignored, repeated edges count once, an empty table gives an empty one.
    Each round is written to the shared folder; only three numbers per round reach the driver.
    """
    now, stats = _counted(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), scratch)
    for _ in range(MAX_ROUNDS):
        if stats[0] == 0:
            return now
        steps: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            steps.append(scratch.save(df))
            return steps[-1]

        after, new = _counted(_star(now, keep if stats[0] >= MANY_EDGES else lambda df: df), scratch)
        for used in (now, *steps):
            scratch.drop(used)
        if new == stats:
            return after
        now, stats = after, new
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")


def connected_components(vertices: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``vertices(id)``, ``edges(u, v)`` -> ``(id, component)``; an isolated vertex is its own component."""
    scratch = scratch or Scratch(vertices.sparkSession, "components")
    labels = component_labels(edges, scratch).select(F.col("u").alias("id"), F.col("v").alias("component"))
    return (
        vertices.select("id").where("id is not null").distinct().join(labels, "id", "left")
        .select("id", F.coalesce("component", "id").alias("component"))
    )


def component_sizes(components: DataFrame) -> DataFrame:
    """Members of each component of ``(id, component)``."""
    return components.groupBy("component").agg(F.count("*").alias("members"))
