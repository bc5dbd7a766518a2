"""Stories: a similarity graph over recent articles, edges filtered on their texts, and its components."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial, reduce
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.score import cosine
from newsloom.operators.components import connected_components
from newsloom.operators.filters import recent_window
from newsloom.scratch import Scratch


#: Windows of more articles than this are compared by index where ``ClusterParams.indexed`` says neither.
INDEX_FROM = 20_000
#: Vectors move to their groups in rounds that write at most so many bytes, or two copies of them all if that is more. An index that forms a larger share of all pairs than ``WORTH`` isn't one.
ROUND_BYTES, WORTH = 128 << 20, 0.1
#: Rows of a block of all pairs at least, and numbers in it at most.
LEAST_ROWS, MOST_NUMBERS = 2000, 1 << 20


@dataclass(frozen=True)
class ClusterParams:
    """``indexed``: whether similar vectors are looked for by ``knn_edges_indexed`` (True), which meets 0.97 of the pairs at the threshold and more of closer ones, by comparing all (False), or by
    the first from ``INDEX_FROM`` articles on (None)."""

    window_days: int = 7
    threshold: float = 0.80
    same_lang_cosine: float = 0.85
    knn: int = 30
    min_overlap: int = 2
    min_ratio: float = 0.30
    min_body_jaccard: float = 0.15
    stopwords: dict[str, tuple[str, ...]] | None = None
    block_rows: int = 2000
    indexed: bool | None = None


def _best(parts: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns (a, b, similarity) each a's k best."""
    a, b, sim = parts
    order = np.lexsort((b, -sim, a))
    a, b, sim = a[order], b[order], sim[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return [x[place < k] for x in (a, b, sim)]


def _unit(lists: pa.Array, rows: int) -> np.ndarray:
    m = np.asarray(lists.flatten(), dtype=np.float64).reshape(rows, -1)
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm > 0, norm, 1)[:, None]


def _dots(columns: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the vectors i and j of ``columns(dimension, vector)``, added up one dimension after the other as in SQL."""
    out = np.zeros(len(i))
    for c in columns:
        out += c[i] * c[j]
    return out


def _products(dealt: DataFrame, by: tuple[str, ...], threshold: float, k: int) -> DataFrame:
    """``dealt(*by, x, y, b, id, embedding)`` -> pairs over the threshold of each group's blocks x and y.

    One matrix product a group finds them, in single precision and with room for what that loses. A product's last digits depend on the place of a vector in the matrix, so that equal
    vectors would come in any order: of the pairs found the similarity is worked out again, one by one. ``least``, where given, is what a row's similarity to a larger id must reach.
    """

    def product(t: pa.Table) -> pa.Table:
        ids, b = t["id"].to_numpy(), t["b"].to_numpy()
        lists = t["embedding"].combine_chunks()
        m = _unit(lists, len(ids)).astype(np.float32)
        margin = (m.shape[1] + 4) * 2.0**-23  # what rounding can make of a product of unit vectors, twice over
        columns = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(ids), -1).T.copy()
        squares = _dots(columns, np.arange(len(ids)), np.arange(len(ids)))
        low, high = int(t["x"][0].as_py()), int(t["y"][0].as_py())
        left, right = np.flatnonzero(b == low), np.flatnonzero(b == high)
        least = t["least"].to_numpy() if "least" in t.column_names else np.full(len(ids), -np.inf)
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        others, rows, more = m[right].T, max(1, MOST_NUMBERS // max(1, len(right))), 0
        for a in range(0, len(left), rows):
            part = left[a : a + rows]
            sim = m[part] @ others
            at = np.flatnonzero(sim >= np.float32(threshold - margin))
            sim, i, j = sim.ravel()[at], part[at // len(right)], right[at % len(right)]
            keep = (ids[i] != ids[j]) if low != high else (ids[i] < ids[j])
            keep &= sim >= least[np.where(ids[i] < ids[j], i, j)] - margin
            i, j = i[keep], j[keep]
            norms = np.sqrt(squares[i] * squares[j])
            sim = _dots(columns, i, j) / np.where(norms > 0, norms, 1)
            keep = sim >= threshold - 1e-12
            p, q = ids[i[keep]], ids[j[keep]]
            found = [np.minimum(p, q), np.maximum(p, q), sim[keep]]
            held, more = [np.concatenate([x, y]) for x, y in zip(held, found, strict=True)], more + len(p)
            if more > max(MOST_NUMBERS // 4, k * len(ids)):  # so about twice k an article are held, however alike the articles are
                held, more = _best(held, k), 0
        held = _best(held, k)
        return pa.table(dict(zip(("a_id", "b_id", "sim"), held, strict=True)))

    return dealt.groupBy(*by, "x", "y").applyInArrow(product, "a_id long, b_id long, sim double")


def _dealt(held: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own is in, blocks dealt by hash of the id."""
    held = held.withColumn("b", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return held.withColumn("x", F.least("b", "o")).withColumn("y", F.greatest("b", "o")).drop("o")


def _top(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy(F.desc("sim"), "b_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def knn_edges(vectors: DataFrame, threshold: float, k: int = 30, block_rows: int = 2000) -> DataFrame:
    """``vectors(id, embedding)`` -> ``(a_id, b_id, sim)``: per a the k most similar b with a larger id, cosine from ``threshold`` up. Exact.

    Rows are dealt into blocks by hash, each pair of blocks is one matrix product, and of each article only its k best over the threshold leave it.
    The work is that of all pairs; ``knn_edges_indexed`` is for large windows.
    """
    held = vectors.select("id", "embedding").where("id is not null and embedding is not null")
    return _top(_products(_dealt(held, F.lit(max(1, ceil(held.count() / block_rows)))), (), threshold, k), k)


def index_shape(n: int, threshold: float, block_rows: int, recall: float) -> tuple[int, int]:
    """Planes of a band, and bands: of vectors in all directions, ``bands / 2 ** planes`` of all pairs are compared."""
    bits = max(2, ceil(log2(max(1, n / block_rows))))
    met = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - met))) if met < 1 else 1


def _in_rounds(held: DataFrame, deals: list, by: tuple[str, ...], threshold: float, k: int) -> DataFrame:
    """The best pairs of all ``deals``, functions that deal rows out to groups. Each is written before the next, so the disk holds the vectors of one of them and a few times k pairs an article.

    A row takes the similarity along that its k pairs so far have, and leaves pairs below it out: they can't be among its k best. What rounds find is put together after twice as many rounds
    each time, as so few pairs are left that each such span adds no more than all before it; after each round where groups overlap (``by``), as they find the same pairs again.
    """
    scratch = Scratch(held.sparkSession, "pairs")
    parts, reached = [], None
    for i, deal in enumerate(deals):
        rows = held if reached is None else held.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        parts.append(scratch.save(_products(deal(rows), by, threshold, k)))
        if by or i & (i + 1) == 0 or i + 1 == len(deals):
            pairs = reduce(DataFrame.unionByName, parts)
            best = scratch.save(_top(pairs.groupBy("a_id", "b_id").agg(F.max("sim").alias("sim")) if by else pairs, k))
            for was in [*parts, *([] if reached is None else [reached])]:
                scratch.drop(was)
            parts, reached = [best], None
            if i + 1 < len(deals):
                reached = scratch.save(best.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"), F.min("sim").alias("least")).where(F.col("n") >= k).drop("n"))
    return parts[0]


def _all_pairs(held: DataFrame, n: int, dim: int, copies: int, threshold: float, k: int) -> DataFrame:
    """``knn_edges`` in rounds: block b meets block b + o, for some steps o at a time, so a round writes each vector twice a step and not once a block."""
    blocks = ceil(n / max(1, min(MOST_NUMBERS // max(1, dim), max(LEAST_ROWS, ceil(n / 16)))))
    steps, size = list(range(blocks // 2 + 1)), max(1, copies // 2)

    def deal(some: list[int], rows: DataFrame) -> DataFrame:
        b, x, o = F.col("b"), F.col("x"), F.col("o")
        out = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("o", F.explode(F.array(*map(F.lit, some))))
        out = out.withColumn("x", F.explode(F.when(o == 0, F.array(b)).otherwise(F.array(b, F.pmod(b - o, F.lit(blocks))))))
        out = out.where((2 * o != blocks) | (x < o))  # halfway round, two blocks meet from either side
        return out.withColumn("y", F.pmod(x + o, F.lit(blocks))).drop("o")

    return _in_rounds(held, [partial(deal, steps[i : i + size]) for i in range(0, len(steps), size)], (), threshold, k)


def knn_edges_indexed(vectors: DataFrame, threshold: float, k: int = 30, block_rows: int = 2000, recall: float = 0.97, seed: int = 7) -> DataFrame:
    """As ``knn_edges``, but compares only vectors on the same sides of some random planes: a pair at the threshold is met with probability ``recall``, a closer one with more.

    Each of several bands has as many planes as make a bucket of about ``block_rows`` rows, and there are as many bands as the recall asks. All rows are in every band. A bucket that is
    larger is dealt into blocks like a table of its own, so no group grows with the data. Similarities are exact. Where the copies of all bands are more than ``ROUND_BYTES``, some bands
    follow others in rounds, written as they go; or, where the bands form much of all pairs (at a low threshold), all pairs are compared in rounds and every pair is met.
    """
    held = vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id is not null and embedding is not null")
    kind = "array<double>" if "double" in held.schema["embedding"].dataType.simpleString() else "array<float>"
    held = held.withColumn("embedding", F.col("embedding").cast(kind))
    n, dim = held.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    bits, bands = index_shape(n, threshold, block_rows, recall)
    copies = max(2, ROUND_BYTES // max(1, n * (dim * (8 if "double" in kind else 4) + 40)))
    if bands > copies and bands / 2**bits > WORTH:
        return _all_pairs(held, n, dim, copies, threshold, k)

    def deal(low: int, high: int, rows: DataFrame) -> DataFrame:
        """Rows of the bands from ``low`` to ``high``, by bucket and blocks of it."""

        def sides(batches):
            planes = None
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    m = _unit(part.column("embedding"), part.num_rows)
                    if planes is None:
                        planes = np.random.default_rng(seed).normal(size=(m.shape[1], bits * bands))[:, bits * low : bits * high]
                    side = (m @ planes > 0).reshape(part.num_rows, high - low, bits)
                    key = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                    at = pa.array(np.repeat(np.arange(part.num_rows), high - low))
                    band = pa.array(np.tile(np.arange(low, high, dtype=np.int64), part.num_rows))
                    yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), band, pa.array(key.ravel())], names=[*part.schema.names, "band", "key"])

        told = rows.mapInArrow(sides, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("band", "long"), ("key", "long")]))
        large = told.groupBy("band", "key").agg(F.ceil(F.count("*") / block_rows).alias("blocks")).where("blocks > 1")
        told = told.join(large, ["band", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return _dealt(told, F.col("blocks")).drop("blocks")

    by = ("band", "key")
    if bands > copies:
        return _in_rounds(held, [partial(deal, low, min(bands, low + copies)) for low in range(0, bands, copies)], by, threshold, k)
    pairs = _products(deal(0, bands, held), by, threshold, k)
    return _top(pairs.groupBy("a_id", "b_id").agg(F.max("sim").alias("sim")), k)


def similar_pairs(vectors: DataFrame, threshold: float, p: ClusterParams) -> DataFrame:
    """The edges by the way that the parameters ask for."""
    indexed = vectors.count() > INDEX_FROM if p.indexed is None else p.indexed
    # smaller buckets form fewer pairs and need more bands; a quarter of a block's rows forms 9 % of all pairs of 100,000 at 0.8
    return knn_edges_indexed(vectors, threshold, p.knn, max(100, p.block_rows // 4)) if indexed else knn_edges(vectors, threshold, p.knn, p.block_rows)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs(a_id, b_id)`` with the cosine of their vectors."""
    side = lambda x: vectors.select(F.col("id").alias(f"{x}_id"), F.col("embedding").alias(f"__{x}"))
    out = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    return out.withColumn("sim", cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def edge_verdict(p: ClusterParams) -> Column:
    """Null for an edge that passes, or else the first reason against it, cheap tests first."""
    same = F.col("a_lang").eqNullSafe(F.col("b_lang"))
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    smaller = F.greatest(F.least(F.size("a_tokens"), F.size("b_tokens")), F.lit(1))
    bodies = (F.size("a_shingles") > 0) & (F.size("b_shingles") > 0)
    return (
        F.when(X.tickers_conflict(F.col("a_tickers"), F.col("b_tickers")), "ticker_conflict")
        .when(same & (F.col("sim") < p.same_lang_cosine), "cosine_below_same_lang")
        .when(same & (shared < p.min_overlap), "overlap_count")
        .when(same & (shared / smaller < p.min_ratio), "overlap_ratio")
        .when(same & bodies & (F.lit(p.min_body_jaccard) > 0) & (X.jaccard(F.col("a_shingles"), F.col("b_shingles")) < p.min_body_jaccard), "body_jaccard")
    )


def edge_verdicts(edges: DataFrame, articles: DataFrame, p: ClusterParams = ClusterParams()) -> DataFrame:
    """``edges(a_id, b_id, sim)`` with ``reason``; token sets are made once per article, not once per edge."""
    parts = articles.select(
        "id", F.coalesce("language", F.lit("")).alias("lang"), "tickers", X.title_tokens(F.col("title"), F.col("language"), p.stopwords).alias("tokens"),
        X.body_shingles(X.body_text(F.col("summary"), F.col("ai_summary"))).alias("shingles"),
    )
    side = lambda x: parts.select(*(F.col(c).alias(f"{x}_{c}") for c in parts.columns))
    return edges.join(side("a"), "a_id").join(side("b"), "b_id").withColumn("reason", edge_verdict(p)).select("a_id", "b_id", "sim", "reason")


def edge_reject_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def assignments(articles: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, cluster_rep_id, cluster_size, similarity_to_rep)`` from ``kept(a_id, b_id)``; the representative is the latest seen, then the greatest id."""
    comp = scratch.save(connected_components(articles.select("id"), kept.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")), scratch))
    members = comp.join(articles.select("id", "last_seen_at"), "id")
    story = members.groupBy("component").agg(F.max_by("id", F.struct("last_seen_at", "id")).alias("rep"), F.count("*").alias("size"))
    out = comp.join(story, "component")
    vectors = articles.select("id", "embedding").where("embedding is not null")
    pairs = out.where("size > 1 and id <> rep").select(F.col("id").alias("a_id"), F.col("rep").alias("b_id"))
    sims = pair_similarity(pairs, vectors).select(F.col("a_id").alias("id"), "sim")
    alone = F.col("size") == 1
    return out.join(sims, "id", "left").select(
        "id", F.when(~alone, F.col("rep")).alias("cluster_rep_id"), F.col("size").cast("int").alias("cluster_size"),
        F.when(~alone & (F.col("id") == F.col("rep")), F.lit(1.0)).when(~alone, F.col("sim")).alias("similarity_to_rep"),
    )


def cluster_articles(df: DataFrame, as_of: Column, p: ClusterParams = ClusterParams()) -> DataFrame:
    """Assignments of all articles of the window that have a vector."""
    scratch = Scratch(df.sparkSession, "stories")
    recent = scratch.save(recent_window(df, "last_seen_at", p.window_days, "days", as_of).where("embedding is not null").select("id", "title", "summary", "ai_summary", "language", "tickers", "last_seen_at", "embedding"))
    edges = similar_pairs(recent, p.threshold, p)
    kept = scratch.save(edge_verdicts(edges, recent, p).where("reason is null"))
    return assignments(recent, kept, scratch)


def clustering_stats(verdicts: DataFrame, assigned: DataFrame) -> DataFrame:
    a = assigned.agg(F.count("*").alias("considered"), F.count_if(F.col("cluster_size") > 1).alias("clustered"), F.max("cluster_size").cast("long").alias("largest"), F.count_distinct("cluster_rep_id").alias("stories"))
    v = verdicts.agg(F.count("*").alias("edges"), F.count_if(F.col("reason").isNull()).alias("kept"))
    return a.crossJoin(F.broadcast(v))  # one row each


def apply_assignments(articles: DataFrame, assigned: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Overwrites the cluster columns of the assigned articles and leaves the others; given ``as_of``, updated_at follows where one of them changes."""
    cols = ("cluster_rep_id", "cluster_size", "similarity_to_rep")
    a = assigned.select("id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in cols))
    out = articles.join(a, "id", "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in cols}
    if as_of is not None and "updated_at" in articles.columns:
        changed = reduce(lambda x, y: x | y, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols))
        new["updated_at"] = F.when(F.col("__hit") & changed, as_of).otherwise(F.col("updated_at")).alias("updated_at")
    return out.select(*(new.get(c, F.col(c)) for c in articles.columns))


def cluster_param_sweep(df: DataFrame, sweep: dict[str, dict], as_of: Column, p: ClusterParams = ClusterParams()) -> DataFrame:
    """``(params, size, stories)`` under several parameter sets; the edges are found once, at the lowest threshold."""
    scratch = Scratch(df.sparkSession, "sweep")
    sets = {name: replace(p, **change) for name, change in sweep.items()}
    recent = scratch.save(recent_window(df, "last_seen_at", p.window_days, "days", as_of).where("embedding is not null"))
    edges = scratch.save(similar_pairs(recent, min(s.threshold for s in sets.values()), p))
    out = None
    for name, s in sets.items():
        kept = edge_verdicts(edges.where(F.col("sim") >= s.threshold), recent, s).where("reason is null")
        sizes = assignments(recent, kept, scratch).where("cluster_rep_id = id").groupBy(F.lit(name).alias("params"), F.col("cluster_size").alias("size")).agg(F.count("*").alias("stories"))
        out = sizes if out is None else out.unionByName(sizes)
    return out


def similarity_eval(cases: DataFrame) -> DataFrame:
    """``cases(model, case, query_lang, doc_lang, related, cosine)`` -> per model: mean and least gap of related over unrelated, cross-language mean."""
    gap = cases.groupBy("model", "case").agg((F.avg(F.when(F.col("related"), F.col("cosine"))) - F.avg(F.when(~F.col("related"), F.col("cosine")))).alias("gap"))
    cross = cases.where(F.col("related") & (F.col("query_lang") != F.col("doc_lang"))).groupBy("model").agg(F.round(F.avg("cosine"), 6).alias("cross_mean"))
    return gap.groupBy("model").agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.min("gap"), 6).alias("min_gap")).join(cross, "model", "left")


def model_deltas(scores: DataFrame) -> DataFrame:
    """``scores(position, model, mean_gap, cross_mean)``: change from the model before, and a verdict on it."""
    w = Window.orderBy("position")  # as many rows as there are models
    out = scores.withColumn("gap_delta", F.col("mean_gap") - F.lag("mean_gap").over(w)).withColumn("cross_delta", F.col("cross_mean") - F.lag("cross_mean").over(w))
    up = F.when(F.col("gap_delta") > 0.05, 1).otherwise(0) + F.when(F.col("cross_delta") > 0.05, 1).otherwise(0)
    return out.withColumn("verdict", F.when(F.col("gap_delta").isNull(), "base").when(up == 2, "both").when(up == 1, "one").otherwise("none"))
