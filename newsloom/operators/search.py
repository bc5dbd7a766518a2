"""Hybrid search: full text with synonyms, vectors and recency, for a table of queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.score import hybrid_score, recency
from newsloom.functions.text import query_tokens
from newsloom.operators.affinity import with_boost
from newsloom.operators.filters import SearchFilter, representatives_only, search_filters
from newsloom.operators.feed import exclude_dismissed
from newsloom.scratch import Scratch

#: Weights of the fields A, B and C in the rank, and the least cosine of a candidate without a text match.
FIELD_WEIGHT = {"A": 1.0, "B": 0.4, "C": 0.2}
MIN_COSINE = 0.5
#: Bound of the query table, whose vectors go to every executor.
MAX_QUERIES = 10_000
#: Rows of query terms up to which these are broadcast.
MAX_TERMS = 1_000_000
#: Articles times queries that are compared at a time.
CELLS = 1 << 20
WORD = r"(?U)[^\p{Alnum}]+"


def expand_queries(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``queries(query_id, text)``, ``lexicon(token, synonyms)`` -> ``(query_id, group_no, token, terms, expanded)``: an AND of OR groups, a token's own form first."""
    t = queries.select("query_id", F.posexplode(query_tokens(F.trim("text"))).alias("group_no", "token"))
    words = lexicon.select(F.lower("token").alias("__t"), "synonyms")
    out = t.join(words, F.lower("token") == F.col("__t"), "left")
    terms = F.array_distinct(F.concat(F.array(F.lower("token")), F.coalesce(F.transform("synonyms", lambda s: F.lower(s)), F.array().cast("array<string>"))))
    return out.select("query_id", "group_no", "token", terms.alias("terms"), (F.size(terms) > 1).alias("expanded"))


def search_postings(df: DataFrame, stem=lambda c: c, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``(id, term, pos, weight, n_pos)``: title A, summary B, ai_summary C, positions running on from field to field."""
    tokens = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), WORD), lambda w: w != "")
    t = df.select("id", tokens("title").alias("a"), tokens("summary").alias("b"), tokens("ai_summary").alias("c"))
    t = t.select("id", F.concat("a", "b", "c").alias("all"), F.size("a").alias("na"), (F.size("a") + F.size("b")).alias("nb"))
    stopped = F.col("term").isin(*stopwords) if stopwords else F.lit(False)
    number = F.size(F.filter("all", lambda w: ~w.isin(*stopwords))) if stopwords else F.size("all")
    # an outer explode: from an inner one Catalyst infers a filter that splits each text once more
    out = t.select("id", "na", "nb", number.alias("n_pos"), F.posexplode_outer("all").alias("i", "term")).where(F.col("term").isNotNull() & ~stopped)
    weight = F.when(F.col("i") < F.col("na"), "A").when(F.col("i") < F.col("nb"), "B").otherwise("C")
    return out.select("id", stem(F.col("term")).alias("term"), (F.col("i") + 1).alias("pos"), weight.alias("weight"), "n_pos")


def renewed_postings(postings: DataFrame, changed: DataFrame, **how) -> DataFrame:
    """``postings`` after the articles of ``changed`` were written: theirs are made anew, the others stay."""
    return postings.join(changed.select("id").distinct(), "id", "left_anti").unionByName(search_postings(changed, **how))


def _query_terms(expanded: DataFrame) -> DataFrame:
    """``(query_id, group_no, term, n_groups)``, each term of a group once."""
    terms = expanded.select("query_id", "group_no", F.explode("terms").alias("term")).dropDuplicates(["query_id", "group_no", "term"])
    return terms.join(expanded.groupBy("query_id").agg(F.count("*").alias("n_groups")), "query_id")


def _hits(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings of the queries' terms, the small side, which the planner can't tell from their plan."""
    return postings.join(F.broadcast(terms) if terms.count() <= MAX_TERMS else terms, "term")


def full_hits(hits: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``hits`` of queries of several groups those of documents that have every group.

    The group with the fewest hits goes first: only documents that have it are looked at further, so what is shuffled shrinks with the rarest group, however frequent the others are.
    """
    hits = scratch.save(hits.select("query_id", "id", "group_no", "pos", "weight", "n_pos", "n_groups"))
    counts = hits.groupBy("query_id", "group_no").agg(F.count("*").alias("n"))
    rarest = counts.groupBy("query_id").agg(F.min_by("group_no", F.struct("n", "group_no")).alias("group_no"), F.count("*").alias("found"))
    able = scratch.save(hits.join(F.broadcast(rarest), ["query_id", "group_no"]).where("found = n_groups").select("query_id", "id").distinct())  # rarest: one row a query
    hits = hits.join(able, ["query_id", "id"], "left_semi")
    one = Window.partitionBy("query_id", "id")
    bit = F.when(F.col("group_no") < 63, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("group_no").cast("int")))  # a query's first 63 groups
    got = F.bit_count(F.coalesce(F.bit_or(bit).over(one), F.lit(0).cast("long"))) + F.size(F.collect_set(F.when(F.col("group_no") >= 63, F.col("group_no"))).over(one))
    return hits.withColumn("got", got).where("got = n_groups").drop("got")


def fts_candidates(expanded: DataFrame, postings: DataFrame) -> DataFrame:
    """``(query_id, id, group_no, pos, weight, n_pos, n_groups)``: hits of documents that have a term of every group. A query of one group needs no shuffle for that."""
    terms = _query_terms(expanded)
    one, many = terms.where("n_groups = 1"), terms.where("n_groups > 1")
    out = _hits(one, postings).select("query_id", "id", "group_no", "pos", "weight", "n_pos", "n_groups")
    return out if many.isEmpty() else out.unionByName(full_hits(_hits(many, postings), Scratch(postings.sparkSession, "hits")))


def single_group_rank(hits: DataFrame) -> DataFrame:
    """The rank where a query is one group: each hit is a cover by itself, so the weights add up; damped by 1 + log of the document's length."""
    weight = F.sum(F.create_map(*(x for k, v in FIELD_WEIGHT.items() for x in (F.lit(k), F.lit(v))))[F.col("weight")])
    one = hits.where("n_groups = 1")
    return one.groupBy("query_id", "id").agg((weight / (1 + F.log(F.max("n_pos").cast("double")))).alias("fts_raw"))


def covers(positions: list[tuple[int, int, str]], groups: int) -> float:
    """Sum over the minimal spans that hold every group: (groups / sum of 1/weight) over 1 plus the positions that no group fills."""
    total, start = 0.0, 0
    while True:
        seen, end = set(), -1
        for i in range(start, len(positions)):
            seen.add(positions[i][1])
            if len(seen) == groups:
                end = i
                break
        if end < 0:
            return total
        begin, seen = end, {positions[end][1]}
        while len(seen) < groups:  # back to the last place from which all groups are held
            begin -= 1
            seen.add(positions[begin][1])
        span = positions[begin : end + 1]
        noise = max(0, (span[-1][0] - span[0][0]) - (len(span) - 1))
        total += len(span) / sum(1.0 / FIELD_WEIGHT[w] for _, _, w in span) / (1 + noise)
        start = begin + 1


def cover_density_rank(hits: DataFrame) -> DataFrame:
    """``(query_id, id, fts_raw)`` for queries of any number of groups. One group needs no Python; of more, each document's sorted hits are ranked in Arrow batches."""

    @F.pandas_udf("double")
    def rank(hits: pd.Series, groups: pd.Series, size: pd.Series) -> pd.Series:
        value = [covers([(h["pos"], h["group_no"], h["weight"]) for h in part], int(n)) for part, n in zip(hits, groups, strict=True)]
        return pd.Series(value, dtype="float64") / (1 + np.log(size.astype("float64")))

    place = F.sort_array(F.collect_set(F.struct("pos", "group_no", "weight")))  # hits of one document
    many = hits.where("n_groups > 1").groupBy("query_id", "id").agg(place.alias("hits"), F.max("n_groups").alias("groups"), F.max("n_pos").alias("size"))
    return single_group_rank(hits).unionByName(many.select("query_id", "id", rank("hits", "groups", "size").alias("fts_raw")))


def text_scores(expanded: DataFrame, postings: DataFrame) -> DataFrame:
    """``cover_density_rank`` of the candidates, with the postings read once for queries of one group and, where there are others, once for these."""
    terms = _query_terms(expanded)
    one, many = terms.where("n_groups = 1"), terms.where("n_groups > 1")
    out = single_group_rank(_hits(one, postings))
    if many.isEmpty():
        return out
    hits = full_hits(_hits(many, postings), Scratch(postings.sparkSession, "hits"))
    return cover_density_rank(hits) if one.isEmpty() else out.unionByName(cover_density_rank(hits))


def query_matrix(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted query ids, and their unit vectors as rows; a missing vector is zeros. Refuses more than ``MAX_QUERIES``."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; ask them in parts")
    rows.sort(key=lambda r: r["query_id"])
    size = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=1)
    q = np.array([r["vector"] if r["vector"] is not None else [0.0] * size for r in rows], dtype=np.float64).reshape(-1, size)
    norm = np.linalg.norm(q, axis=1)
    return np.array([r["query_id"] for r in rows], dtype=np.int64), q / np.where(norm > 0, norm, 1)[:, None]


def candidates(pool: DataFrame, text: DataFrame, queries: DataFrame) -> DataFrame:
    """``pool(id, last_seen_at, embedding)``, ``text(query_id, id, fts_raw)`` -> ``(query_id, id, last_seen_at, fts_raw, cos_score)``.

    A pair is a candidate by its text or by a cosine of ``MIN_COSINE``. Each article meets all queries at once, as a row of a matrix product.
    """
    ids, matrix = query_matrix(queries)
    hits = text.groupBy("id").agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("query_id"), "fts_raw")).alias("hits"))  # at most one a query

    def run(batches):
        step = max(16, CELLS // max(len(ids), 1))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                lists = part.column("embedding")
                rows = np.flatnonzero(np.asarray(pc.is_valid(lists)))
                cos = np.zeros((part.num_rows, len(ids)))
                if len(rows):
                    m = np.asarray(pc.list_flatten(lists), dtype=np.float64).reshape(len(rows), -1)
                    norm = np.linalg.norm(m, axis=1)
                    cos[rows] = (m / np.where(norm > 0, norm, 1)[:, None]) @ matrix.T
                found = part.column("hits")
                fts, is_text = np.zeros(cos.shape), np.zeros(cos.shape, dtype=bool)
                flat = pc.list_flatten(found)
                at = np.asarray(pc.list_parent_indices(found)), np.searchsorted(ids, np.asarray(flat.field("query_id")))
                fts[at], is_text[at] = np.asarray(flat.field("fts_raw")), True
                i, j = np.nonzero(is_text | (cos >= MIN_COSINE - 1e-12))
                cols = [pa.array(ids[j]), part.column("id").take(pa.array(i)), part.column("last_seen_at").take(pa.array(i)), pa.array(fts[i, j]), pa.array(np.maximum(cos[i, j], 0.0))]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "id", "last_seen_at", "fts_raw", "cos_score"])

    met = pool.join(hits, "id", "left").select(F.col("id").cast("long").alias("id"), "last_seen_at", "embedding", "hits")
    return met.mapInArrow(run, "query_id long, id long, last_seen_at timestamp, fts_raw double, cos_score double")


def hybrid_search(
    articles: DataFrame, postings: DataFrame, queries: DataFrame, lexicon: DataFrame, as_of: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1),
    filters: SearchFilter | None = None, page: int = 1, size: int = 20, dedup: bool = False, hide_dismissed: bool = True, feedback: DataFrame | None = None,
    affinity: DataFrame | None = None, user: str | None = None, rank=None,
) -> DataFrame:
    """``queries(query_id, text, vector)`` -> a page of results per query with its scores and ``total``.

    Candidates match the text or have a cosine of ``MIN_COSINE``; filters come before the text score's maximum is taken, so they change
    scores. Queries are a small table; articles are scanned once for all of them. Personalisation re-sorts within the page.
    """
    pool = search_filters(articles, filters or SearchFilter())
    if dedup:
        pool = pool.where(representatives_only())
    if hide_dismissed and feedback is not None and user is not None:
        pool = exclude_dismissed(pool, feedback, user)
    expanded = expand_queries(queries, lexicon)
    text = text_scores(expanded, postings) if rank is None else rank(fts_candidates(expanded, postings))
    rows = candidates(pool.select("id", "last_seen_at", "embedding"), text, queries)
    rows = rows.withColumn("recency", recency(F.col("last_seen_at"), as_of))
    top = rows.groupBy("query_id").agg(F.max("fts_raw").alias("best"), F.count("*").alias("total"))
    # a page's rows are the best of its query by the sum with the text score over its maximum: one small row a query
    rows = rows.join(F.broadcast(top), "query_id").withColumn("fts_score", F.when(F.col("best") > 0, F.col("fts_raw") / F.col("best")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("final_score", hybrid_score(F.col("fts_score"), F.col("cos_score"), F.col("recency"), weights))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("id"))
    size = max(1, min(100, size))
    paged = rows.withColumn("position", F.row_number().over(order)).where((F.col("position") > (page - 1) * size) & (F.col("position") <= page * size))
    out = paged.select("query_id", "id", "position", "fts_score", "cos_score", "recency", "final_score", "total")
    if affinity is not None and user is not None:
        tags = with_boost(articles.join(out.select("id").distinct(), "id", "left_semi").select("id", "tickers", "sectors"), affinity, user).select("id", "boost")
        out = out.join(tags, "id").withColumn("final_score", F.col("final_score") * (1 + F.col("boost"))).drop("boost")
        again = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("id"))
        out = out.withColumn("position", F.row_number().over(again) + (page - 1) * size)
    return out


def with_articles(page: DataFrame, articles: DataFrame) -> DataFrame:
    """The page's rows with their articles' wide columns, read for these ids only."""
    return page.join(articles, "id").orderBy("query_id", "position")
