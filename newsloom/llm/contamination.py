"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has next to no Jaccard similarity with it, so MinHash signatures of whole documents can't be
compared. Instead only the items are sketched: for each of k hash functions the item's shingle of least hash. The share of
these shingles that a document holds estimates how much of the item it contains. Items are partitioned by size: a small item takes all
its shingles' worth of functions, a large one more, and each partition has the number of sketch hits below which
an item contained to the threshold falls with a probability under ``MISS``. What passes is verified on the exact shingle sets.

DataFrame functions only. Documents aren't shuffled in the search; sketches and item sets are broadcast up to ``BROADCAST_ROWS`` rows of either,
beyond that both sides are shuffled by shingle.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.scratch import Scratch

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-7
#: Least size (in shingles) of each partition, and its number of hash functions.
PARTITIONS = ((1, 24), (16, 32), (64, 40), (256, 48))
BROADCAST_ROWS = 1_000_000


def least_hits(k: int, share: float = THRESHOLD, miss: float = MISS) -> int:
    """Largest number of hits that a sketch of k functions has but with a probability under ``miss`` at containment ``share``."""
    below, m = 0.0, 0
    while m < k and (below := below + comb(k, m) * share**m * (1 - share) ** (k - m)) < miss:
        m += 1
    return max(1, m)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_array(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of all runs of k words; fewer words make one shingle, no words none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
    return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.xxhash64(w, F.lit(k)))).otherwise(F.array().cast("array<bigint>"))


def shingles(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(name, h) for every shingle; repeats within a text stay."""
    held = df.select(F.col(id_col).cast("long").alias(name), words(F.col(text_col)).alias("w"))
    return held.select(name, F.explode(shingle_array(F.col("w"))).alias("h"))


def item_sketches(item_shingles: DataFrame) -> DataFrame:
    """``(item, h)`` distinct -> ``(item, h, j, need)``: the least shingle under each of the item's hash functions."""
    sized = item_shingles.join(item_shingles.groupBy("item").agg(F.count("*").alias("n")), "item")
    k, need = F.lit(PARTITIONS[0][1]), F.lit(least_hits(PARTITIONS[0][1]))
    for size, functions in PARTITIONS[1:]:
        k = F.when(F.col("n") >= size, functions).otherwise(k)
        need = F.when(F.col("n") >= size, least_hits(functions)).otherwise(need)
    tried = sized.select("item", "h", need.alias("need"), F.explode(F.sequence(F.lit(1), k)).alias("j"))
    return tried.groupBy("item", "j", "need").agg(F.min_by("h", F.struct(F.xxhash64("h", "j"), "h")).alias("h")).select("item", "h", "j", "need")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` of every item that a document contains to the threshold.

    Nulls, blanks and items without words are contained in nothing; an item of under five words only in a text of just these words.
    Repeated rows of one id are taken together; rows with a null id are passed over; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "contamination")
    item_set = scratch.save(shingles(items, item_col, text_col, "item").where("item is not null").distinct())
    sketch = scratch.save(item_sketches(item_set))
    most = max(item_set.count(), sketch.count())  # three 8-byte values a row
    small = F.broadcast if most <= BROADCAST_ROWS else (lambda x: x)
    hits = shingles(docs.where(F.col(id_col).isNotNull()), id_col, text_col, "doc").join(small(sketch), "h")
    found = hits.groupBy("doc", "item", "need").agg(F.countDistinct("j").alias("hits")).where("hits >= need")
    candidates = scratch.save(found.select("doc", "item"))
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(candidates.select("doc").distinct(), "doc", "left_semi")
    sizes = item_set.groupBy("item").agg(F.count("*").alias("n_item"))
    shared = shingles(own, "doc", "text", "doc").join(small(item_set), "h").distinct().join(candidates, ["doc", "item"])
    counts = shared.groupBy("doc", "item").agg(F.count("*").alias("n_shared")).join(small(sizes), "item")
    counts = counts.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6))
    return counts.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item")).select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_item", "containment"
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay, and rows with a null id too."""
    return docs.join(contained_items(docs, items, id_col=id_col).select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)


#: The same pairs by exact containment alone.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment FROM c JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_item
"""
