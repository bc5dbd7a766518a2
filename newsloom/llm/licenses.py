"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Any one to ``HEADER_LINES`` neighbouring lines of a text are a possible header, compared with the notices. A whole text of any length is a possible licence file,
compared with the licence texts and the notices. All are TF-IDF vectors; document frequencies are counted over all documents for all terms. A file without a
licence of its own takes that of the licence file in the nearest directory above it.

Few texts need comparing, by two bounds that lose nothing. A cosine is at most the length of the part of the template that is shared over the whole
template's. So a text that reaches the threshold has one of the template's ``marking_terms``, and what it has of a template is as long as the threshold asks.
A line without any term of a template only lowers the cosine of a header that begins or ends with it, so headers begin and end with lines that have one.

DataFrame functions only. What is broadcast are the templates' vectors, which the caller fixes, checked against ``MAX_TERMS``.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.contamination import words
from newsloom.llm.license_texts import NOTICES, TEXTS
from newsloom.scratch import Scratch

TEMPLATES = NOTICES
THRESHOLD = 0.6
#: A file that is nothing but a notice, and one that is a licence's text; of several near relatives the nearest counts.
FILE_THRESHOLD, TEXT_THRESHOLD = 0.85, 0.85
HEADER_LINES = 3
#: Bounds of what is broadcast: different terms, and terms of all templates together.
MAX_TERMS, MAX_VECTORS = 20_000, 200_000


def _terms(templates) -> list[str]:
    return sorted({w for _, text in templates for w in re.findall(r"[^\W_]+", text.lower())})


def marking_terms(templates, idf: dict[str, float], rare: float, threshold: float) -> list[str]:
    """Terms of which any text that reaches the threshold with a template has at least one.

    Of each template the commonest terms are left out as long as they are together shorter than the threshold;
    terms that no document has (not in ``idf``) are shared by nothing.
    """
    marks = set()
    for _, text in templates:
        weight = {w: (n * idf.get(w, rare)) ** 2 for w, n in Counter(re.findall(r"[^\W_]+", text.lower())).items()}
        room = max(0.0, threshold - 1e-6) ** 2 * sum(weight.values())  # scores are rounded to six places
        for w in sorted(weight.keys() & idf.keys(), key=lambda w: (idf[w], w)):
            if weight[w] < room:
                room -= weight[w]
            else:
                marks.add(w)
    return sorted(marks)


def parents(path: Column) -> Column:
    """Directories above a path, nearest first, up to the root (an empty string)."""
    parts = F.split(F.regexp_replace(F.coalesce(path, F.lit("")), "^/+", ""), "/+")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _has(w: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(w, F.array(*map(F.lit, terms)).cast("array<string>"))


def _best(rows: DataFrame, key: str, license: str, score: str) -> DataFrame:
    """Per key the greatest score, then the lesser licence name."""
    best = rows.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("b"))
    return best.select(key, F.col("b.license").alias(license), (-F.col("b.neg")).alias(score))


def headers(texts: DataFrame, known: list[str], marks: list[str], scratch: Scratch) -> DataFrame:
    """``texts(tkey, text)`` -> ``(tkey, key, segment)``: the runs of lines that may reach the threshold."""
    lines = F.split("text", "\r\n|\n|\r")
    held = texts.select("tkey", lines.alias("lines"), F.transform(lines, lambda x: _has(words(x), known)).alias("known"))
    held = scratch.save(held.where(F.exists("known", lambda x: x)))
    at = lambda i: F.get("known", i)
    ends = lambda i: F.transform(F.array(*map(F.lit, range(1, HEADER_LINES + 1))), lambda k: F.when(at(i) & at(i + k - 1), F.array_join(F.slice("lines", i + 1, k), " ")))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), ends))
    found = held.select("tkey", F.explode(F.array_distinct(runs)).alias("segment")).where(F.col("segment").isNotNull() & _has(words(F.col("segment")), marks))
    return scratch.save(found.select("tkey", F.md5("segment").alias("key"), "segment"))


def scan_licenses(
    files: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD,
    file_templates=TEXTS, file_threshold: float = FILE_THRESHOLD, text_threshold: float = TEXT_THRESHOLD,
) -> DataFrame:
    """``(doc_id, license, score, via)``, one row per row of ``files``; via is file, header, inherited or none.

    A licence file has its whole text's licence, another file its best header's, a file with neither what the nearest directory above holds.
    A null text has no header, a null path lies in the root. Ties go to the greater score, then the lesser licence name, and of two licence
    files in one directory to the one with the greater score. Repeated rows are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    every = [*templates, *file_templates]
    known, own_terms = _terms(every), _terms(templates)
    own = [Counter(re.findall(r"[^\W_]+", text.lower())) for _, text in every]
    if len(known) > MAX_TERMS or sum(map(len, own)) > MAX_VECTORS:
        raise ValueError(f"templates of {len(known)} different terms, {sum(map(len, own))} together, are too large to broadcast")
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    held = files.select(F.col(id_col).alias("id"), string(path_col).alias("path"), string(text_col).alias("text"))
    # document frequencies; the driver sees those of the templates' terms only
    n = held.count()
    terms = held.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    df = scratch.save(terms.groupBy("term").agg(F.count("*").alias("df")))
    weight = F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1
    idf = {r["term"]: r["idf"] for r in df.where(F.col("term").isin(known)).select("term", weight.alias("idf")).collect()}
    rare = float(files.sparkSession.range(1).select(F.log((F.lit(n) + 1) / F.lit(2.0)) + 1).first()[0])  # of a term that no document has
    rows = []
    for i, ((name, _), c) in enumerate(zip(every, own, strict=True)):
        norm = sum((k * idf.get(w, rare)) ** 2 for w, k in c.items()) ** 0.5
        rows += [(i, name, i < len(templates), file_threshold if i < len(templates) else text_threshold, w, k * idf.get(w, rare), norm) for w, k in c.items()]
    vectors = files.sparkSession.createDataFrame(rows, "tid int, license string, notice boolean, least double, term string, tx double, tnorm double")
    vectors = F.broadcast(scratch.save(vectors.coalesce(1)))
    marks = marking_terms(templates, idf, rare, threshold)
    file_marks = marking_terms(templates, idf, rare, file_threshold) + marking_terms(file_templates, idf, rare, text_threshold)
    # each different text that may hold a notice or be a licence file, once
    texts = held.where(_has(words(F.col("text")), sorted({*marks, *file_marks}))).withColumn("tkey", F.md5("text"))
    texts = scratch.save(texts.groupBy("tkey").agg(F.any_value("text").alias("text")))
    runs = headers(texts, own_terms, marks, scratch)
    shared = texts.select("tkey", F.explode(F.array_intersect(words(F.col("text")), F.array(*map(F.lit, known)))).alias("term")).join(vectors, "term")
    enough = shared.groupBy("tkey", "tid").agg(F.sum(F.col("tx") * F.col("tx")).alias("sum"), F.max("tnorm").alias("tnorm"), F.max("least").alias("least"))
    enough = enough.where(F.sqrt("sum") >= (F.col("least") - 1e-6) * F.col("tnorm")).select("tkey").distinct()
    whole = texts.join(enough, "tkey", "left_semi").select(F.col("tkey").alias("key"), words(F.col("text")).alias("w"))
    part = runs.groupBy("key").agg(F.any_value("segment").alias("segment")).select("key", words(F.col("segment")).alias("w"))
    segments = whole.unionByName(part.join(whole.select("key"), "key", "left_anti"))
    counted = scratch.save(segments.select("key", F.explode("w").alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")))
    x = scratch.save(counted.join(df, "term").select("key", "term", (F.col("tf") * weight).alias("x")))
    norm = x.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = x.join(vectors, "term").groupBy("key", "tid", "license", "notice", "least", "tnorm").agg(F.sum(F.col("x") * F.col("tx")).alias("dot"))
    scored = dots.join(norm, "key").select("key", "license", "notice", "least", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score"))
    scored = scratch.save(scored.where(F.col("score") >= F.least(F.lit(threshold), "least")))
    notices = scored.where(F.col("notice") & (F.col("score") >= threshold))
    header = _best(runs.select("tkey", "key").join(notices, "key"), "tkey", "own", "own_score")
    as_file = _best(texts.select(F.col("tkey").alias("key")).join(scored.where(F.col("score") >= F.col("least")), "key"), "key", "is_file", "file_score")
    found = scratch.save(header.join(as_file.withColumnRenamed("key", "tkey"), "tkey", "full"))
    # nearest directory with a licence file, worked out once per directory and then joined to its files
    where = held.select("id", "path", F.md5("text").alias("tkey"), F.get(parents(F.col("path")), F.lit(0)).alias("dir"))
    own_rows = scratch.save(where.join(found, "tkey", "left"))
    folder = _best(own_rows.where("is_file is not null").select("dir", F.col("is_file").alias("license"), F.col("file_score").alias("score")), "dir", "from_dir", "dir_score")
    folder = scratch.save(folder)
    above = own_rows.select("dir").distinct().select("dir", F.posexplode(F.array_append(parents(F.concat("dir", F.lit("/x"))), F.lit(""))).alias("far", "up"))
    near = above.join(folder.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.min_by(F.struct("from_dir", "dir_score"), "far").alias("b"))
    near = scratch.save(near.select("dir", "b.from_dir", "b.dir_score"))
    out = own_rows.join(near, "dir", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("is_file", "own", "from_dir").alias("license"),
        F.coalesce("file_score", "own_score", "dir_score", F.lit(0.0)).alias("score"),
        F.when(F.col("is_file").isNotNull(), "file").when(F.col("own").isNotNull(), "header").when(F.col("from_dir").isNotNull(), "inherited").otherwise("none").alias("via"),
    )
