"""Model calls over DataFrames: any function that scores, embeds or answers a list of texts, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.score import parse_enrichment as parse_column

PROMPT_CHARS = 2000
#: A small lexicon for tests; real scorers are the caller's.
GOOD, BAD = frozenset("gain gains rise beat strong record".split()), frozenset("loss fall miss weak cut fraud".split())


def lexicon_scorer(texts: list[str]) -> list[dict]:
    out = []
    for t in texts:
        w = re.findall(r"\w+", t.lower())
        good, bad = sum(x in GOOD for x in w), sum(x in BAD for x in w)
        s = (good - bad) / max(1, good + bad)
        out.append({"score": s, "label": "positive" if s > 0.2 else "negative" if s < -0.2 else "neutral", "confidence": 1.0})
    return out


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def score_batch(df: DataFrame, scorer: Callable | dict[str, Callable], text_col: str = "title", by: str = "language", batch: int = 32) -> DataFrame:
    """Adds score, label, confidence and failed. ``scorer`` may be one function or one a language; blank and failed rows are neutral, and failed tells them apart."""

    @F.pandas_udf("score double, label string, confidence double, failed boolean")
    def run(texts: pd.Series, routes: pd.Series) -> pd.DataFrame:
        n = len(texts)
        score, label, sure, failed = np.zeros(n), np.full(n, "neutral", dtype=object), np.ones(n), np.zeros(n, dtype=bool)
        held = texts.to_numpy(dtype=object)
        some = np.fromiter((isinstance(t, str) and bool(t.strip()) for t in held), dtype=bool, count=n)
        for route in routes.unique():
            fn = scorer.get(route) if isinstance(scorer, dict) else scorer
            rows = np.flatnonzero(some & (routes == route).to_numpy())
            for a in range(0, len(rows) if fn else 0, batch):
                part = rows[a : a + batch]
                try:
                    found = fn(held[part].tolist())
                    values = [r["score"] for r in found], [r["label"] for r in found], [r["confidence"] for r in found]
                    score[part], label[part], sure[part] = values
                except Exception:  # noqa: BLE001  a failed call leaves its rows neutral
                    score[part], label[part], sure[part], failed[part] = 0.0, "neutral", 1.0, True
        return pd.DataFrame({"score": score, "label": label, "confidence": sure, "failed": failed})

    route = F.coalesce(F.when(F.col(by) != "", F.col(by)), F.lit("en"))
    return df.withColumn("__s", run(F.col(text_col), route)).select("*", "__s.score", "__s.label", "__s.confidence", "__s.failed").drop("__s")


def embed_batch(df: DataFrame, embedder: Callable, dim: int, model_id: str, text: Column, only_null: bool = False, batch: int = 64) -> DataFrame:
    """Sets embedding and model_id; blank texts get zeros. With ``only_null``, rows that have a vector keep it."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = [[0.0] * dim for _ in range(len(texts))]
        rows = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
        for a in range(0, len(rows), batch):
            part = rows[a : a + batch]
            for i, v in zip(part, embedder([texts.iloc[i] for i in part]), strict=True):
                out[i] = v
        return pd.Series(out)

    if not only_null:
        return df.withColumn("embedding", run(text)).withColumn("model_id", F.lit(model_id))
    todo = df.where("embedding is null").withColumn("embedding", run(text)).withColumn("model_id", F.lit(model_id))
    return df.where("embedding is not null").unionByName(todo, allowMissingColumns=True)


def same_model(a: DataFrame, b: DataFrame) -> None:
    """Refuses to compare vectors of different models."""
    models = {r[0] for r in a.select("model_id").union(b.select("model_id")).distinct().limit(2).collect()}
    if len(models) > 1:
        raise ValueError(f"vectors of different models: {sorted(map(str, models))}")


def enrich_batch(df: DataFrame, client: Callable[[str, str], str], languages=("en", "ko"), least: float = 0.05) -> DataFrame:
    """``(id, raw)``: one call for each eligible row, on its first 2000 characters; a failed call gives null and is tried again later."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, langs: pd.Series) -> pd.Series:
        def call(text, lang):
            try:
                return client(text, lang)
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([call(t, g) for t, g in zip(texts, langs, strict=True)], dtype=object)

    lang = F.coalesce("language", F.lit("en"))
    rows = df.where(lang.isin(*languages) & (F.abs("sentiment") >= least))
    return rows.select("id", run(F.substring(F.coalesce("summary", "title"), 1, PROMPT_CHARS), lang).alias("raw"))


def parse_enrichment(df: DataFrame, column: str = "raw") -> DataFrame:
    return df.select("id", parse_column(F.col(column)).alias("p")).select("id", "p.*")


def claim_pending(df: DataFrame, as_of: Column, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The rows to enrich now, and the table with their attempts and last try stamped."""
    from newsloom.operators.filters import enrichment_candidates

    claimed = enrichment_candidates(df, as_of, limit).select("id")
    mark = claimed.withColumn("__claim", F.lit(True))
    hit = df.join(F.broadcast(mark), "id", "left")  # at most limit rows
    stamped = hit.withColumn("llm_enrich_attempts", F.when(F.col("__claim"), F.col("llm_enrich_attempts") + 1).otherwise(F.col("llm_enrich_attempts")))
    stamped = stamped.withColumn("llm_last_attempt_at", F.when(F.col("__claim"), as_of).otherwise(F.col("llm_last_attempt_at")))
    return claimed, stamped.select(*df.columns)
