"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are its character n-grams inside words, hashed into buckets. Its vector is the mean of the buckets'
embeddings. Embeddings and softmax weights are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows (about ``SAMPLE_PER_LANG`` documents a language); a fifth of the sample fits the temperature and the rejection
threshold. As the model is linear in the mean, scoring sums per-bucket logits, in whole Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import give_back

#: Bounds of the training sample: documents a language, code points of a piece, pieces a language.
SAMPLE_PER_LANG = 400
PIECE_CHARS = 300
PIECES_PER_LANG = 1500
BUCKETS = 1 << 16
DIM = 16
ORDERS = (2, 3, 4)
EPOCHS = 4
RATE = 0.6
BATCH = 32
#: Share of the sample's rightly predicted pieces that the rejection threshold may reject, and the threshold's upper limit.
REJECT_SHARE = 0.001
REJECT_MOST = 0.5
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    logits: np.ndarray  # bucket x language, divided by the temperature
    bias: np.ndarray
    threshold: float


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block of texts, the text of each, and whether a text has a letter.

    An n-gram is a run of letters with, at either end, perhaps the word's boundary.
    """
    joined = "\n".join(t.lower() for t in texts) + "\n"
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), dtype=np.int64, count=len(texts))
    code = np.frombuffer(("\n" + joined).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    owner = np.r_[0, np.repeat(np.arange(len(texts)), lengths)]
    code = np.where(letter, code, np.uint32(1)).astype(np.uint64)
    found, whose = [], []
    for n in ORDERS:
        size = len(code) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, dtype=np.uint64)
        fit = letter[: size] | letter[n - 1 : n - 1 + size]
        for i in range(n):
            h = (h ^ code[i : i + size]) * np.uint64(0x100000001B3 + 2 * i)
            if 0 < i < n - 1:
                fit = fit & letter[i : i + size]
        at = np.flatnonzero(fit)
        h = h[at]
        found.append(((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 16)).astype(np.int64))
        whose.append(owner[at + 1])
    has = np.zeros(len(texts), dtype=bool)
    has[owner[letter]] = True
    return np.concatenate(found), np.concatenate(whose), has


def text_logits(model: LangModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the logits of all languages, and whether it has a letter. Long texts are summed block by block."""
    total = np.zeros((len(texts), len(model.langs)))
    count = np.zeros(len(texts))
    has = np.zeros(len(texts), dtype=bool)
    pieces: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > BLOCK_CHARS:  # cut after white space; a word is never cut, however long
            cut = max(t.rfind(c, at, at + BLOCK_CHARS) for c in " \n")
            if cut <= at:
                cut = min((x for c in " \n" if (x := t.find(c, at + BLOCK_CHARS)) >= 0), default=len(t) - 1)
            pieces.append((i, t[at : cut + 1]))
            at = cut + 1
        pieces.append((i, t[at:]))
    start, held = 0, 0
    for end in range(1, len(pieces) + 1):
        held += len(pieces[end - 1][1])
        if held >= BLOCK_CHARS or end == len(pieces):
            who = np.array([i for i, _ in pieces[start:end]])
            with np.errstate(over="ignore"):
                buckets, whose, letters = ngram_buckets([t for _, t in pieces[start:end]])
            whose = who[whose]
            for k in range(len(model.langs)):
                total[:, k] += np.bincount(whose, weights=model.logits[buckets, k], minlength=len(texts))
            count += np.bincount(whose, minlength=len(texts))
            has[who[letters]] = True
            start, held = end, 0
    return total / np.maximum(count, 1)[:, None] + model.bias, has


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 13) -> LangModel:
    """``rows`` of (text, language) -> model. No rows give a model without languages, which rejects every text."""
    langs = tuple(sorted({lang for _, lang in rows}))
    if not langs:
        return LangModel((), np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    pieces = [(t[i : i + PIECE_CHARS], langs.index(lang)) for t, lang in rows for i in range(0, len(t), PIECE_CHARS)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    room = [PIECES_PER_LANG] * len(langs)
    kept = []
    for t, k in pieces:
        if room[k] > 0:
            room[k] -= 1
            kept.append((t, k))
    with np.errstate(over="ignore"):
        grams = [(np.unique(ngram_buckets([t])[0], return_counts=True), k) for t, k in kept]
    grams = [((b, c / c.sum()), k) for (b, c), k in grams if len(b)]
    check, train = grams[: len(grams) // 5], grams[len(grams) // 5 :]
    table = rng.normal(0, 0.1, (BUCKETS, DIM))
    weight, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    steps = EPOCHS * max(1, len(train) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for s in range(0, len(order), BATCH):
            rate = RATE * max(0.05, 1 - step / steps)
            step += 1
            batch = [train[i] for i in order[s : s + BATCH]]
            mean = np.stack([c @ table[b] for (b, c), _ in batch])
            grad = softmax(mean @ weight + bias)
            grad[np.arange(len(batch)), [k for _, k in batch]] -= 1
            back = grad @ weight.T
            for ((b, c), _), g in zip(batch, back, strict=True):
                table[b] -= rate * 20 * c[:, None] * g  # b is unique; a mean spreads a gradient thinly, hence the factor
            weight -= rate * mean.T @ grad / len(batch) * 20
            bias -= rate * grad.mean(axis=0)
    logits = table @ weight
    if not check:
        return LangModel(langs, logits.astype(np.float32), bias, 0.0)
    raw = np.stack([c @ logits[b] for (b, c), _ in check]) + bias
    truth = np.array([k for _, k in check])
    loss = lambda t: -np.log(np.maximum(softmax(raw / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    heat = min(np.geomspace(0.2, 20, 60), key=loss)
    prob = softmax(raw / heat)
    right = prob.max(axis=1)[prob.argmax(axis=1) == truth]
    threshold = min(REJECT_MOST, float(np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return LangModel(langs, (logits / heat).astype(np.float32), bias / heat, threshold)


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Trains on a bounded sample, spread evenly by hash, of the documents outside fold 1 that have a text and a label.

    Texts are cut on the executors: the driver gets at most ``2 * PIECES_PER_LANG`` pieces of ``PIECE_CHARS`` code points a language, however long the texts are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((fold("id") != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    one = F.lit((1 << 40) - 1)
    of = lambda numbers, most: F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, most / n))) for k, n in numbers.items()))
    at = lambda *cols: F.xxhash64(*cols).bitwiseAND(one) / F.lit(float(1 << 40))
    picked = rows.where(at("id", F.lit(17)) < of({r["lang"]: r["count"] for r in counts}, SAMPLE_PER_LANG)).where("text <> ''")
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int"))
    sizes = picked.groupBy("lang").agg(F.sum(F.size(starts)).alias("n")).collect()
    if not sizes:
        return fit([])
    pieces = picked.select("id", "lang", "text", F.explode(starts).alias("i")).where(at("id", "i", F.lit(19)) < of({r["lang"]: r["n"] for r in sizes}, PIECES_PER_LANG))
    pieces = pieces.select("lang", F.substring("text", F.col("i") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("piece"), F.xxhash64("id", "i").alias("order"))
    held = pieces.orderBy("order", "piece", "lang").limit(2 * PIECES_PER_LANG * len(sizes)).collect()
    return fit([(r["piece"], r["lang"]) for r in held])


def predict(docs: DataFrame, model: LangModel, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Adds ``out_col``: struct(lang, score). A text that is null or has no letter is ``und`` with score 0."""

    @F.pandas_udf("lang string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        values = [t if isinstance(t, str) else "" for t in texts]
        if not model.langs or not values:
            return pd.DataFrame({"lang": [UNKNOWN] * len(values), "score": [0.0] * len(values)})
        logits, has = text_logits(model, values)
        prob = softmax(logits)
        best = prob.argmax(axis=1)
        lang = np.where(has, np.array(model.langs, dtype=object)[best], UNKNOWN)
        give_back()
        return pd.DataFrame({"lang": lang, "score": np.where(has, prob[np.arange(len(best)), best], 0.0)})

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))


def language_report(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted``, one row per row of ``docs``; accepted tells what calibrated rejection leaves.

    A null id is in no fold: not held out, not learned from. Repeated rows are predicted alike; a tie goes to the lesser language.
    """
    model = train(docs)
    out = predict(docs.select("doc_id", "text"), model, "text", "language")
    return out.select(
        "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        known(F.col("language"), model).alias("accepted"),
    )


def known(language, model: LangModel):
    """Whether a prediction stands: letters, and a calibrated score from the model's threshold up."""
    return (language["lang"] != UNKNOWN) & (language["score"] >= model.threshold)


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the model rejects: no letters, or a calibrated score under its threshold."""
    model = train(docs)
    out = predict(docs, model, "text", "__language")
    return out.where(known(F.col("__language"), model)).drop("__language")
