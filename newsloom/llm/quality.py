"""Quality rules: exact counts, and a hashed word and character n-gram logistic regression with calibrated scores.

The counts (words, symbols, repeated lines, repeated 8-word windows) give the base rules. The model is trained by stochastic
gradient descent in numpy on a bounded, balanced sample of labelled rows (``SAMPLE_PER_CLASS``). What reaches the driver of a row are the shares of its
features, at most 2 ** ``BITS`` of six bytes each, whatever the text's length. Platt scaling is fitted on scores of rows that the scoring model hasn't seen
(``FOLDS`` models), by Newton steps that never raise the loss. The features are shares of hashed character 3-grams, character-class 5-grams, words and
word pairs; none reaches over the end of a text, so a text's score doesn't depend on the others of its batch.
Texts are scored whole, in Arrow batches; a document is kept from ``KEEP_FROM`` up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import BLOCK_BYTES, blocks, mix, word_hashes

SAMPLE_PER_CLASS = 1000
BITS = 16
EPOCHS = 6
FOLDS = 4
RATE = 2.0
DECAY = 1e-4
KEEP_FROM = 0.5
#: Fixed values of the query's contract.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, (30, 100)

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 97
_CLASS[list(SPACES)] = 32
_KINDS = 4


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The contract's counts, per text."""
    with np.errstate(over="ignore"):
        words, first = word_hashes(texts, lower=False)
    out = {k: np.zeros(len(texts), dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out["n_words"][:] = np.diff(first)
    run = np.zeros(max(len(words) - WINDOW + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            run = run * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(run)]
        run = mix(run)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, dtype=np.uint8)
        out["word_chars"][i] = np.count_nonzero(((b & 0xC0) != 0x80) & ~_IS_SPACE[b])
        out["n_symbols"][i] = np.count_nonzero(_IS_SYMBOL[b])
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        n = int(first[i + 1] - first[i])
        if n > WINDOW:
            w = run[first[i] : first[i + 1] - WINDOW + 1]
            order = np.argsort(w, kind="stable")
            same = w[order][1:] == w[order][:-1]
            if same.any():
                again = np.zeros(len(w), dtype=bool)
                again[order[1:][same]] = again[order[:-1][same]] = True
                edge = np.zeros(n + 1, dtype=np.int64)
                at = np.flatnonzero(again)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                out["n_repeat_words"][i] = np.count_nonzero(np.cumsum(edge[:-1]))
    return out


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind of feature, buckets, text of each occurrence); a kind may come in several parts, in the order of the block."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    shift = np.uint64(64 - BITS + 2)
    for kind, n in enumerate((3, 5)):
        for a in range(0, len(joined), 2 * BLOCK_BYTES):  # only one very long text is longer than a part
            part = joined[a : a + 2 * BLOCK_BYTES + n - 1]
            codes = _CLASS[part] if kind else part
            size = max(len(codes) - n + 1, 0)
            h = np.zeros(size, dtype=np.uint64)
            for i in range(n):
                h = (h << np.uint64(8)) | codes[i : i + size]
            h = h * np.uint64(0x9E3779B97F4A7C15)
            bucket = ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
            who = np.searchsorted(ends, np.arange(a, a + size), side="right") if len(texts) > 1 else np.zeros(size, dtype=np.int64)
            own = np.arange(a, a + size) + n <= ends[who] if size else np.zeros(0, dtype=bool)  # the window ends in the text that it begins in
            yield kind, (bucket.astype(np.int64) + (kind << (BITS - 2)))[own], who[own]
    words, first = word_hashes(texts, lower=False)
    whose = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = np.where(words[1:] == words[:-1], np.uint64(7), words[1:] * np.uint64(3) + words[:-1])
    same = whose[1:] == whose[:-1]
    for kind, h, who in ((2, words, whose), (3, mix(pair[same]), whose[1:][same])):
        yield kind, (mix(h) >> shift).astype(np.int64) + (kind << (BITS - 2)), who


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and the share of each among the occurrences of its kind."""
    total = np.zeros(1 << BITS)
    for _, bucket, _ in features([text]):
        total += np.bincount(bucket, minlength=1 << BITS)
    kinds = total.reshape(_KINDS, -1)
    kinds /= np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class QualityModel:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


def raw_scores(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    total, number = np.zeros((_KINDS, len(texts))), np.zeros((_KINDS, len(texts)))
    with np.errstate(over="ignore"):
        for kind, bucket, who in features(texts):
            total[kind] += np.bincount(who, weights=model.weight[bucket], minlength=len(texts))
            number[kind] += np.bincount(who, minlength=len(texts))
    score = np.full(len(texts), model.bias)
    for t, n in zip(total, number, strict=True):
        score += t / np.maximum(n, 1)
    return score


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probability(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    return sigmoid(model.slope * raw_scores(model, texts) + model.shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to labels, with the usual smoothed targets.

    Newton steps are halved until the loss falls; it is convex and the targets lie strictly between 0 and 1, so a finite minimum exists even where the scores
    part the labels. Scores are scaled first, and a slope that isn't positive (or one class alone) gives slope 1 and shift 0.
    """
    unit = max(float(np.abs(z).max(initial=0.0)), 1e-12)
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    x = np.stack([z / unit, np.ones(len(z))])
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda at: float((np.logaddexp(0, at @ x) - target * (at @ x)).sum() + 1e-6 * at @ at)
    at = np.array([1.0, 0.0])
    now = loss(at)
    for _ in range(100):
        p = sigmoid(at @ x)
        grad = x @ (p - target) + 2e-6 * at
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 2e-6 * np.eye(2), grad)
        size = 1.0
        while size > 1e-9 and not loss(at - size * step) < now:
            size /= 2
        if size <= 1e-9:
            break
        at = at - size * step
        now = loss(at)
    return (float(at[0] / unit), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic gradient descent."""
    weight, squares, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            b, c, y = rows[i]
            g = sigmoid(weight[b] @ c + bias) - y
            step = g * c + DECAY * weight[b] * c
            squares[b] += step**2
            weight[b] -= RATE * step / np.sqrt(squares[b]) / (1 + epoch)
            bias -= 0.05 * g
    return weight, float(bias)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 5) -> QualityModel:
    """``rows`` of (buckets, shares, quality 0 or 1). With one class or none, the model keeps everything."""
    if len({y for _, _, y in rows}) < 2:
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, 5.0)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    z, y = np.zeros(len(rows)), np.array([y for _, _, y in rows], dtype=float)
    for k in range(FOLDS):
        rest = [r for i, r in enumerate(rows) if i % FOLDS != k]
        weight, bias = descend(rest, rng)
        for i in range(k, len(rows), FOLDS):
            z[i] = weight[rows[i][0]] @ rows[i][1] + bias
    slope, shift = platt(z, y)
    return QualityModel(*descend(rows, rng), slope, shift)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Trains on at most ``SAMPLE_PER_CLASS`` labelled documents a class, spread evenly by hash of the id.

    A document with both labels is a row of each class; of repeated rows with one id the least text counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    numbers = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not numbers:
        return fit([])
    at = F.xxhash64("id", F.lit(29)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    share = F.coalesce(*(F.when(F.col("y") == y, F.lit(min(1.0, SAMPLE_PER_CLASS / n))) for y, n in numbers.items()))
    picked = known.where(at < share).orderBy(F.xxhash64("id"), "id", "y").limit(2 * SAMPLE_PER_CLASS * len(numbers))

    @F.pandas_udf("bucket binary, share binary")
    def parts(texts: pd.Series) -> pd.DataFrame:
        with np.errstate(over="ignore"):
            found = [shares(t.encode()) for t in texts]
        return pd.DataFrame({"bucket": [b.astype("<u2").tobytes() for b, _ in found], "share": [c.astype("<f4").tobytes() for _, c in found]})

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    own = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # the sample's bound holds
    rows = own.select("id", "y", parts("text").alias("p")).select("id", "y", "p.bucket", "p.share").collect()
    rows.sort(key=lambda r: (r["id"], r["y"]))
    return fit([(np.frombuffer(r["bucket"], "<u2").astype(np.int64), np.frombuffer(r["share"], "<f4").astype(np.float64), r["y"]) for r in rows])


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts, whether the base rules fail it, the calibrated score, and whether it is kept.

    A null text has no words and fails the base rules. Repeated rows and null ids are rows like others.
    """
    model = train(docs, labels, id_col, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names) + ", score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        values = pa.array([t if isinstance(t, str) else "" for t in texts], type=pa.string())
        parts = []
        for a, b in blocks(values):
            raw = [x.encode() for x in values[a:b].to_pylist()]
            parts.append(pd.DataFrame(counts(raw) | {"score": probability(model, raw)}))
        return pd.concat(parts)[[*names, "score"]] if parts else pd.DataFrame({n: [] for n in [*names, "score"]})

    q = F.col("q")
    failed = (q["n_words"] < MIN_WORDS) | (MAX_REPEAT[1] * q["n_repeat_words"] > MAX_REPEAT[0] * q["n_words"])
    out = docs.select(F.col(id_col).alias("doc_id"), scored(F.col(text_col).cast("string")).alias("q"))
    return out.select("doc_id", *(q[n].alias(n) for n in names), failed.alias("base_failed"), (~failed & (q["score"] >= KEEP_FROM)).alias("kept"), q["score"].alias("score"))
