"""Quality classifier on random-indexing word vectors.

Words (runs of letters and digits, and runs of other marks, case kept) are hashed into ``BUCKETS`` rows. Every row has a fixed sparse ternary index vector of ``DIM``
places. A word's vector is the sum of the index vectors of the words up to ``REACH`` places before and after it, over all occurrences in **all** documents;
those after it are rotated by one place, so that sides differ. Tasks add up their own rows, tables of partial sums are shuffled by
groups of rows (each group gets one compressed row from each task, so no group is hot) and added as they stream by; the finished table has at most
``BUCKETS * DIM`` numbers whatever the corpus, and that is what is broadcast. Vectors are centred and brought to unit length.

A document is the mean of its words' vectors, with the logarithm of their number and the share of different ones. A network of two layers in numpy, trained by Adam on at most
``SAMPLE_PER_CLASS`` labelled documents a class, gives the log-odds; one temperature, fitted on rows kept from training and weighted back to the shares of the classes,
makes them probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import BLOCK_BYTES, blocks, hash_spans, mix

BITS = 15
BUCKETS = 1 << BITS
DIM = 64
NONZERO = 4
REACH = 2
GROUP = 256
SAMPLE_PER_CLASS = 2000
HIDDEN = 32
WIDTH = DIM + 2
EPOCHS = 60
BATCH = 32
RATE = 3e-3
DECAY = 1e-4
KEPT_FOR_HEAT = 5
#: Fixed value of the query's contract.
GOOD_FROM = 0.7

_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The sparse ternary vector of each row, from a hash of its number: the places that aren't zero, and 1 or -1 for each."""
    rows = np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(1, NONZERO + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = mix(rows)
    return (h >> np.uint64(8)).astype(np.int64) % DIM, np.where(h & np.uint64(1), 1.0, -1.0)


def parts(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about a block that end at white space; a word is never cut, however long."""
    at = 0
    while len(text) - at > 2 * BLOCK_BYTES:
        cut = max(text.rfind(c, at, at + BLOCK_BYTES) for c in (b" ", b"\n"))
        if cut <= at:
            cut = min((x for c in (b" ", b"\n") if (x := text.find(c, at + BLOCK_BYTES)) >= 0), default=len(text) - 1)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of all texts end to end, and the place of each text's first word (one more entry at the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    kind = _CLASS[joined]
    edge = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    begin = edge[kind[edge] > 0]
    end = np.r_[edge[1:], len(joined)][kind[edge] > 0]
    rows = (hash_spans(joined, begin, end) >> np.uint64(64 - BITS)).astype(np.int64)
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    return rows, np.searchsorted(begin, starts)


def add_contexts(total: np.ndarray, index: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> None:
    """Adds the neighbours of every word of the texts to the vectors of ``total``."""
    rows, first = word_rows(texts)
    place, sign = index
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    keys, signs = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for d in range(1, REACH + 1):
        own = owner[d:] == owner[:-d]
        before, after = rows[:-d][own], rows[d:][own]
        keys += [(after[:, None] * DIM + place[before]).ravel(), (before[:, None] * DIM + (place[after] + 1) % DIM).ravel()]
        signs += [sign[before].ravel(), sign[after].ravel()]
    total += np.bincount(np.concatenate(keys), weights=np.concatenate(signs), minlength=total.size).astype(np.int64).reshape(total.shape)


def pack(rows: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(rows, dtype="<i8").tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype="<i8").reshape(-1, DIM)


def groups(total: np.ndarray) -> pa.RecordBatch:
    """The groups of rows that hold anything."""
    held = [g for g in range(BUCKETS // GROUP) if total[g * GROUP : (g + 1) * GROUP].any()]
    blobs = [pack(total[g * GROUP : (g + 1) * GROUP]) for g in held]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "sums"])


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``part, sums``: of each group of rows the sums over all documents, packed. A null or blank text adds nothing."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIM), dtype=np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(0)
                for a, b in blocks(texts):
                    raw = [x or b"" for x in texts[a:b].cast(pa.binary()).to_pylist()]
                    for group in ([raw] if len(raw) > 1 else ([p] for p in parts(raw[0]))):
                        add_contexts(total, index, group)
        yield groups(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + unpack(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pack(x) for x in total.values()], pa.binary())], names=["part", "sums"])

    form = "part int, sums binary"
    return docs.select(F.col(text_col).cast("string")).mapInArrow(counted, form).repartition("part").mapInArrow(added, form)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """A unit vector for each row of words (zero where the corpus has none); ``BUCKETS * DIM`` numbers reach the driver."""
    total = np.zeros((BUCKETS, DIM))
    for r in context_sums(docs, text_col).toLocalIterator():
        total[r["part"] * GROUP : (r["part"] + 1) * GROUP] = unpack(r["sums"])
    seen = total.any(axis=1)
    size = lambda x: np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    unit = total / size(total)
    unit[seen] -= unit[seen].mean(axis=0) if seen.any() else 0
    return (unit / size(unit) * seen[:, None]).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Per text the mean of its words' vectors, the logarithm of one more than their number, and the share of different words.

    Different words are counted first and their vectors weighted; the sums of a text don't depend on the others of its block.
    """
    out = np.zeros((len(texts), WIDTH))
    if len(texts) == 1:
        found = [word_rows([p])[0] for p in parts(texts[0])]
        rows, owner = np.concatenate(found), np.zeros(sum(map(len, found)), dtype=np.int64)
    else:
        rows, first = word_rows(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
    keys, times = np.unique(owner * BUCKETS + rows, return_counts=True)
    owner, rows = keys // BUCKETS, keys % BUCKETS
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
    if len(first):
        held = owner[first]
        n = np.add.reduceat(times, first)
        out[held, :DIM] = np.add.reduceat(vectors[rows] * times[:, None].astype(np.float32), first, axis=0) / n[:, None]
        out[held, DIM] = np.log1p(n)
        out[held, DIM + 1] = np.diff(np.r_[first, len(owner)]) / n
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    heat: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.heat, -30, 30)))


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The divisor of the log-odds with the least weighted loss, from a fine grid; 1 without rows."""
    if not len(y):
        return 1.0
    loss = lambda t: float((weight * np.logaddexp(0, np.where(y == 1, -logits, logits) / t)).sum())
    return float(min(np.geomspace(0.05, 20, 120), key=loss))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """Rows of features, labels 0 or 1, and how many labelled documents each stands for. With one class or none, every text is that class (good without labels) with 0.99."""
    if len(np.unique(y)) < 2:
        zero = np.zeros
        side = 1 if not len(y) or y[0] == 1 else -1
        return Network(zero(WIDTH), np.ones(WIDTH), zero((WIDTH, HIDDEN)), zero(HIDDEN), zero((HIDDEN, 1)), np.array([side * np.log(99.0)]), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    x, y, weight = x[order], y[order].astype(float), weight[order]
    kept = np.zeros(len(y), dtype=bool)
    for label in (0, 1):  # some of each class, where there are enough
        kept[np.flatnonzero(y == label)[KEPT_FOR_HEAT - 1 :: KEPT_FOR_HEAT]] = True
    learn, ys, share = x[~kept], y[~kept], weight[~kept] / weight[~kept].mean()
    mean, scale = learn.mean(axis=0), learn.std(axis=0) + 1e-3
    z = (learn - mean) / scale
    at = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in at], [np.zeros_like(p) for p in at], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(ys))
        for s in range(0, len(order), BATCH):
            own = order[s : s + BATCH]
            hidden = np.tanh(z[own] @ at[0] + at[1])
            error = (1 / (1 + np.exp(-np.clip((hidden @ at[2] + at[3])[:, 0], -30, 30))) - ys[own]) * share[own] / len(own)
            back = error[:, None] @ at[2].T * (1 - hidden**2)
            grads = [z[own].T @ back + DECAY * at[0], back.sum(axis=0), hidden.T @ error[:, None] + DECAY * at[2], error.sum(keepdims=True)]
            step += 1
            for p, m, v, g in zip(at, first, second, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *at, 1.0)
    return Network(mean, scale, *at, temperature(net.logits(x[kept]), y[kept], weight[kept]))


def held_out(id_col: str):
    """Whether a document's labels are kept from learning; a null id is in no fold, and has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str) -> tuple[DataFrame, dict[int, int]]:
    """``id, y`` of at most about ``SAMPLE_PER_CLASS`` documents a class outside the held-out fold, spread by hash, and the numbers of the classes."""
    known = labels.where(~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    numbers = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    at = F.xxhash64("id", F.lit(31)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    share = F.coalesce(*(F.when(F.col("y") == y, F.lit(min(1.0, SAMPLE_PER_CLASS / n))) for y, n in numbers.items()), F.lit(0.0))
    return known.where(at < share).orderBy(F.xxhash64("id"), "id", "y").limit(2 * SAMPLE_PER_CLASS * max(len(numbers), 1)), numbers


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network, from pooled vectors of the sample: what reaches the driver of a document is one vector of ``WIDTH`` numbers.

    A document with both labels is a row of each class; of repeated rows with one id the least text counts; null texts are not learned from.
    """
    picked, numbers = labelled_sample(labels, id_col)

    @F.pandas_udf("binary")
    def vector(texts: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([pooled(vectors, [t.encode()])[0].astype("<f8").tobytes() for t in texts], dtype=object)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    own = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # the sample's bound holds
    rows = sorted(own.select("id", "y", vector("text").alias("v")).collect(), key=lambda r: (r["id"], r["y"]))
    y = np.array([r["y"] for r in rows], dtype=np.int64)
    x = np.array([np.frombuffer(r["v"], "<f8") for r in rows]).reshape(len(rows), WIDTH)
    stands = {k: numbers[k] / max(int((y == k).sum()), 1) for k in numbers}
    return fit(x, y, np.array([stands[k] for k in y.tolist()], dtype=float))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """Adds ``out_col``, the calibrated probability that a text is good. A null text counts as empty. Rows and other columns stay."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        values = pa.array([t if isinstance(t, str) else "" for t in texts], type=pa.string())
        found = [np.zeros(0)]
        with np.errstate(over="ignore"):
            for a, b in blocks(values):
                found.append(net.probability(pooled(vectors, [x.encode() for x in values[a:b].to_pylist()])))
        return pd.Series(np.concatenate(found))

    return docs.withColumn(out_col, scored(F.col(text_col).cast("string")))


def score_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Word vectors come from all texts, labels only from rows outside the held-out fold. Null and empty texts are scored as texts without words.
    A null id is not held out. Repeated rows score alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vectors = word_vectors(rows)
    out = score(rows, vectors, train(rows, labels.withColumnRenamed(id_col, "doc_id"), vectors), "text", "score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
