"""Periodic runs of words: stretches that repeat themselves four times and more, found with the dictionary of basic factors.

The words of a block of texts are numbered, and the factors of 2 ** k words are named by pairs of names of half their length, each text for itself. Wherever
the next occurrence of a factor begins at most its own length later, the two overlap or touch; neighbouring places with the same distance form the
arithmetic progressions of one periodic run and propose the distance as its period. A run of period q and at least 4q words shows at the level where
``q <= 2 ** k < 2q``: the factor is longer than the period, so its next occurrence within the run is exactly one period away, and a multiple of the
smallest period is never proposed there. Each progression is extended to both sides as far as words one period apart are equal (by names of
shrinking length, so in steps that grow with the logarithm of the distance), and equal (start, length, period) are merged. Places whose factor
occurs once in its text can't start a longer repeated factor and are dropped before the next level, so prose costs few levels.

A task holds one block of texts (``BLOCK_BYTES``, or one longer text) at a time. Nothing is shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.llm.shingles import blocks

#: Fixed values of the query's contract.
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
RUN = "array<struct<start:long,length:long,period:long>>"


class Numbers(dict):
    """Word -> its number, the next one for a new word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def factor_names(names: np.ndarray, gap: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the factors of twice the length at the places ``live``, from names of factors of ``gap`` words (-1: none there).

    Returns the places that have such a factor and its names, sorted by name and then place.
    """
    at = live[live + gap < len(names)]
    at = at[names[at + gap] >= 0]
    if not len(at):
        return at, at
    pair = names[at] * (int(names.max()) + 1) + names[at + gap]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    return at[order], np.cumsum(np.r_[False, pair[1:] != pair[:-1]])


def repeated(place: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which of the sorted places share their name with a neighbour."""
    same = name[1:] == name[:-1]
    return np.r_[False, same] | np.r_[same, False]


def extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and b on (step 1), or before them (step -1), are equal: from the longest named factors to single words.

    A place without a name (-1) has a factor that occurs once in its text, so it equals none.
    """
    size = len(levels[0])
    total = np.zeros(len(a), dtype=np.int64)
    for k in [*range(len(levels) - 1, -1, -1)]:
        width, names = 1 << k, levels[k]
        going = np.arange(len(a))
        while len(going):  # only the longest length may fit several times
            x, y = (a[going] + total[going], b[going] + total[going]) if step > 0 else (a[going] - total[going] - width, b[going] - total[going] - width)
            fits = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < size)
            going, x, y = going[fits], x[fits], y[fits]
            equal = (names[x] >= 0) & (names[x] == names[y])
            going = going[equal]
            total[going] += width
    return total


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs of a block, a row (text, start, length, period) each, in that order.

    ``words`` are numbers of the words of all texts end to end, ``first`` the place of each text's first word and at last their number.
    """
    sizes = np.diff(first)
    none = np.zeros((0, 4), dtype=np.int64)
    if not len(words) or sizes.max() < LEAST_LENGTH:
        return none
    # One place between texts holds no word, so no factor reaches over it; a name belongs to one text.
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) + owner
    names = np.full(int(place[-1]) + 1, -1, dtype=np.int64)
    text = np.full(len(names), -1, dtype=np.int64)
    text[place] = owner
    key = owner * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    at, key = place[order], key[order]
    name = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    names[at] = name  # unrepeated words keep their names too: periods are compared by words
    levels, found = [names], []
    longest, k = int(sizes.max()) // LEAST_EXPONENT, 0
    while len(at):
        width = 1 << k
        same = name[1:] == name[:-1]
        here, gap = at[:-1][same], (at[1:] - at[:-1])[same]
        near = (gap <= width) & (2 * gap > width)
        here, gap = here[near], gap[near]
        if len(here):
            order = np.argsort(here, kind="stable")
            here, gap = here[order], gap[order]
            new = np.flatnonzero(np.r_[True, (here[1:] != here[:-1] + 1) | (gap[1:] != gap[:-1])])
            found.append(np.stack([here[new], gap[new]], axis=1))
        if width >= longest:
            break
        live = at[repeated(at, name)]
        at, name = factor_names(levels[k], width, live)
        names = np.full(len(text), -1, dtype=np.int64)
        names[at] = name
        levels.append(names)
        k += 1
    if not found:
        return none
    start, period = np.concatenate(found).T
    left = extend(levels, start, start + period, -1)
    right = extend(levels, start, start + period, 1)
    start, length = start - left, left + right + period
    keep = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    start, length, period = start[keep], length[keep], period[keep]
    whose = text[start]
    runs = np.stack([whose, start - first[whose] - whose, length, period], axis=1)
    return np.unique(runs, axis=0).reshape(-1, 4)


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Which of a text's words stay: those that lie in no run (start, length, period), or only among the first period of words of each."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def planted(words: list[bytes], doc_id: str) -> list[bytes]:
    """The query's words: in documents whose id has a crc32 divisible by ten, the end of the text repeats a stretch of it."""
    n = len(words)
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


@F.pandas_udf(StringType())
def planted_text(texts: pd.Series, ids: pd.Series) -> pd.Series:
    """Texts with their words changed by ``planted``; a null id or text changes nothing."""
    out = []
    for t, i in zip(texts, ids, strict=True):
        changed = isinstance(t, str) and isinstance(i, str) and zlib.crc32(i.encode()) % 10 == 0
        out.append(b" ".join(planted(t.encode().split(), i)).decode() if changed else t)
    return pd.Series(out, dtype=object)


def periodic_runs(docs: DataFrame, text_col: str = "text", out_col: str = "periodic") -> DataFrame:
    """Adds ``out_col``: struct(runs, collapsed). ``runs`` are all runs by start and then period, counted in words from 0;
    ``collapsed`` is the text's words without the repeats, joined by one space.

    A null or blank text has no runs and collapses to the empty text. Rows and other columns stay; equal texts get equal results. Ties do not arise: a run
    is given by its start and period.
    """

    @F.pandas_udf(f"runs {RUN}, collapsed string")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        values = pa.array([t if isinstance(t, str) else "" for t in texts], type=pa.string())
        all_runs, collapsed = [], []
        for a, b in blocks(values):
            words = [x.encode().split() for x in values[a:b].to_pylist()]
            first = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
            number = Numbers()
            codes = np.fromiter((number[x] for w in words for x in w), dtype=np.int64, count=int(first[-1]))
            runs = find_runs(codes, first)
            cut = np.searchsorted(runs[:, 0], np.arange(len(words) + 1))
            for w, i, j in zip(words, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = runs[i:j, 1:]
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in sorted(own.tolist(), key=lambda r: (r[0], r[2]))])
                stay = [w[k] for k in np.flatnonzero(kept_words(len(w), own)).tolist()] if len(own) else w
                collapsed.append(b" ".join(stay).decode())
        return pd.DataFrame({"runs": pd.Series(all_runs, dtype=object), "collapsed": pd.Series(collapsed, dtype=object)})

    return docs.withColumn(out_col, scanned(F.col(text_col).cast("string")))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, of its words after ``planted``: number of runs, the longest one (ties: least start, then period; null without runs), and digests of all runs
    and of the collapsed text. Null texts have no words; a null id plants nothing; repeated rows get equal results."""
    rows = docs.select(F.col(id_col).alias("doc_id"), planted_text(F.col(text_col).cast("string"), F.col(id_col).cast("string")).alias("text"))
    out = periodic_runs(rows, "text", "p").select("doc_id", F.col("p.runs").alias("runs"), F.col("p.collapsed").alias("collapsed"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
