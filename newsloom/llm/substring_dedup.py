"""Passages that repeat across documents.

Paragraphs are lines of ``MIN_WORDS`` words and more. They are compared as sets of 5-word shingles: MinHash signatures in bands collide
(the bands find a pair at the threshold with a probability above 0.9998), exact Jaccard verifies, and components cluster. Shorter lines have no search for
near copies: a passage is over 50 words by definition.
A passage inside longer paragraphs is cut out by content: at each least shingle hash among any ``ANCHOR`` neighbours a unit of
``UNIT`` words is taken around it, so that any ``MIN_WORDS + 1`` words that two documents share have a unit in common. Equal units
collide at once and need no bands. What is found in a run of at most ``MIN_WORDS`` words may be less than a passage: there all windows of ``MIN_WORDS + 1`` words
around the units are compared, and only shared windows stay, to the last word.

What collides is a class: equal units, equal windows, or the lines of one component. Of each class the first piece by (doc_id, start) stays and the others can go.
Only then are the pieces laid over each document and merged: so a long text that holds a short passage of an earlier document loses this passage
and nothing else, and each word of an equal unit that goes is still in a piece before it.

Equality is that of two 64-bit hashes by different rules. Among the 5 * 10^12 units of 100 TB less than one pair in 10^13 runs would meet by chance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.jaccard_join import SKETCH_WORDS, _lists, linked_sets
from newsloom.llm.shingles import _P, _Powers, blocks, mix, word_places
from newsloom.scratch import Scratch

SHINGLE = 5
NUMERATOR, DENOMINATOR = 80, 100
MIN_WORDS = 50
BANDS, ROWS = 16, 4
SIDE = 18
UNIT = 2 * SIDE + SHINGLE
ANCHOR = MIN_WORDS - 2 * SIDE - SHINGLE + 2
WINDOW = MIN_WORDS + 1
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_OTHER = np.uint64(0xD1342543DE82EF95)
PIECE = "doc_id long, word long, n_words long, start long, end long, print long, print2 long"
UNITS = PIECE + ", n long, keys array<long>, bits array<long>"


def sliding(values: np.ndarray, n: int, ufunc) -> np.ndarray:
    """``ufunc`` over each run of n neighbours, by doubling."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = ufunc(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(run: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions that are the least of some ``ANCHOR`` successive shingles of one text."""
    if len(run) < ANCHOR:
        return np.empty(0, dtype=np.int64)
    least = np.where(inside[: len(run) - ANCHOR + 1], sliding(run, ANCHOR, np.minimum), np.uint64(0))
    edge = np.zeros(ANCHOR - 1, dtype=np.uint64)
    return np.flatnonzero(run == sliding(np.r_[edge, least, edge], ANCHOR, np.maximum))  # a least hash is the greatest of its windows' least ones


class LineSets:
    """Shingle sets of a block's lines: the sorted distinct hashes of all lines end to end, and where each line's begin."""

    def __init__(self, run: np.ndarray, lines: np.ndarray):
        size = lines[:, 1] - lines[:, 0] - SHINGLE + 1
        owner = np.repeat(np.arange(len(lines)), size)
        value = run[np.arange(int(size.sum())) + np.repeat(lines[:, 0] - (np.cumsum(size) - size), size)]
        order = np.lexsort((value, owner))
        value = value[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][: len(value)]
        self.value, self.owner, self.number = value[new], owner[new], len(lines)
        self.count = np.bincount(self.owner, minlength=len(lines))
        self.first = np.cumsum(self.count) - self.count

    def fold(self, values: np.ndarray, ufunc) -> np.ndarray:
        return ufunc.reduceat(values, self.first, axis=-1) if self.number else values[..., :0]

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        first = self.fold(mix(self.value), np.bitwise_xor) ^ self.count.astype(np.uint64)
        return first, self.fold(mix(self.value * _OTHER + np.uint64(1)), np.bitwise_xor)

    def band_keys(self) -> np.ndarray:
        """MinHash signatures, one key a band: lines x bands."""
        least = np.empty((BANDS * ROWS, self.number), dtype=np.uint64)
        for a in range(0, BANDS * ROWS, 4):
            least[a : a + 4] = self.fold(_SEEDS[a : a + 4, None] * self.value, np.minimum)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[:, None], (BANDS, self.number))
        for i in range(ROWS):
            key = mix(key * np.uint64(31) + least.reshape(BANDS, ROWS, -1)[:, i])
        return key.T

    def bit_sketches(self) -> np.ndarray:
        """Parities of the sets' counts by hash: lines x words of 64 bits."""
        width = 64 * SKETCH_WORDS
        h = (mix(self.value + np.uint64(0x1234567)) % np.uint64(width)).astype(np.int64)
        bits = np.bincount(self.owner * width + h, minlength=self.number * width) & 1
        return np.packbits(bits.astype(np.uint8).reshape(self.number, width), axis=1).view(np.uint64)

    def members(self) -> pa.Array:
        return _lists(np.split(self.value, self.first[1:]) if self.number else [])


def _rows_of(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel(), type=pa.int64()))


class Block:
    """Words of a block of texts with their places in bytes, lines and code points."""

    def __init__(self, texts: list[bytes]):
        self.words, self.first, begin, end, joined = word_places(texts)
        point = np.cumsum((joined & 0xC0) != 0x80)  # code points up to and with each byte
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))
        text_at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])][:-1]
        base = np.where(text_at > 0, point[text_at - 1], 0)
        self.start = point[begin] - 1 - base[self.owner]
        self.end = point[end - 1] - base[self.owner]
        # a byte's line: newlines before it; a new text is a new line
        breaks = joined == 10
        breaks[text_at[1:] - 1] = True
        self.line = np.cumsum(breaks)[begin]

        self.word = np.arange(len(self.words)) - self.first[self.owner]
        run = np.zeros(max(len(self.words) - SHINGLE + 1, 0), dtype=np.uint64)
        for i in range(SHINGLE):
            run = run * _P + self.words[i : i + len(run)]
        self.run = mix(run)
        # sums by two rules, from which the hashes of any run of words follow
        up, _ = _Powers.of(len(self.words) + 1)
        self.sums = [np.r_[np.uint64(0), np.cumsum(w * up[: len(w)], dtype=np.uint64)] for w in (self.words, mix(self.words + _OTHER))]

    def hashes(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of the runs of ``size`` words from each place on."""
        _, down = _Powers.of(len(self.words) + 1)
        first, second = ((total[at + size] - total[at]) * down[at] for total in self.sums)
        return mix(first + np.uint64(0x51ED270B)), mix(second ^ np.uint64(size))

    def lines(self) -> np.ndarray:
        """Word ranges of the paragraphs."""
        edge = np.flatnonzero(np.r_[True, self.line[1:] != self.line[:-1], True]) if len(self.line) else np.zeros(1, dtype=np.int64)
        ranges = np.stack([edge[:-1], edge[1:]], axis=1)
        return ranges[ranges[:, 1] - ranges[:, 0] >= MIN_WORDS]

    def units(self) -> np.ndarray:
        """Word position of each content-cut unit."""
        n = len(self.words)
        if n < UNIT:
            return np.empty(0, dtype=np.int64)
        reach = ANCHOR + SHINGLE - 2
        at = anchors(self.run, self.owner[: n - reach] == self.owner[reach:]) - SIDE
        at = at[(at >= 0) & (at + UNIT <= n)]
        return at[self.owner[at] == self.owner[at + UNIT - 1]]

    def pieces(self, ids: np.ndarray, at: np.ndarray, last: np.ndarray, prints: tuple[np.ndarray, np.ndarray]) -> list[pa.Array]:
        """Columns of ``PIECE`` for the runs of words from ``at`` to ``last``."""
        cols = [ids[self.owner[at]].astype(np.int64), self.word[at], last - at, self.start[at], self.end[last - 1], *(p.view(np.int64) for p in prints)]
        return [pa.array(c, type=pa.int64()) for c in cols]


def _raw(texts: pa.Array, a: int, b: int) -> list[bytes]:
    return [x or b"" for x in texts[a:b].cast(pa.binary()).to_pylist()]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def unit_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All paragraphs (with band keys) and content-cut units (without) of every document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in blocks(batch.column(1)):
                with np.errstate(over="ignore"):
                    block = Block(_raw(batch.column(1), a, b))
                    lines, at = block.lines(), block.units()
                    sets = LineSets(block.run, lines)
                    lists = _rows_of(sets.band_keys()), _rows_of(sets.bit_sketches())
                    if len(lines):
                        yield pa.RecordBatch.from_arrays([*block.pieces(ids[a:b], lines[:, 0], lines[:, 1], sets.prints()), pa.array(sets.count), *lists], names=_names(UNITS))
                    if len(at):
                        none = pa.nulls(len(at), lists[0].type)
                        zero = pa.array(np.zeros(len(at), dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([*block.pieces(ids[a:b], at, at + UNIT, block.hashes(at, UNIT)), zero, none, none], names=_names(UNITS))

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).where("id is not null")
    return source.mapInArrow(run, UNITS)


def _line_sets(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                with np.errstate(over="ignore"):
                    block = Block(_raw(batch.column(0), a, b))
                    sets = LineSets(block.run, block.lines())
                    prints = [pa.array(p.view(np.int64)) for p in sets.prints()]
                yield pa.RecordBatch.from_arrays([*prints, sets.members()], names=["print", "print2", "members"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "print long, print2 long, members array<long>")


def _windows(docs: DataFrame, seeds: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``seeds(doc_id, word)`` -> pieces: the windows of ``WINDOW`` words that hold one of their document's units."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in blocks(batch.column(1)):
                with np.errstate(over="ignore"):
                    block = Block(_raw(batch.column(1), a, b))
                    units = [np.array(x, dtype=np.int64) + block.first[i] for i, x in enumerate(batch.column(2)[a:b].to_pylist())]
                    at = np.unique(np.concatenate([u - back for u in units for back in range(WINDOW - UNIT + 1)] or [np.empty(0, dtype=np.int64)]))
                    at = at[(at >= 0) & (at + WINDOW <= len(block.words))]
                    at = at[block.owner[at] == block.owner[at + WINDOW - 1]]
                    yield pa.RecordBatch.from_arrays(block.pieces(ids[a:b], at, at + WINDOW, block.hashes(at, WINDOW)), names=_names(PIECE))

    own = seeds.groupBy("doc_id").agg(F.collect_set("word").alias("words"))  # places in one text
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(own, "doc_id").select("doc_id", "text", "words").mapInArrow(run, PIECE)


def _classes(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """``pieces(doc_id, start, c1, c2, ...)`` whose class more than one document has, with ``removed``: whether an earlier piece of the class stays for it."""
    found = pieces.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "start")).alias("lead"), F.max("doc_id").alias("hi"))
    found = scratch.save(found.where(F.col("lead.doc_id") < F.col("hi")).drop("hi"))
    return pieces.join(found, ["c1", "c2"]).withColumn("removed", F.struct("doc_id", "start") != F.col("lead")).drop("lead")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start, end, group_id, n_copies, removed)``: one row per passage of a document that another document has too.

    Places are code points, end exclusive; a document's rows don't overlap. ``removed`` is true for what an earlier piece of its class repeats,
    false for the rest of what is shared. ``group_id`` is the class of the passage's longest piece (equal for whole copies), ``n_copies`` its number of rows.
    Nulls, blanks and texts under ``MIN_WORDS`` words have no passages, rows with a null id are passed over, repeated rows of one id
    count as one document, and an empty table gives no rows. Repeats inside one document alone aren't reported. Of a passage with words before and after it that
    differ, up to ``ANCHOR`` words at either end may be left out where more than ``MIN_WORDS`` words of it are found.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    units = scratch.save(unit_table(docs, id_col, text_col))
    lines = units.where("n > 0").groupBy("print", "print2").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits"))
    one = scratch.save(lines.withColumn("id", F.monotonically_increasing_id()))
    node = one.select("id", "doc", "print", "print2")

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = node.join(ids, "id", "left_semi")
        texts = docs.select(F.col(id_col).cast("long").alias("doc"), text_col).join(asked.select("doc").distinct(), "doc", "left_semi")
        made = _line_sets(texts, text_col).join(asked.select("id", "print", "print2"), ["print", "print2"])
        return made.dropDuplicates(["id"]).select("id", "members")

    near = scratch.save(linked_sets(one.select("id", "n", "keys", "bits"), sets_of, scratch, NUMERATOR, DENOMINATOR, two=False))
    both = near.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(near.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    root = node.select(F.col("id").alias("root"), F.col("print").alias("c1"), F.col("print2").alias("c2"))
    mapped = scratch.save(node.join(both, "id").join(root, "root").select("print", "print2", "c1", "c2"))
    for used in (one, near):
        scratch.drop(used)
    # documents of each print, counted once; only repeated or near ones go on, and these are told apart by both hashes
    spread = units.groupBy("print").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("print")
    repeated = scratch.save(spread.union(mapped.select("print")).distinct())
    found = scratch.save(units.drop("n", "keys", "bits").join(repeated, "print", "left_semi"))
    scratch.drop(units)
    named = found.join(mapped, ["print", "print2"], "left").select("doc_id", "word", "n_words", "start", "end", F.coalesce("c1", "print").alias("c1"), F.coalesce("c2", "print2").alias("c2"))
    named = scratch.save(named)
    scratch.drop(found)
    pieces = scratch.save(_classes(named, scratch))
    scratch.drop(named)
    runs, seeds = _short_runs(pieces, scratch)
    scratch.drop(pieces)
    windows = scratch.save(_windows(docs, seeds, id_col, text_col).withColumnsRenamed({"print": "c1", "print2": "c2"}))
    joined = scratch.save(_joined(_classes(windows, scratch)))
    scratch.drop(windows)
    sure = runs.where("sure").select(*joined.columns)
    every = scratch.save(_runs(sure.unionByName(joined)))
    for used in (runs, joined):
        scratch.drop(used)
    copies = scratch.save(every.groupBy("c1", "c2").agg(F.count("*").alias("n_copies")))
    out = every.join(copies, ["c1", "c2"])
    return out.select(F.col("doc_id").alias(id_col), "start", "end", F.col("c1").alias("group_id"), "n_copies", "removed")


def _joined(windows: DataFrame) -> DataFrame:
    """Shared windows that begin at successive words of a document and stay or go alike, as one piece."""
    order = Window.partitionBy("doc_id", "removed").orderBy("word")
    runs = windows.withColumn("run", F.col("word") - F.dense_rank().over(order))
    first = F.min(F.struct("word", "c1", "c2")).alias("first")
    out = runs.groupBy("doc_id", "removed", "run").agg(first, F.max("word").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"))
    size = F.col("last") - F.col("first.word") + WINDOW
    return out.select("doc_id", F.col("first.word").alias("word"), size.alias("n_words"), "start", "end", F.col("first.c1").alias("c1"), F.col("first.c2").alias("c2"), "removed")


def _short_runs(pieces: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pieces with ``sure``: whether they are in a run of more than ``MIN_WORDS`` words or of a paragraph. And ``(doc_id, word)`` of all units of the classes that the other runs have."""
    order = Window.partitionBy("doc_id").orderBy("word", "n_words")
    reach = F.max(F.col("word") + F.col("n_words"))
    last = reach.over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = pieces.withColumn("run", F.when(F.col("word") < last, 0).otherwise(1)).withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "run")
    runs = scratch.save(runs.withColumn("sure", (F.max("n_words").over(run) > UNIT) | (reach.over(run) - F.min("word").over(run) > MIN_WORDS)))
    asked = scratch.save(runs.where("not sure").select("c1", "c2").distinct())
    seeds = runs.where(F.col("n_words") == UNIT).join(asked, ["c1", "c2"], "left_semi").select("doc_id", "word")
    return runs, seeds


def _runs(pieces: DataFrame) -> DataFrame:
    """``pieces(doc_id, start, end, n_words, c1, c2, removed)`` -> ``(doc_id, start, end, c1, c2, removed)``, disjoint in each document."""
    top = F.struct("n_words", "c1", "c2")
    open_ = pieces.select(
        "doc_id", F.col("start").alias("at"), F.lit(1).alias("step"), "removed", top.alias("piece"), F.when(~F.col("removed"), F.struct("end", "n_words", "c1", "c2")).alias("far")
    )
    close = pieces.select("doc_id", F.col("end").alias("at"), F.lit(-1).alias("step"), "removed", F.lit(None).alias("piece"), F.lit(None).alias("far"))
    cut = F.when(F.col("removed"), F.col("step")).otherwise(0)
    points = open_.union(close).groupBy("doc_id", "at").agg(
        F.sum(cut).alias("cut"), F.sum("step").alias("all"), F.max(F.when(F.col("removed"), F.col("piece"))).alias("cut_piece"), F.max(F.when(~F.col("removed"), F.col("piece"))).alias("kept_piece"), F.max("far").alias("far")
    )
    order = Window.partitionBy("doc_id").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.sum("cut").over(so_far) > 0, 2).when(F.sum("all").over(so_far) > 0, 1).otherwise(0)
    points = points.select("doc_id", "at", F.lead("at").over(order).alias("next"), state.alias("state"), "cut_piece", "kept_piece", F.max("far").over(so_far).alias("far"))
    points = points.withColumn("run", F.sum(F.when(F.col("state") == F.lag("state", 1, -1).over(order), 0).otherwise(1)).over(so_far))
    # the kept piece that reaches furthest may have begun before its run, where something is removed
    reaching = F.when(F.col("far.end") > F.col("at"), F.struct(F.col("far.n_words").alias("n_words"), F.col("far.c1").alias("c1"), F.col("far.c2").alias("c2")))
    piece = F.when(F.col("state") == 2, F.col("cut_piece")).otherwise(F.greatest("kept_piece", reaching))
    runs = points.where("state > 0").groupBy("doc_id", "run", "state").agg(F.min("at").alias("start"), F.max("next").alias("end"), F.max(piece).alias("top"))
    return runs.select("doc_id", "start", "end", "top.c1", "top.c2", (F.col("state") == 2).alias("removed"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages that are copies cut out of their texts; all rows and columns stay."""
    spans = repeated_passages(docs, id_col, text_col).where("removed")
    cuts = spans.groupBy(F.col(id_col).alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))

    @F.pandas_udf("string")
    def left(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def cut(t, found):
            edges = [0, *(x for s in found for x in (s["start"], s["end"])), len(t)]
            return "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

        return pd.Series([t if t is None or found is None else cut(t, found) for t, found in zip(texts, spans, strict=True)], dtype=object)

    held = docs.join(cuts, docs[id_col] == F.col("__id"), "left")
    return held.withColumn(text_col, left(F.col(text_col).cast("string"), "__cuts")).select(*docs.columns)
