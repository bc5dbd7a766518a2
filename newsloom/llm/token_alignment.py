"""Alignment of two tokenizers over the bytes of the same texts, and corpus-wide counts of the tokens that end together.

Each text (with a space before it) is encoded by a byte-level vocabulary (A) and by a piece model (B). Byte places where tokens of both end cut the tokens into groups,
and the two tokens that end there are linked; as no token is empty, a group has one link. Texts are cut before single spaces that follow no space and
precede no white space: neither vocabulary joins across such a place, so each different unit is encoded and aligned once while it is remembered.

Counting is external. A task buffers (pair, document, times) records; a full buffer is sorted by B's id and then A's, dealt by radix of B's id and
spilled as zstd runs: the pairs with their counts in small frames, and apart from them the documents of each pair. Spark's shuffle carries the runs' pairs; a k-way heap merge reads them frame by frame
(``FAN_IN`` runs at a time, in levels that shrink by that factor) and adds the counts of each pair. As the order is by B's id first, all pairs of one B id pass together
and their maximum is known when the next id comes. The merged counts, at most one entry a pair whatever the corpus, then meet the runs again, radix by radix, and the contributions to
documents stream back, a dense vector for each run and radix, to be added by run. A pair that is in every document has one entry a run, so no task holds a hot pair's records;
the documents of a run are dealt over tasks by (radix, salt of the run).

Spilled runs and merged counts are written tables: a lost executor costs the running stage only.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import ByteBpe, Slots, spread
from newsloom.llm.shingles import blocks
from newsloom.scratch import Scratch

RADIX = 64
FAN_IN = 64
FRAME = 4096
RUN_LINKS = 4 << 20
RUN_DOCS = 1 << 16
SALT_RUNS = 64
KEPT_UNITS = 200_000
KEPT_BYTES = 64 << 20
SPACE_MARK = "▁"
A_BITS = 24
_CUT = re.compile(r"(?<! ) (?=\S)")
_FACTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class PieceModel:
    """Ids and bytes of a sentencepiece model that puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        token = [bytes([int(p[3:-1], 16)]) if m.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.token_bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in token], dtype=np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        inside = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names)
        probe = ["The", "end.\n", "x\n\ny", "é  z", "ﬁ　½\t", "日", "<s>a", "x"]
        self.by_unit = not inside and [i for p in probe for i in m.encode(p)] == m.encode(" ".join(probe))


class UnitAligner:
    """Aligned units that were met of late: ids, links and the text of the groups of each."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a = ByteBpe(byte_path)
        self.a.split = None  # special tokens' strings are plain text
        self.b = PieceModel(piece_path)
        if len(self.a.token_size) >= 1 << A_BITS:
            raise ValueError("the byte-level vocabulary is larger than the packed pairs allow")
        digits = [str(i).encode() for i in range(max(len(self.a.token_size), len(self.b.token_size)))]
        self.digit_count = np.array([len(d) for d in digits], dtype=np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(8) for d in digits), dtype=np.uint8).reshape(-1, 8)
        self.forget()

    def forget(self) -> None:
        self.slots = Slots()
        self.groups: list[bytes] = []
        self.held = 0
        self.exact = np.zeros(0, dtype=bool)
        self.sizes = np.zeros((0, 3), dtype=np.int64)  # tokens of A, of B, links
        self.first = np.zeros(0, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def units(self, text: str) -> list[str]:
        """The text's units, each without the space before it."""
        if not self.b.by_unit:
            return [text]
        head, *rest = _CUT.split(" " + text)
        return [head[1:], *rest] if head else rest

    def learn(self, units: list[str]) -> None:
        """Encodes and aligns new units, all together."""
        words = [self.a.words.findall(" " + u) for u in units]
        ids, count = self.a.look_up([w for own in words for w in own])
        a_count = np.bincount(np.repeat(np.arange(len(units)), [len(w) for w in words]), weights=count, minlength=len(units)).astype(np.int64)
        if len(self.a.slots) > KEPT_UNITS:
            self.a.forget()
        a = ids.astype(np.int64)
        found = self.b.model.encode(units, num_threads=1)
        b_count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        b = np.fromiter((i for own in found for i in own), dtype=np.int64, count=int(b_count.sum()))
        raw = [b" " + u.encode() for u in units]
        exact = self.same_bytes(self.a, a, a_count, raw) & self.same_bytes(self.b, b, b_count, raw)
        a, b = a[np.repeat(exact, a_count)], b[np.repeat(exact, b_count)]
        a_count, b_count = a_count * exact, b_count * exact
        # Places of ends in all units laid end to end; the end of a unit is one of both sides.
        a_end, b_end = np.cumsum(self.a.token_size[a]), np.cumsum(self.b.token_size[b])
        at = np.searchsorted(b_end, a_end)
        a_last = np.flatnonzero(b_end[np.minimum(at, max(len(b_end) - 1, 0))] == a_end) if len(b_end) else at
        b_last = at[a_last]
        unit_of_a = np.repeat(np.arange(len(units)), a_count)
        n_links = np.bincount(unit_of_a[a_last], minlength=len(units))
        texts = self.group_texts(a, b, a_last, b_last, unit_of_a, len(units))
        self.groups += texts
        self.held += sum(map(len, texts)) + sum(map(len, raw))
        self.first = np.r_[self.first, np.cumsum(n_links) - n_links + len(self.links)]
        self.links = np.r_[self.links, b[b_last] << A_BITS | a[a_last]]
        self.sizes = np.r_[self.sizes, np.stack([a_count, b_count, n_links], axis=1)]
        self.exact = np.r_[self.exact, exact]

    @staticmethod
    def same_bytes(model: ByteBpe | PieceModel, ids: np.ndarray, count: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens' bytes are those of each unit."""
        joined = model.token_bytes[spread(model.token_first[ids], model.token_size[ids])].tobytes()
        owner = np.repeat(np.arange(len(raw)), count)
        ends = np.cumsum(np.bincount(owner, weights=model.token_size[ids], minlength=len(raw)).astype(np.int64)).tolist()
        return np.fromiter((joined[s:e] == r for s, e, r in zip([0, *ends], ends, raw)), dtype=bool, count=len(raw))

    def group_texts(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, unit_of_a: np.ndarray, n: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        a_ends, b_ends = np.r_[0, a_last + 1], np.r_[0, b_last + 1]  # tokens before each group
        a_group, b_group = np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))
        order = np.r_[np.arange(len(a)) + b_ends[a_group], np.arange(len(b)) + a_ends[b_group + 1]]
        ids, mark = np.empty(len(order), dtype=np.int64), np.full(len(order), ord(","), dtype=np.uint8)
        ids[order] = np.r_[a, b]
        mark[order[a_last]] = ord("|")
        mark[order[len(a) + b_last]] = ord(";")
        size = self.digit_count[ids]
        end = np.cumsum(size + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
        for k in range(int(size.max(initial=0))):
            own = np.flatnonzero(size > k)
            out[end[own] - 1 - size[own] + k] = self.digits[ids[own], k]
        out[end - 1] = mark
        last = np.flatnonzero(np.r_[unit_of_a[a_last][1:] != unit_of_a[a_last][:-1], True]) if len(a_last) else a_last
        ends = np.zeros(n, dtype=np.int64)
        ends[unit_of_a[a_last[last]]] = end[order[len(a) + b_last[last]]]
        whole = out.tobytes()
        found, at = [], 0
        for e in ends.tolist():
            found.append(whole[at : e - 1] if e else b"")
            at = e or at
        return found

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of a block of texts: numbers of tokens and links, groups, and the links end to end with the text that each is of."""
        units = [self.units(t) if t else [] for t in texts]
        count = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        slot = np.fromiter((self.slots[u] for own in units for u in own), dtype=np.int64, count=int(count.sum()))
        if new := self.slots.new:
            self.slots.new = []
            self.learn(new)
        owner = np.repeat(np.arange(len(texts)), count)
        good = np.bincount(owner[~self.exact[slot]], minlength=len(texts)) == 0
        slot, owner = slot[good[owner]], owner[good[owner]]
        ends = np.cumsum(count * good).tolist()
        held, plain = self.groups, slot.tolist()
        groups = [b";".join([held[i] for i in plain[s:e]]) for s, e in zip([0, *ends], ends)]
        size = self.sizes[slot]
        total = np.stack([np.bincount(owner, weights=size[:, k], minlength=len(texts)) for k in range(3)], axis=1).astype(np.int64)
        links = self.links[spread(self.first[slot], size[:, 2])]
        whose = np.repeat(owner, size[:, 2])
        if len(self.slots) > KEPT_UNITS or self.held > KEPT_BYTES:
            self.forget()
        return total, groups, links, whose


_LOADED: dict[tuple[str, str], UnitAligner] = {}


def aligner(byte_path: str, piece_path: str) -> UnitAligner:
    """One per worker process and pair of files."""
    if (byte_path, piece_path) not in _LOADED:
        _LOADED[byte_path, piece_path] = UnitAligner(byte_path, piece_path)
    return _LOADED[byte_path, piece_path]


def align(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", out_col: str = "aligned") -> DataFrame:
    """Adds ``out_col``: struct(n_a, n_b, n_groups, groups), of each text for itself. Null and empty texts, and texts that one of the vocabularies doesn't give back byte for byte, have none."""

    @F.pandas_udf("n_a long, n_b long, n_groups long, groups string")
    def aligned(texts: pd.Series) -> pd.DataFrame:
        own, out = aligner(byte_path, piece_path), []
        values = pa.array([t if isinstance(t, str) else None for t in texts], type=pa.string())
        for s, e in blocks(values):
            total, groups, _, _ = own.align(values[s:e].to_pylist())
            out.append(pd.DataFrame({"n_a": total[:, 0], "n_b": total[:, 1], "n_groups": total[:, 2], "groups": [g.decode() for g in groups]}))
        return pd.concat(out) if out else pd.DataFrame({"n_a": [], "n_b": [], "n_groups": [], "groups": []})

    return docs.withColumn(out_col, aligned(F.col(text_col).cast("string")))


# Runs: frames of FRAME entries, each the lengths, the keys' differences, the counts and (of merged runs) a mark for each of the best.


def pack(keys: np.ndarray, counts: np.ndarray, best: np.ndarray | None = None) -> bytes:
    out = []
    for s in range(0, len(keys), FRAME):
        own, marks = keys[s : s + FRAME], b"" if best is None else best[s : s + FRAME].astype(np.uint8).tobytes()
        raw = np.diff(own, prepend=0).astype("<i8").tobytes() + counts[s : s + FRAME].astype("<i8").tobytes() + marks
        blob = zstandard.compress(raw, 3)
        out.append(struct.pack("<II", len(blob), len(own)) + blob)
    return b"".join(out)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at = 0
    while at < len(run):
        size, n = struct.unpack_from("<II", run, at)
        raw = zstandard.decompress(run[at + 8 : at + 8 + size])
        at += 8 + size
        yield np.cumsum(np.frombuffer(raw, "<i8", n)), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, np.uint8, offset=16 * n)


def entries(run: bytes) -> Iterator[tuple[int, int]]:
    for keys, counts, _ in frames(run):
        yield from zip(keys.tolist(), counts.tolist(), strict=True)


def summed(runs: list[bytes]) -> Iterator[tuple[int, int]]:
    """A k-way heap merge: each pair with its count over all runs, by B's id and then A's."""
    merged = heapq.merge(*map(entries, runs))
    key, total = next(merged, (None, 0))
    for k, n in merged:
        if k == key:
            total += n
        else:
            yield key, total
            key, total = k, n
    if key is not None:
        yield key, total


def merge(runs: list[bytes], last: bool = False) -> bytes:
    """One run of several. The last one marks the pairs with the highest count of their B id, ties included."""
    out, keys, counts, marks = [], [], [], []

    def write() -> None:
        out.append(pack(np.array(keys, dtype=np.int64), np.array(counts, dtype=np.int64), np.array(marks, dtype=bool) if last else None))
        keys.clear(), counts.clear(), marks.clear()

    side, begin = -1, 0
    for key, n in summed(runs):
        if last and key >> A_BITS != side:  # all pairs of one B id have passed
            most = max(counts[begin:], default=0)
            marks += [c == most for c in counts[begin:]]
            side = key >> A_BITS
            if len(keys) >= FRAME:
                write()
            begin = len(keys)
        elif not last and len(keys) >= FRAME:
            write()
        keys.append(key)
        counts.append(n)
    most = max(counts[begin:], default=0)
    if last:
        marks += [c == most for c in counts[begin:]]
    if keys:
        write()
    return b"".join(out)


def load(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(frames(run))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))


def pack_docs(places: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> bytes:
    """The documents of each pair: how many, their places in the run and how often each."""
    small = "<u2" if times.max(initial=0) < 1 << 16 else "<u4"
    raw = struct.pack("<IIB", len(sizes), len(places), int(small[2])) + sizes.astype("<u4").tobytes() + places.astype("<u2").tobytes() + times.astype(small).tobytes()
    return zstandard.compress(raw, 3)


def load_docs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    pairs, records, width = struct.unpack_from("<IIB", raw)
    at = 9
    sizes = np.frombuffer(raw, "<u4", pairs, at).astype(np.int64)
    places = np.frombuffer(raw, "<u2", records, at + 4 * pairs).astype(np.int64)
    return sizes, places, np.frombuffer(raw, f"<u{width}", records, at + 4 * pairs + 2 * records).astype(np.int64)


class Spill:
    """Links of the documents met since the last spill."""

    def __init__(self):
        self.ids, self.sizes, self.digests, self.records, self.links = [], [], [], [], 0

    def add(self, ids: list, total: np.ndarray, groups: list[bytes], links: np.ndarray, whose: np.ndarray) -> None:
        self.records.append(links << 16 | (whose + len(self.ids)))
        self.links += len(links)
        self.ids += ids
        self.sizes.append(total)
        self.digests += [hashlib.sha256(g).hexdigest() if g else "" for g in groups]

    def runs(self) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Radix, number of documents, pairs and documents of each sorted run."""
        records, times = np.unique(np.concatenate(self.records) if self.records else np.zeros(0, np.int64), return_counts=True)
        radix = (records >> 16 >> A_BITS) % RADIX
        order = np.argsort(radix, kind="stable")
        cut = np.searchsorted(radix[order], np.arange(RADIX + 1))
        for r in range(RADIX):
            own = order[cut[r] : cut[r + 1]]
            if not len(own):
                continue
            keys, n = records[own] >> 16, times[own]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            yield r, len(self.ids), pack(keys[first], np.add.reduceat(n, first)), pack_docs(records[own] & 0xFFFF, n, np.diff(np.r_[first, len(keys)]))


def spill(docs: DataFrame, byte_path: str, piece_path: str, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: rows of documents (``radix`` null) and of runs (``place`` null), told apart by ``block``, a spill of one task."""
    kind = docs.schema[id_col].dataType.simpleString()
    form = f"block long, radix int, place int, doc_id {kind}, {_FACTS}, n_docs int, pairs binary, docs binary"

    def spilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, number = aligner(byte_path, piece_path), Spill(), TaskContext.get().partitionId() << 32
        id_type = None

        def written() -> Iterator[pa.RecordBatch]:
            n, sizes = len(now.ids), np.concatenate(now.sizes)
            runs = list(now.runs())
            names = [f.split()[0] for f in form.split(", ")]
            nulls = lambda k, t: pa.nulls(k, t)
            ints, longs = pa.int32(), pa.int64()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), nulls(n, ints), pa.array(np.arange(n, dtype=np.int32)), pa.array(now.ids, id_type),
                *(pa.array(sizes[:, k]) for k in (0, 1, 2, 2)), pa.array(now.digests, pa.string()), nulls(n, ints), nulls(n, pa.binary()), nulls(n, pa.binary()),
            ], names=names)
            k = len(runs)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, number)), pa.array([r[0] for r in runs], ints), nulls(k, ints), nulls(k, id_type), *(nulls(k, longs) for _ in range(4)), nulls(k, pa.string()),
                pa.array([r[1] for r in runs], ints), pa.array([r[2] for r in runs], pa.binary()), pa.array([r[3] for r in runs], pa.binary()),
            ], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, texts = batch.column(0), batch.column(1)
            for s, e in blocks(texts):
                for i in range(s, e, RUN_DOCS):
                    j = min(i + RUN_DOCS, e)
                    if now.ids and len(now.ids) + j - i > RUN_DOCS:
                        yield from written()
                        now, number = Spill(), number + 1
                    now.add(ids[i:j].to_pylist(), *own.align(texts[i:j].to_pylist()))
                if now.links >= RUN_LINKS:
                    yield from written()
                    now, number = Spill(), number + 1
        if now.ids:
            yield from written()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(spilled, form)


def merged_runs(runs: DataFrame, blocks_met: int) -> DataFrame:
    """``radix, pairs``: the counts over all runs, one row a radix. Levels of merges of about ``FAN_IN`` runs each."""
    form = "radix int, salt long, pairs binary"

    def merging(last: bool):
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []

            def written() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([merge(held, last)], pa.binary())], names=["radix", "salt", "pairs"])

            for batch in batches:
                for radix, salt, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (radix, salt) != now:
                        if held:
                            yield written()
                        now, held = (radix, salt), []
                    held.append(pairs)
                    if len(held) >= 2 * FAN_IN:
                        held = [merge(held)]
            if held:
                yield written()

        return merged

    n = math.ceil(blocks_met / FAN_IN)
    level = runs.select("radix", F.pmod(F.xxhash64("block"), F.lit(max(n, 1))).alias("salt"), "pairs")
    while True:
        level = level.repartition("radix", "salt").sortWithinPartitions("radix", "salt").mapInArrow(merging(n <= 1), form)
        if n <= 1:
            return level.select("radix", "pairs")
        n = math.ceil(n / FAN_IN)
        level = level.select("radix", F.pmod("salt", F.lit(n)).alias("salt"), "pairs")


def contributions(runs: DataFrame, merged: DataFrame, blocks_met: int) -> DataFrame:
    """``block, place, n_best, count_sum`` of all documents that have links."""
    salts = math.ceil(blocks_met / SALT_RUNS) or 1
    of_all = merged.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "pairs")
    of_all = of_all.select("radix", "salt", F.lit(-1).cast("long").alias("block"), F.lit(None).cast("int").alias("n_docs"), "pairs", F.lit(None).cast("binary").alias("docs"))
    dealt = runs.select("radix", F.pmod(F.xxhash64("block"), F.lit(salts)).alias("salt"), "block", "n_docs", "pairs", "docs").unionByName(of_all)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = load(b"")
        for batch in batches:
            block, n_docs, pairs, docs = (c.to_pylist() for c in batch.columns[2:])
            met, out = [], []
            for i, number in enumerate(block):
                if number < 0:  # a radix's merged counts come before its runs
                    held = load(pairs[i])
                    continue
                keys, _, _ = load(pairs[i])
                at = np.searchsorted(held[0], keys)
                sizes, places, times = load_docs(docs[i])
                both = np.zeros((2, n_docs[i]), dtype=np.int64)
                np.add.at(both[0], places, times * np.repeat(held[2][at].astype(np.int64), sizes))
                np.add.at(both[1], places, times * np.repeat(held[1][at], sizes))
                met.append(number)
                out.append(zstandard.compress(both.astype("<i8").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(out, pa.binary())], names=["block", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        names = ["block", "place", "n_best", "count_sum"]
        row = lambda: pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], now)), pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], names=names)
        for batch in batches:
            for block, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(zstandard.decompress(sums), "<i8").reshape(2, -1)
                if block != now:
                    if now is not None:
                        yield row()
                    now, total = block, np.zeros_like(own)
                total = total + own
        if now is not None:
            yield row()

    back = dealt.repartition("radix", "salt").sortWithinPartitions("radix", "salt", "block").mapInArrow(streamed, "block long, sums binary")
    return back.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block long, place int, n_best long, count_sum long")


def count_links(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The saved tables of a corpus: documents, runs, merged counts; and the number of spills."""
    scratch = Scratch(docs.sparkSession, "links")
    table = scratch.save(spill(docs, byte_path, piece_path, id_col, text_col))
    facts, runs = table.where("radix is null"), table.where("radix is not null")
    blocks_met = runs.select("block").distinct().count()
    return facts, runs, scratch.save(merged_runs(runs, blocks_met)), blocks_met


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """``a, b, links, best``: how many links of the whole corpus hold each pair of ids, and whether no pair of the same B id has more."""
    merged = count_links(docs.select(F.lit(0).alias("doc_id"), text_col), byte_path, piece_path, "doc_id", text_col)[2]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column(0).to_pylist():
                for keys, counts, best in frames(run):
                    yield pa.RecordBatch.from_arrays([pa.array((keys & (1 << A_BITS) - 1).astype(np.int32)), pa.array((keys >> A_BITS).astype(np.int32)), pa.array(counts), pa.array(best.astype(bool))], names=["a", "b", "links", "best"])

    return merged.select("pairs").mapInArrow(listed, "a int, b int, links long, best boolean")


def alignment_report(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: numbers of tokens, groups and links, links whose pair is the best of its B id over the corpus, the sum of the pairs' counts over links, and a digest of the groups.

    Null and empty texts, and those that a vocabulary doesn't give back byte for byte, have zeros and an empty digest. Repeated rows count each time; rows are told apart by
    their place in a spill, so ids may be null or repeat. An empty table gives an empty result.
    """
    facts, runs, merged, blocks_met = count_links(docs, byte_path, piece_path, id_col, text_col)
    sums = contributions(runs, merged, blocks_met)
    out = facts.select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ["block", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
