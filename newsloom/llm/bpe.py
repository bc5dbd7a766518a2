"""Byte-level BPE encoding and decoding.

A text is cut into words by the vocabulary's pattern; a word starts as its bytes. A short word keeps its part boundaries
and the ranks of adjacent parts in two contiguous arrays: the least rank is found by a scan, its boundary deleted and the two
neighbouring ranks refreshed, until no pair has a rank. The words of one length are rows of one array, so each step is taken for all of them together.
A long word does the same with a heap, so that its cost isn't the square of its length.

Texts are taken in blocks. Each different word of a block is looked up once; ids of merged words lie end to end in one array, and a block's ids
are gathered from it by place. A worker forgets its words when there are more than ``kept_words``; results don't depend on that.

Token ids travel as binary: little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import give_back

#: Fixed value: the pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 64
KEPT_WORDS = 150_000
BLOCK_WORDS = 150_000
DECODE_IDS = 1 << 18
SEGMENT_CHARS = 1 << 19
_SAFE_CUT = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z])")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Slots(dict):
    """Word -> its number; a word that is met for the first time gets the next one and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.given = 0

    def __missing__(self, word: str) -> int:
        self[word] = slot = self.given
        self.given += 1
        self.new.append(word)
        return slot


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of each run of ``count``, end to end."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


class ByteBpe:
    """A vocabulary, with the words that were merged of late."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.rank: dict[int, int] = {}
        made: list[int] = []
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 20 | vocab[b], i)
            made.append(vocab[a + b])
        self.none = len(made)  # the rank of a pair that never merges
        self.made = np.array([*made, 0], dtype=np.int64)
        pairs = sorted(self.rank)
        self.pairs = np.array([*pairs, 1 << 62], dtype=np.int64)
        self.pair_rank = np.array([*(self.rank[p] for p in pairs), self.none], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        token = [b""] * size
        for t, i in vocab.items():
            token[i] = bytes(back[c] for c in t) if t not in self.special else t.encode()
        for t, i in self.special.items():
            token[i] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.token_size = np.array([len(t) for t in token], dtype=np.int64)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.words = regex.compile(PATTERN)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.slots = Slots()
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.uint32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], self.none)

    def merge_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row each -> (row numbers, their ids) for the rows that are done after no step, one step and so on."""
        rows = np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows) and parts.shape[1] > 1:
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            live = least < self.none
            if not live.all():
                yield rows[~live], parts[~live]
                rows, parts, ranks, at, least = rows[live], parts[live], ranks[live], at[live], least[live]
            if not len(rows):
                return
            each, width = np.arange(len(rows)), parts.shape[1]
            parts[each, at] = self.made[least]
            stay = np.arange(width) != (at + 1)[:, None]  # each row loses the boundary after its least rank
            parts = parts[stay].reshape(len(rows), width - 1)
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(rows), width - 2)
            if width > 2:
                after, before = np.flatnonzero(at < width - 2), np.flatnonzero(at > 0)
                i = at[after]
                ranks[after, i] = self.ranks(parts[after, i], parts[after, i + 1])
                i = at[before] - 1
                ranks[before, i] = self.ranks(parts[before, i], parts[before, i + 1])
        if len(rows):
            yield rows, parts

    def merge_words(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and the number of ids of each."""
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(sizes[(sizes > 0) & (sizes <= SHORT)]).tolist():
            own = np.flatnonzero(sizes == n)
            parts = self.byte_id[np.frombuffer(b"".join([raws[i] for i in own.tolist()]), dtype=np.uint8)].reshape(-1, n)
            done += [(own[rows], ids) for rows, ids in self.merge_rows(parts)]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            done.append((np.array([i]), np.array([self.merge_long(raws[i])], dtype=np.int64)))
        count = np.zeros(len(raws), dtype=np.int64)
        for rows, ids in done:
            count[rows] = ids.shape[1]
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), dtype=np.uint32)
        for rows, ids in done:
            flat[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, count

    def merge_short(self, raw: bytes) -> list[int]:
        return self.merge_words([raw])[0].tolist()

    def merge_long(self, raw: bytes) -> list[int]:
        ids: list[int | None] = self.byte_id[np.frombuffer(raw, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank, made = self.rank.get, self.made
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << 20 | b)) is not None]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (r := rank(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # out of date
            ids[i], ids[j] = int(made[r]), None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in ids if i is not None]

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's words end to end, and the number of ids of each; each different word is merged at most once."""
        at = np.fromiter(map(self.slots.__getitem__, words), dtype=np.int64, count=len(words))
        if new := self.slots.new:
            plain = [w for w in new if w not in self.special]
            flat, own = self.merge_words([w.encode("utf-8", "surrogatepass") for w in plain])
            is_plain = np.fromiter((w not in self.special for w in new), dtype=bool, count=len(new))
            count = np.ones(len(new), dtype=np.int64)
            count[is_plain] = own
            first = np.cumsum(count) - count
            ids = np.zeros(int(count.sum()), dtype=np.uint32)
            ids[spread(first[is_plain], own)] = flat
            ids[first[~is_plain]] = [self.special[w] for w in new if w in self.special]
            self.first = np.r_[self.first, first + len(self.store)]
            self.count = np.r_[self.count, count]
            self.store = np.r_[self.store, ids]
            self.slots.new = []
        count = self.count[at]
        return self.store[spread(self.first[at], count)], count

    def pieces(self, text: str) -> Iterator[list[str]]:
        """A text's words, a segment at a time. A special token's string is a word of its own."""
        for n, part in enumerate(self.split.split(text) if self.split else [text]):
            if n % 2:
                yield [part]
            else:
                for piece in segments(part):
                    yield self.words.findall(piece)

    def encode_all(self, texts: Iterable[str | None], kept_words: int = KEPT_WORDS) -> list[bytes]:
        """Ids of each text as bytes; a null or empty text has none."""
        out: list[list[bytes]] = []
        words: list[str] = []
        runs: list[tuple[int, int]] = []

        def flush() -> None:
            ids, count = self.look_up(words)
            ends = np.r_[0, np.cumsum(count)]
            start = 0
            for i, end in runs:
                out[i].append(ids[ends[start] : ends[end]].tobytes())
                start = end
            words.clear()
            runs.clear()
            if len(self.slots) > kept_words or len(self.store) > 8 * kept_words:
                self.forget()

        for i, text in enumerate(texts):
            out.append([])
            for piece in self.pieces(text or ""):
                words += piece
                runs.append((i, len(words)))
                if len(words) >= BLOCK_WORDS:
                    flush()
        if words:
            flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def __getitem__(self, word: str) -> bytes:
        """Ids of one word as bytes."""
        return self.look_up([word])[0].tobytes()

    def decode(self, ids: bytes | None) -> str:
        tokens = np.frombuffer(ids or b"", dtype="<u4")
        out = []
        for a in range(0, len(tokens), DECODE_IDS):
            part = tokens[a : a + DECODE_IDS]
            out.append(self.token_bytes[spread(self.token_first[part], self.token_size[part])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def segments(text: str) -> Iterator[str]:
    """A very long text in pieces, cut before single spaces where a word starts; there the pattern never matches across."""
    start = 0
    while len(text) - start > 2 * SEGMENT_CHARS and (m := _SAFE_CUT.search(text, start + SEGMENT_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


_LOADED: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", kept_words: int = KEPT_WORDS) -> DataFrame:
    """Adds ``out_col``, the packed token ids; a null text counts as empty. Rows and other columns stay. ``kept_words`` bounds a worker's memory only."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        out = pd.Series(vocabulary(path).encode_all(texts, kept_words), dtype=object)
        give_back()
        return out

    return docs.withColumn(out_col, ids(F.col(text_col).cast("string")))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text of packed token ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        bpe = vocabulary(path)
        return pd.Series([bpe.decode(x) for x in packed], dtype=object)

    return df.withColumn(out_col, text(F.col(ids_col)))


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", kept_words: int = KEPT_WORDS) -> DataFrame:
    """Adds what ``encode`` and then ``decode`` add. One function gives both: of two chained ones Spark would run the first twice, once for its own column and once for the other's."""

    @F.pandas_udf("ids binary, decoded string")
    def both(texts: pd.Series) -> pd.DataFrame:
        bpe = vocabulary(path)
        ids = bpe.encode_all(texts, kept_words)
        out = pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([bpe.decode(x) for x in ids], dtype=object)})
        give_back()
        return out

    made = both(F.col(text_col).cast("string"))
    return docs.withColumns({ids_col: made["ids"], out_col: made["decoded"]})


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens, and digests of the packed ids and of the text decoded from them."""
    df = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    df = encode_decode(df, path).drop("text")
    return df.select(
        id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
