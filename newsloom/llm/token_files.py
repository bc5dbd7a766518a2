"""Token ids in Arrow files of equal-length sequences.

Documents are put in ascending id order, encoded, closed with an end id and laid end to end. Each Spark partition holds a run of
documents and writes one Arrow IPC file: record batches of two fixed-size-list columns, ``ids`` (unsigned, 16 bit where the
vocabulary fits and else 32) and ``mask`` (a bit per token, 1 where one is: bytes of eight, which ``numpy.unpackbits`` spreads), so that sequence i is a slice of memory at a known place and needs no copy. Beside it goes a
small file with each document's place. A table of the files, written when their tasks commit, is the only index; files of lost
task attempts are never in it.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shingles import blocks, word_places
from newsloom.scratch import Scratch

SEQUENCE = 2048
BATCH_SEQUENCES = 256
END_ID = 2
KEPT_WORDS = 500_000
SEPARATOR = "<|endoftext|>"


def letters(word: bytes) -> bool:
    """Whether a word is made of letters alone and stays so when composed and lower-cased."""
    return word.isalpha() or unicodedata.normalize("NFC", word.decode()).lower().isalpha()


class WordEncoder:
    """Encodes with the tokenizers library, each white-space-separated word once while it is remembered.

    Exact where the tokenizer drops white space and neither its normalizer nor its pattern looks across it;
    ``check()`` holds the tokenizer to that on construction, and another tokenizer is given whole texts. The words of a block are grouped by
    hash with numpy, new ones go to the library together, and the block's ids are gathered from the store of remembered ones.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.bare = Tokenizer.from_str(json.dumps(json.load(f) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.by_word = self.separator is not None and self.check()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = max(vocab.values()) >= 1 << 16
        self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closing[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _joined(self, tokenizer, words: list[bytes], joint: bytes, close: bool = False) -> np.ndarray:
        """Ids of words put together, a few dozen to a text; ``close`` sets the joint after the last word of each too."""
        texts = [joint.join(words[a : a + 48]).decode() + (joint.decode() if close else "") for a in range(0, len(words), 48)]
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32)

    def check(self) -> bool:
        probe = ["The", "end.", "don't", "x1", "é", "<|endoftext|>", "..", "́a"]
        apart = [i for w in probe for i in self._ids(w).tolist()]
        lower = ["the", "end", "tion", ".", ","]
        if self._joined(self.bare, [w.encode() for w in lower], b" ").tolist() != [i for w in lower for i in self._ids(w.title()).tolist()]:
            return False
        return all(self._ids(s.join(probe)).tolist() == apart for s in (" ", "\n", "\t\r\n ", "\x0b", "\x0c"))

    def learn(self, words: list[bytes]) -> None:
        """Remembers new words. Letters are one token that closes a word, letters and one closing mark are two: these are told apart in
        one text. Between others a special token is set, and those that hold one go alone. Lower-cased ASCII letters and marks are as the
        normalizer and the pattern would leave them, so they go to the vocabulary's merges directly."""
        ascii_, plain, marked, single = [], [], [], []
        for w in words:
            if w.isalpha() or w[-1:] in b".," and w[:-1].isalpha():
                ascii_.append(w)
            elif letters(w) or w[-1:] in b".," and letters(w[:-1]):
                plain.append(w)
            else:
                (single if b"<|" in w else marked).append(w)
        bare = [w.lower() if w.isalpha() else w[:-1].lower() + b" " + w[-1:] for w in ascii_]
        first, last, parts, at = [], [], [], len(self.store)
        for tokenizer, sent, own in ((self.bare, bare, ascii_), (self.tokenizer, plain, plain)):
            ids = self._joined(tokenizer, sent, b" ")
            closings = np.fromiter((1 + (w[-1:] in b".,") for w in own), dtype=np.int64, count=len(own))
            end = np.flatnonzero(self.closing[ids])[np.cumsum(closings) - 1] + 1 if own else np.zeros(0, dtype=np.int64)
            first.append(at + np.r_[0, end][: len(own)])
            last.append(at + end)
            parts.append(ids)
            at += len(ids)
        for group in (marked, *([w] for w in single)):
            ids = self._joined(self.tokenizer, group, SEPARATOR.encode(), True) if group is marked else self._ids(group[0].decode())
            cut = np.flatnonzero(ids == self.separator) if group is marked and group else np.array([len(ids)])[: len(group)]
            first.append(at + np.r_[0, cut + 1][: len(group)])
            last.append(at + cut)
            parts.append(ids)
            at += len(ids)
        plain = [*ascii_, *plain]
        begin = np.concatenate(first)
        self.slot.update(zip([*plain, *marked, *single], range(len(self.first), len(self.first) + len(words)), strict=True))
        self.count = np.r_[self.count, np.concatenate(last) - begin]
        self.first = np.r_[self.first, begin]
        self.store = np.concatenate([self.store, *parts])

    def encode_block(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts end to end, each text closed by ``end_id``, and the number of ids of each."""
        if not self.by_word:
            each = [np.r_[self._ids(t.decode()), np.uint32(end_id)].astype(np.uint32) for t in texts]
            return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
        with np.errstate(over="ignore"):
            hashes, starts, begin, end, _ = word_places(texts, lower=False)
        joined = b" ".join(texts)
        _, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(begin[place].tolist(), end[place].tolist(), strict=True)]
        new = [w for w in words if w not in self.slot]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.slot.__getitem__, words), dtype=np.int64, count=len(words))[inverse]
        count = self.count[at]
        before = np.r_[0, np.cumsum(count)]
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        out = np.full(int(before[-1]) + len(texts), end_id, dtype=np.uint32)
        step = np.arange(before[-1])
        out[step + np.repeat(owner, count)] = self.store[step + np.repeat(self.first[at] - before[:-1], count)]
        if len(self.slot) > KEPT_WORDS or len(self.store) > 16 * KEPT_WORDS:
            self.forget()
        return out, np.diff(before[starts]) + 1


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def file_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.uint8(), length // 8))])


INDEX = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Fills sequences of one file; holds at most one record batch of tokens."""

    def __init__(self, sink, length: int, wide: bool):
        if length % 8:
            raise ValueError("a sequence's length is a multiple of 8")
        self.length, self.need, self.kind = length, length * BATCH_SEQUENCES, np.uint32 if wide else np.uint16
        self.schema = file_schema(length, wide)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while self.count + len(ids) >= self.need:
            room = self.need - self.count
            self.held.append(ids[:room])
            ids = ids[room:]
            self._flush()
        if len(ids):
            self.held.append(ids)
            self.count += len(ids)

    def _flush(self) -> None:
        flat = np.concatenate(self.held)
        pad = -len(flat) % self.length
        mask = np.r_[np.ones(len(flat), dtype=np.uint8), np.zeros(pad, dtype=np.uint8)]
        flat = np.r_[flat.astype(self.kind), np.zeros(pad, dtype=self.kind)]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n) for x, n in ((flat, self.length), (np.packbits(mask), self.length // 8))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.count = [], 0

    def close(self) -> None:
        if self.count:
            self._flush()
        self.writer.close()


class TokenFile:
    """Random access to a written file. On a local path the pages are mapped, and a sequence is a view of them."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.last, self.held = -1, np.empty(0, dtype=np.uint32)  # the batch that was read last

    def batch(self, i: int, column: str = "ids") -> np.ndarray:
        """All values of batch i, without a copy."""
        return self.reader.get_batch(i).column(column).values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and packed mask of sequence i, both views; ``np.unpackbits`` spreads the mask to one value a token."""
        b, at = divmod(i, BATCH_SEQUENCES)
        part = lambda column, n: self.batch(b, column)[at * n : (at + 1) * n]
        return part("ids", self.length), part("mask", self.length // 8)

    def pieces(self, begin: int, n: int) -> Iterator[np.ndarray]:
        """Views that together hold n tokens from ``begin`` on."""
        size = self.length * BATCH_SEQUENCES
        while n > 0:
            b, at = divmod(begin, size)
            if b != self.last:
                self.last, self.held = b, self.batch(b)
            got = self.held[at : at + n]
            yield got
            begin, n = begin + len(got), n - len(got)


def write_token_files(docs: DataFrame, path: str, root: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Writes one file per partition under ``root`` and returns the manifest (part, file, n_docs, n_tokens); lazily, so save it.

    Null texts count as empty and leave the end id alone; rows with null ids come first; rows with one id follow each other by a hash of the text
    and then the text, so that one id's rows may fill several files. Repeated rows are written each.
    """

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}"
        words, writer, sink, rows = encoder(path), None, None, 0
        index = None
        for batch in batches:
            for a, b in blocks(batch.column(1)):
                texts = [x or b"" for x in batch.column(1)[a:b].cast(pa.binary()).to_pylist()]
                if writer is None:
                    sink = fs.open_output_stream(f"{folder}/{name}.arrow")
                    writer = SequenceWriter(sink, length, words.wide)
                    side = fs.open_output_stream(f"{folder}/{name}.docs.arrow")
                    index = pa.ipc.new_file(side, INDEX)
                flat, counts = words.encode_block(texts, end_id)
                begin = writer.total + np.cumsum(counts) - counts
                writer.add(flat)
                rows += len(texts)
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(begin), pa.array(counts)], schema=INDEX))
        if writer is not None:
            for x in (writer, sink, index, side):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [f"{root}/{name}"], "n_docs": pa.array([rows], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64())})

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.withColumn("mark", F.xxhash64("text")).repartitionByRange("id", "mark").sortWithinPartitions("id", "mark", "text")
    return ordered.select("id", "text").mapInArrow(write, "part long, file string, n_docs long, n_tokens long")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start in the whole run of tokens, n_tokens, crc32 of its ids; read back from the files."""

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                tokens = TokenFile(f"{uri}.arrow")
                fs, path = pafs.FileSystem.from_uri(f"{uri}.docs.arrow")
                with fs.open_input_file(path) as side:
                    index = pa.ipc.open_file(side)
                    for i in range(index.num_record_batches):
                        docs = index.get_batch(i)
                        sums = []
                        for begin, n in zip(docs.column("begin").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for piece in tokens.pieces(begin, n):
                                crc = zlib.crc32(piece.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [docs.column("doc_id"), pc.add(docs.column("begin"), base), docs.column("n_tokens"), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    # one row per file: as few as there are partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "part").select("file", "base")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_report(docs: DataFrame, path: str) -> DataFrame:
    """Writes ``docs`` as token files in the shared folder and reads every document back from them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = scratch.save(write_token_files(docs, path, f"{scratch.root}/files"))
    return read_documents(manifest)
