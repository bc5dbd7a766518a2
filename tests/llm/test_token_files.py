import zlib

import numpy as np
import public_tokenizers

from newsloom.llm.token_files import BATCH_SEQUENCES, TokenFile, WordEncoder, read_documents, token_file_report, write_token_files
from newsloom.scratch import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["The End. don't <|endoftext|>x <|ENDoftext|> a<|endoftext|>b.", "H̱a Σας ΟΔΟΣ. İx", "\x1cab\x1d cd ef g. ́", "x.. y., z. ...", "ﬁ. ǅ.", "", " \n", "漢字 é.", "1,2.3, 4."]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_encode_as_whole_texts():
    lib, own = library(), WordEncoder(PATH)
    assert own.by_word
    texts = TEXTS + [f"{chr(i)}a {chr(i)} A{chr(i)}." for i in range(1, 0x3000) if not 0xD800 <= i <= 0xDFFF]
    for _ in range(2):  # learned, then known
        flat, counts = own.encode_block([t.encode() for t in texts], 2)
        got = np.split(flat, np.cumsum(counts)[:-1])
        for t, g, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert g.tolist() == [*e.ids, 2], repr(t)


def test_files(spark):
    lib = library()
    rows = [(i * 3 % 101, f"text {i} " + TEXTS[i % len(TEXTS)] * (i % 7), i) for i in range(100)] + [(500, None, 1), (600, "long text " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    at, want = 0, []
    for i, t, _ in sorted(rows):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_file_report(df, PATH).collect())) == want
    assert token_file_report(df.limit(0), PATH).collect() == []
    # random access: every sequence is full but for a file's last, and a view of the file's memory
    scratch = Scratch(spark, "test")
    files = scratch.save(write_token_files(df, PATH, f"{scratch.root}/files", length=16)).orderBy("part").collect()
    flat = []
    for f in files:
        t = TokenFile(f"{f.file}.arrow")
        for i in range(-(-f.n_tokens // 16)):
            ids, mask = t.sequence(i)
            assert len(ids) == 8 * len(mask) == 16 and not ids.flags.owndata and not mask.flags.owndata
            flat += ids[np.unpackbits(mask) == 1].tolist()
        assert t.reader.num_record_batches == -(-f.n_tokens // (16 * BATCH_SEQUENCES))
    assert len(flat) == at
    assert read_documents(scratch.save(write_token_files(df, PATH, f"{scratch.root}/more"))).count() == len(rows)


def test_null_and_repeated_ids(spark):
    lib = library()
    rows = [(None, f"no id {i}") for i in range(40)] + [(None, None), (3, "three"), (3, "three"), (3, "another three"), (5, "")]
    got = token_file_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).collect()
    size = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids) + 1
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted((i is not None, i or 0, size(t)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # end to end, ids ascending, nulls first
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == [None] * 41 + [3, 3, 3, 5]
