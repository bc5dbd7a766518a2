import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers

from newsloom.llm.bpe import ByteBpe, decode, encode, encode_decode, segments, token_digests

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_same_as_the_library():
    lib, own, rng = library(), ByteBpe(PATH), random.Random(5)
    pool = ["a", "the", "tion", " ", "  ", "\n", "\t", "é", "ß", "中", "1", "23", "'s", "'ll", "!", "...", "<|endoftext|>", " ", "\x1c", "é", "🙂", "\r\n", "　", "_"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["ab" * 500, "a" * 3000, "thetion" * 300, "", " ", "x y" * 100]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_every_code_point():
    lib, own = library(), ByteBpe(PATH)
    texts = ["a" + "".join(f"{chr(i)} {chr(i)}1" for i in range(n, n + 64) if not 0xD800 <= i <= 0xDFFF) for n in range(0, 0x110000, 64)]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == e.ids


def test_long_and_short_merges_agree():
    own, rng = ByteBpe(PATH), random.Random(9)
    for _ in range(500):
        raw = "".join(rng.choice("thearion é") for _ in range(rng.randrange(1, 80))).encode()
        assert own.merge_short(raw) == own.merge_long(raw)


def test_very_long_text_in_segments():
    text = "The end of it. " * 200_000 + "  \n\n x"
    assert "".join(segments(text)) == text and len(list(segments(text))) > 1
    own = ByteBpe(PATH)
    whole = b"".join(map(own.__getitem__, own.words.findall(text)))
    assert own.encode(text) == whole


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello you", "a"), (2, None, "b"), (3, "", "b"), (1, "Hello you", "a"), (None, "é", "c")], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in token_digests(df, PATH).collect()}
    ids = library().encode("Hello you", add_special_tokens=False).ids
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"Hello you").hexdigest()
    assert got[2].n_tokens == got[3].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].decoded_sha256 == hashlib.sha256("é".encode()).hexdigest()
    assert token_digests(df.limit(0), PATH).collect() == []


def test_each_text_is_encoded_once(spark):
    df = spark.createDataFrame([(1, "Hello you"), (2, None), (3, "é 中 <|endoftext|>")], "doc_id long, text string")
    plan = token_digests(df, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"pythonUDF\d+", plan))) == 1  # one call a row; a decode chained to an encode was a second one, with an encode of its own
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(encode_decode(df.na.fill(""), PATH)) == rows(decode(encode(df.na.fill(""), PATH), PATH))
