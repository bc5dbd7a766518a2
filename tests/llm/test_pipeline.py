"""Each stage of the pipeline against plain Python on what the stage before it kept."""

import hashlib
import os

import numpy as np
import public_tokenizers

import corpus_pipeline
from newsloom.llm.pii import find_spans, redact_text
from tests.llm.test_contamination import grams
from tests.llm.test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert n == 4 or docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    raw = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    language, near, clean, private, encoded = kept
    gone = [t for i, t in raw.items() if i not in language]
    assert len(gone) <= 0.02 * len(raw) and all(len((t or "").split()) < 30 for t in gone)  # only what can't be told
    assert set(near) == {i for i, _, c in brute([(i, r.text) for i, r in language.items()]) if i == c}
    items = [grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i: grams(r.text) for i, r in near.items()}
    assert set(clean) == {i for i, g in held.items() if not any(q and len(q & g) >= 0.8 * len(q) for q in items)}
    assert {i: (r.text, r.n_chars) for i, r in private.items()} == {i: (t := redact_text(r.text, find_spans(r.text)), len(t)) for i, r in clean.items()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in private.items():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        assert (encoded[i].n_tokens, encoded[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert encoded[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert len(encoded) == len(private)


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_stages_of_odd_rows(spark, tmp_path):
    text = "the words of this text are the words that all of the rows that are to stay have in them, and then some more of them to be sure"
    other = "quite another text of other words than those before it, written so that nothing in it is like what is in the rest of these rows"
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " now", "en"), (3, None, "en"), (4, "", None), (None, text, "en"), (None, None, None), (5, other, "en"), (5, other + " or not", "en"), (6, "12 !?", "en")]
    df = spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, d=df: stages[name](spark, d, str(tmp_path))
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=str)
    assert all(t for _, t in key(run("language"))) and (None, text) in key(run("language"))
    assert key(run("near_duplicates")) == sorted([(1, text), (3, None), (4, ""), (None, text), (None, None), (5, other), (6, "12 !?")], key=str)
    assert key(run("contamination")) == sorted([(i, t) for i, t, _ in rows if i != 5], key=str)
    assert key(run("private_data")) == sorted([(i, t) for i, t, _ in rows], key=str)
    encoded = run("encoding").collect()
    assert len(encoded) == len(rows) and {r.n_tokens for r in encoded if r.doc_id in (3, 4)} == {0}
    for name in stages:
        out = run(name, df.limit(0))
        assert out.collect() == [] and (name == "encoding" or out.columns == df.columns)
