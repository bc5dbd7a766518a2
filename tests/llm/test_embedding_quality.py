"""Random-indexing word vectors against plain counting; the network's gradient, calibration and held-out accuracy."""

import random
import re
import zlib

import numpy as np

from newsloom.llm import embedding_quality as Q

HEAD = "doc_id long, text string, score string, y int"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "ing", "her", "tion", "and"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def table_of(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        t = prose(rng, rng.randrange(5, 80))
        good = i % 4 != 0
        if not good:
            t = rng.choice([lambda: " | ".join(t.split()), lambda: t.upper().replace(" ", "!! "), lambda: " ".join([t.split()[0] + "."] * 40), lambda: re.sub(r"( |$)", "%%% ", t)])()
        rows.append((i, t, "x", int(good)))
        labels.append((i, int(good), 0, "a"))
    return rows, labels


def plain_vectors(texts):
    place, sign = Q.index_vectors()
    index = np.zeros((Q.BUCKETS, Q.DIM), dtype=np.int64)
    for r in range(Q.BUCKETS):
        np.add.at(index[r], place[r], sign[r].astype(np.int64))
    row = {}
    total = np.zeros((Q.BUCKETS, Q.DIM), dtype=np.int64)
    for t in texts:
        words = WORD.findall(t)
        for w in words:
            row.setdefault(w, int(Q.word_rows([w])[0][0]))
        for i, w in enumerate(words):
            for d in range(1, Q.REACH + 1):
                if i >= d:
                    total[row[w]] += index[row[words[i - d]]]
                if i + d < len(words):
                    total[row[w]] += np.roll(index[row[words[i + d]]], 1)
    return total


def test_contexts_of_all_texts(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(30)) + rng.choice(["", " --- x1 \n", "é été!", "\t"]) for _ in range(120)] + [None, "", " ", "one", "a a a a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    total = np.zeros((Q.BUCKETS, Q.DIM), dtype=np.int64)
    for r in Q.context_sums(df).collect():
        total[r["part"] * Q.GROUP : (r["part"] + 1) * Q.GROUP] += Q.unpack(r["sums"])
    assert (total == plain_vectors([(t or "").encode() for t in texts])).all()
    assert Q.context_sums(df.limit(0)).collect() == [] and not Q.word_vectors(df.limit(0)).any()


def test_pooling_is_the_same_alone_and_in_a_block():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(Q.BUCKETS, Q.DIM)).astype(np.float32)
    py = random.Random(6)
    texts = [prose(py, py.randrange(200)).encode() for _ in range(30)] + [b"", b"  ", b"x"]
    block = Q.pooled(vectors, texts)
    for t, own in zip(texts, block, strict=True):
        assert (Q.pooled(vectors, [t])[0] == own).all()
    rows = Q.word_rows([texts[0]])[0]
    assert np.allclose(block[0, : Q.DIM], vectors[rows].mean(axis=0), atol=1e-5) and np.isclose(block[0, Q.DIM], np.log1p(len(rows))) and np.isclose(block[0, -1], len(set(rows.tolist())) / len(rows))
    long = b"the hinge and other " * (Q.BLOCK_BYTES // 6)
    pieces = list(Q.parts(long))
    assert len(pieces) > 2 and b"".join(pieces) == long and all(p[-1:] == b" " for p in pieces[:-1])
    assert np.allclose(Q.pooled(vectors, [long])[0, : Q.DIM], vectors[Q.word_rows([b"the hinge and other"])[0]].mean(axis=0), atol=1e-4)


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, Q.WIDTH))
    x[:, 4:] = 0
    y = ((x[:, 0] * x[:, 1]) > 0).astype(np.int64)
    net = Q.fit(x[:1200], y[:1200], np.ones(1200))
    assert ((net.probability(x[1200:]) > 0.5) == y[1200:]).mean() > 0.9
    same = Q.fit(x[:1200], y[:1200], np.ones(1200))
    assert (same.w1 == net.w1).all()


def test_temperature_is_the_best_of_its_grid_and_calibrates():
    rng = np.random.default_rng(9)
    z = rng.normal(0, 2, 20000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-z))).astype(float)
    for factor in (0.3, 1.0, 4.0):
        assert abs(Q.temperature(z * factor, y, np.ones(len(z))) / factor - 1) < 0.1
    assert Q.temperature(np.zeros(0), np.zeros(0), np.zeros(0)) == 1.0


def test_held_out_accuracy(spark):
    rows, labels = table_of(random.Random(10))
    rows += [(9000, None, "x", -1), (9001, "", "x", -1), (None, prose(random.Random(1), 30), "x", -1), (9002, " \n", "x", -1), (3, rows[3][1], "x", 1)]
    wrong = [(i, 1 - y, 0, "a") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, y, 0, "a") for i, y, _, _ in labels] + [(None, 1, 0, "a"), (9000, None, 0, "a"), (77777, 1, 1, "a")]
    df = spark.createDataFrame(rows, HEAD)
    ldf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    out = Q.score_report(df, ldf).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 9000]
    assert len(held) > 100 and sum(r.predicted == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[9000] == by[9001] == by[9002]
    # Labels of held-out rows change nothing.
    other = Q.score_report(df, spark.createDataFrame(wrong, "doc_id long, quality int, toxic int, text string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, other), key=repr)


def test_empty_tables(spark):
    rows, labels = table_of(random.Random(11), 8)
    df, ldf = spark.createDataFrame(rows, HEAD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    assert Q.score_report(df.limit(0), ldf).collect() == []
    assert [r.predicted for r in Q.score_report(df, ldf.limit(0)).collect()] == [1] * 8
    assert [r.predicted for r in Q.score_report(df, ldf.where("quality = 0")).collect()] == [0] * 8
