"""Periodic runs against a plain search over all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np

from newsloom.llm import periodic_runs as P

HEAD = "doc_id long, text string, runs int, collapsed string"


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q):
                own = w[i : i + size]
                if not any(own[d:] == own[: size - d] for d in range(1, q)):
                    out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines, rest = "".join(f"{s},{size},{q}\n" for s, size, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(rest))


def test_all_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(70))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + rng.randrange((len(w) - a) // 3 + 1)
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        first = np.r_[0, np.cumsum([len(w) for w in texts])].astype(np.int64)
        found = P.find_runs(np.array([x for w in texts for x in w], dtype=np.int64), first)
        for i, w in enumerate(texts):
            assert sorted(map(tuple, found[found[:, 0] == i, 1:].tolist()), key=lambda r: (r[0], r[2])) == plain_runs(w), w


def test_long_runs():
    for period, size in ((1, 300_000), (3333, 200_000), (50_000, 200_000), (50_001, 200_000)):
        found = P.find_runs(np.arange(size) % period, np.array([0, size]))
        assert found.tolist() == ([[0, 0, size, period]] if size >= 4 * period else [])


def test_report(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "ab"]) for _ in range(rng.randrange(60))), 1, "x") for i in range(300)]
    rows += [(400, None, 1, "x"), (401, "", 1, "x"), (402, " \n\t", 1, "x"), (None, "a b " * 9, 1, "x"), (403, "w " * 5, 1, "x"), (404, "w\x0bw\x0cw\rw\nw\tw", 1, "x"), (404, "w w w w w w", 1, "x")]
    rows += [(405, "a\x1cb\x85 a\x1cb\x85 " * 6, 1, "x"), (1, rows[1][1], 1, "x"), (406, "the quick fox " * 4 + "the quick dog " * 5, 1, "x")]
    out = P.run_report(spark.createDataFrame(rows, HEAD)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted((plain_row(i, t) for i, t, _, _ in rows), key=repr)
    assert sum(r.n_runs > 0 for r in out if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) > 3
    assert P.run_report(spark.createDataFrame([], HEAD)).collect() == []


def test_operator_keeps_rows_and_texts(spark):
    df = spark.createDataFrame([(7, "say it say it say it say it now", 3, "own"), (8, None, 1, None)], HEAD)
    out = {r.doc_id: r for r in P.periodic_runs(df, out_col="p").collect()}
    assert out[7].p.collapsed == "say it now" and [tuple(r) for r in out[7].p.runs] == [(0, 8, 2)] and out[7].collapsed == "own" and out[7].runs == 3
    assert out[8].p.collapsed == "" and out[8].p.runs == []
