import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from newsloom.llm import jaccard_join
from newsloom.llm.jaccard_join import band, bands_of, jaccard_components, max_diff

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])


def brute(rows, k=4, num=85, den=100):
    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {(i, len(s), find(i)) for i, s in sets}


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        act = rng.randrange(3)
        if act == 0:
            words[at] = f"x{rng.random()}"
        elif act == 1:
            words.insert(at, f"y{rng.random()}")
        else:
            del words[at]
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for size in [3, 4, 5, 8, 9, 10, 12, 15, 20, 24, 30, 45, 60, 100, 250, 700]:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 5, 8, size // 25, size // 20):
            i += 1
            rows.append((i, " ".join(near(rng, base, edits) if size > edits * 2 else base), "k"))
    rng.shuffle(rows)
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_nulls_blanks_short_and_case(spark):
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "One two", "a"), (5, "oNE\ttwo ", "a"), (6, "É a b c d", "a"), (7, "é a b c d", "a"), (8, "one two", "a")]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f", "x"), (5, "a b c d e f", "x"), (5, "a b c d e f", "x"), (9, "A b c d e f", "x")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert [r[:2] for r in got] == [(5, 3), (5, 3), (9, 3), (None, 3)]
    assert {r[2] for r in got if r[0]} == {5}


def test_bands_hold_every_pair_in_reach():
    for a in range(6, 400):
        for b in range(a, a * 100 // 85 + 1):
            k = next(k for k in range(99) if band(k)[0] <= a <= band(k)[1])
            diff = dict(bands_of(b, 85, 100)).get(k)
            assert dict(bands_of(a, 85, 100)).get(k) == diff
            assert (diff or 0) >= max_diff(a + b)


def test_chain_and_star_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(near(rng, base, 1)), "k") for i in range(80)]
    words = [f"v{i}" for i in range(150)]
    for i in range(30):  # each is near the one before only
        words = words[4:] + [f"n{i}_{j}" for j in range(4)]
        rows.append((500 - i, " ".join(words), "k"))
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_repeated_ids_with_other_texts(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    changed = lambda w, i: " ".join([*w[:i], "zz", *w[i + 1 :]])
    rows = [(1, " ".join(a), "k"), (1, " ".join(b), "k"), (2, changed(a, 39), "k"), (3, changed(b, 0), "k"), (7, " ".join(c), "k"), (7, "one two", "k"), (9, "one two", "k"), (8, None, "k"), (8, "", "k")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert set(got) == brute(rows) and len(got) == len(rows) and {r[2] for r in got if r[0] in (1, 2, 3)} == {1}


def test_very_long_texts(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(40_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(base), "k"), (2, " ".join(near(rng, base, 900)), "k"), (3, " ".join(near(rng, base, 9000)), "k"), (4, "again and " * 200_000, "k"), (5, "again and " * 100_000, "k")]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and {(r[0], r[2]) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    rng = random.Random(12)
    rows, i = [], 0
    for size in (7, 9, 14, 20, 45):  # forms that share half of their words and link with a few of them only
        form = [f"f{k}" for k in range(size)]
        for _ in range(45):
            i += 1
            at = rng.sample(range(size), rng.choice((0, 1, 2, size // 4)))
            rows.append((i, " ".join(f"x{rng.randrange(3)}" if k in at else w for k, w in enumerate(form)), "k"))
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_blank_row_beside_a_filled_one(spark):
    rows = [(5, "", "k"), (5, "a b c d e f", "k"), (1, "a b c d e f", "k")]
    assert sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, 3, 1), (5, 0, 5), (5, 3, 1)]


@pytest.mark.parametrize("n", [5, 6, 9, 12, 20, 45, 120])
def test_no_key_is_hot_by_chance(n):
    """Unrelated sets share no key that many of them have, and hardly two of them the same two keys."""
    rng = np.random.default_rng(n)
    count, pairs, total = Counter(), Counter(), 20_000 if n < 40 else 4000
    with np.errstate(over="ignore"):
        for _ in range(total):
            keys = np.sort(jaccard_join.parity_keys(np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))))
            count.update(keys.tolist())
            if len(keys) < 40:
                pairs.update((a, b) for i, a in enumerate(keys.tolist()) for b in keys.tolist()[i + 1 :])
    assert max(count.values(), default=0) <= total * 0.002
    assert sum(k * (k - 1) // 2 for k in count.values()) <= 2 * total and max(pairs.values(), default=0) <= 3


def test_sets_that_link_share_a_part_and_a_block():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for _ in range(3000):
            num, den, size = (80, 100, int(rng.integers(20, 300))) if rng.random() < 0.5 else (85, 100, int(rng.integers(6, 300)))
            both = rng.integers(0, 1 << 62, size).astype(np.uint64)
            lost = int(rng.integers(0, size // 8 + 1))
            a, b = np.unique(both), np.unique(np.r_[both[lost:], rng.integers(1 << 62, 1 << 63, int(rng.integers(0, size // 8 + 1))).astype(np.uint64)])
            same = len(np.intersect1d(a, b))
            if a.tolist() == b.tolist() or den * same < num * (len(a) + len(b) - same):
                continue
            assert len(np.intersect1d(jaccard_join.parity_keys(a, num, den), jaccard_join.parity_keys(b, num, den))) >= 2
            blocks = [jaccard_join.sketch_blocks(len(x), jaccard_join.bit_sketch(x).view(np.int64), num, den) for x in (a, b)]
            assert len(np.intersect1d(*blocks)) >= 1
