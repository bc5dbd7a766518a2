import random

import numpy as np
import pytest

from newsloom.llm.substring_dedup import Block, LineSets, remove_repeats, repeated_passages

SCHEMA = "doc_id long, text string, start string"


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(100000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    inner, line, near = words(rng, 60), " ".join(words(rng, 80)), words(rng, 120)
    rows = []
    for i in range(12):  # a passage set inside longer lines
        rows.append((i, " ".join(words(rng, rng.randrange(5, 90)) + inner + words(rng, rng.randrange(5, 90))), "k"))
    for i in range(20, 26):  # a whole line
        rows.append((i, "\n".join([" ".join(words(rng, 70)), line, "é " + " ".join(words(rng, 60))]), "k"))
    for i in range(30, 33):  # a line with a few words changed: near copies
        w = list(near)
        w[20 + 40 * (i - 30)] = f"z{i}"
        rows.append((i, " ".join(w), "k"))
    for i in range(40, 60):  # clean: short shared lines only
        rows.append((i, "a short line that is common\n" + " ".join(words(rng, 200)), "k"))
    rows.append((70, "\n".join([line, " ".join(words(rng, 55)), line]), "k"))
    twice = " ".join(words(rng, 70))
    rows.append((80, twice + "\n" + twice, "k"))
    rows += [(90, None, None), (91, "", "k"), (None, line, "k")]
    return rows, line, " ".join(inner)


def test_finds_planted_and_leaves_clean(spark, planted):
    rows, line, inner = planted
    text = {i: t for i, t, _ in rows}
    got = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {*range(12), *range(20, 26), *range(30, 33), 70}
    assert {text[r.doc_id][r.start : r.end] for r in got if r.doc_id in range(20, 26) or r.doc_id == 70} == {line}
    for r in got:
        if r.doc_id < 12:
            assert text[r.doc_id][r.start : r.end] in inner and r.end - r.start > len(inner) / 2
    for ids in (range(12), range(20, 26), range(30, 33)):
        assert len({r.group_id for r in got if r.doc_id in ids}) == 1
        assert [r.doc_id for r in got if r.doc_id in ids and not r.removed] == [ids[0]]


def test_every_place_of_an_inner_passage(spark):
    rng = random.Random(8)
    rows = []
    for p in range(60):  # 51 shared words are always enough
        shared = words(rng, 51)
        rows += [(2 * p + k, " ".join(words(rng, rng.randrange(1, 60)) + shared + words(rng, rng.randrange(1, 60))), "k") for k in (0, 1)]
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == set(range(120))


def test_cuts_and_empty(spark, planted):
    rows, line, _ = planted
    df = spark.createDataFrame([r for r in rows if r[0] in (20, 21, 70, 90, 91)], SCHEMA)
    out = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert line in out[20] and line not in out[21] and line not in out[70] and out[90] is None and out[91] == ""
    assert repeated_passages(df.limit(0)).collect() == []


def test_short_passage_earlier_two_longer_copies_later(spark):
    rng = random.Random(6)
    passage, before, after = (" ".join(words(rng, n)) for n in (150, 140, 130))
    line = " ".join(words(rng, 90))
    rows = [(1, passage, "k"), (5, f"{before} {passage} {after}", "k"), (6, f"{before} {passage} {after}", "k")]  # inside one line
    rows += [(11, passage[::-1], "k"), (15, f"{line}\n{passage[::-1]}\n{after[::-1]}", "k"), (16, f"{line}\n{passage[::-1]}\n{after[::-1]}", "k")]  # as lines
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert out[1] == passage and out[11] == passage[::-1]
    assert before in out[5] and after in out[5] and len(out[5].split()) < 140 + 130 + 60
    assert out[15].split() == (line + " " + after[::-1]).split()
    assert len(out[6].split()) < 60 and not out[16].split()
    spans = sorted((r.doc_id, r.start, r.end) for r in repeated_passages(df).collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))


def test_no_word_is_lost(spark):
    rng = random.Random(12)
    stock = [" ".join(words(rng, rng.randrange(52, 110))) for _ in range(12)]
    rows = [(i, " ".join(rng.sample(stock, rng.randrange(1, 6))), "k") for i in range(60)]
    kept = {w for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect() for w in r.text.split()}
    assert {w for _, t, _ in rows for w in t.split()} == kept


def exact(a, b):
    """Jaccard similarity of two lines' 5-word shingles."""
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_lines_against_all_pairs(spark):
    rng = random.Random(21)
    rows = []
    for i in range(200):  # pairs of lines with words changed here and there, on both sides of the threshold
        base = words(rng, rng.randrange(60, 300))
        other = list(base)
        for _ in range(rng.randrange(1, 2 + len(base) // 30)):
            other[rng.randrange(len(base))] = f"z{i}_{rng.random()}"
        rows += [(2 * i, " ".join(base), "k"), (2 * i + 1, " ".join(other), "k")]
    pairs = [(rows[2 * i][1], rows[2 * i + 1][1]) for i in range(200)]
    linked = {i for i, (x, y) in enumerate(pairs) if 100 * exact(x, y) >= 80}
    assert 40 < len(linked) < 160
    # the recall of the bands alone
    with np.errstate(over="ignore"):
        block = Block([t.encode() for _, t, _ in rows])
        keys = LineSets(block.run, block.lines()).band_keys()
    assert len(keys) == len(rows)
    met = {i for i in linked if (keys[2 * i] == keys[2 * i + 1]).any()}
    assert len(met) >= 0.99 * len(linked)
    # what is found: all pairs that link, and else only those that share a unit's words
    group = {r.doc_id: r.group_id for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {i for i in range(200) if 2 * i in group and 2 * i + 1 in group}
    grams = lambda t: {tuple(t.split()[k : k + 41]) for k in range(len(t.split()) - 40)}
    assert len(found & linked) >= 0.99 * len(linked) and all(grams(pairs[i][0]) & grams(pairs[i][1]) for i in found - linked)


def test_fifty_words_are_left_alone(spark):
    rng = random.Random(31)
    rows = []
    for p, n in enumerate([41, 44, 47, 49, 50, 51, 52, 56, 60] * 4):
        shared = words(rng, n)
        rows += [(2 * p + k, " ".join(words(rng, 70) + shared + words(rng, 70)), "k") for k in (0, 1)]
    got = {}
    for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text, _ in rows:
        n = [41, 44, 47, 49, 50, 51, 52, 56, 60][i // 2 % 9]
        assert (i in got) == (n > 50), (i, n)
        if n in (51, 52):  # found by windows, to the last word
            assert text[got[i][0].start : got[i][0].end].split() == text.split()[70 : 70 + n]


def test_repeated_rows_and_ties(spark):
    rng = random.Random(41)
    text = " ".join(words(rng, 90))
    rows = [(1, text, "k"), (1, text, "k"), (2, text, "k"), (3, text + "\n" + text, "k"), (4, " ".join(words(rng, 90)), "k"), (4, " ".join(words(rng, 90)), "k")]
    got = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and {r.doc_id for r in got if not r.removed} == {1} and len({r.group_id for r in got}) == 1
    assert all(r.n_copies == len(got) for r in got)


def test_hot_bands_are_split(spark, monkeypatch):
    """Lines of one form that share bands with many and reach the threshold with a few: splitting loses no link of those that the bands bring together."""
    from newsloom.llm import jaccard_join

    rng = random.Random(21)
    form = [f"f{k}" for k in range(70)]
    rows = []
    for i in range(160):
        at = set(rng.sample(range(70), rng.choice((1, 2, 4, 6, 9))))
        rows.append((i, " ".join(f"x{rng.randrange(4)}" if k in at else w for k, w in enumerate(form))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for hot in (10**9, 3):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        found.append(sorted((r.doc_id, r.start, r.end, r.removed) for r in repeated_passages(df).collect()))
    assert found[0] == found[1] and len(found[0]) > 20
