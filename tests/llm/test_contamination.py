import random
import re

from newsloom.llm import contamination
from newsloom.llm.contamination import contained_items, decontaminate, least_hits


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_same_as_exact_containment(spark):
    rng = random.Random(2)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([3, 4, 5, 6, 8, 12, 20, 30, 45, 60, 90, 300, 700])] + [(50, None), (51, "?!"), (None, "a b c d e f")]
    docs = []
    for i, (_, text) in enumerate(items[:13]):
        for j, drop in enumerate((0, 0, 0.01, 0.03, 0.05, 0.5)):
            w = [x for x in text.split() if rng.random() >= drop]
            if j == 1:
                w = [x.upper() + "," for x in w]
            docs.append((i * 10 + j, " ".join(make(rng.randrange(400)) + w + make(rng.randrange(400))), "k"))
    docs += [(900, None, "k"), (901, "", "k"), (902, items[0][1], "k"), (None, items[6][1], "k"), (docs[0][0], docs[0][1], "k")]
    want = {(d, i) for d, t, _ in docs for i, q in items if d is not None and i is not None and grams(q) and len(grams(q) & grams(t)) >= 0.8 * len(grams(q))}
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string, h string"), spark.createDataFrame(items, "item_id long, text string")
    got = contained_items(ddf, idf)
    rows = got.collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    kept = decontaminate(ddf, idf)
    assert kept.columns == ddf.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, *_ in docs if d not in {x for x, _ in want}), key=str)
    assert contained_items(ddf.limit(0), idf).count() == contained_items(ddf, idf.limit(0)).count() == 0


def test_hits_needed():
    assert least_hits(24) >= 1 and least_hits(48) > least_hits(24)


def test_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = "filler and " * 150_000
    docs = spark.createDataFrame([(1, long + item + " " + long, "k"), (2, long, "k"), (3, "x" * 2_000_000, "k")], "doc_id long, text string, h string")
    items = spark.createDataFrame([(7, item), (8, "filler and filler and filler")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.containment) for r in contained_items(docs, items).collect()) == [(1, 7, 1.0), (1, 8, 1.0), (2, 8, 1.0)]


def test_large_item_sets_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 10)
    items = [(i, " ".join(f"w{i}_{k}" for k in range(20))) for i in range(12)]
    docs = [(i, "before it " + items[i][1] + " and after", "k") for i in range(8)]
    ddf, idf = spark.createDataFrame(docs, "doc_id long, text string, h string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contained_items(ddf, idf).collect()} == {(i, i) for i in range(8)}
