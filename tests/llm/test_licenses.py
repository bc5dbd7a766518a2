import math
import os
import random
import re
from collections import Counter

import pytest

from newsloom.llm.license_texts import TEXTS
from newsloom.llm.licenses import FILE_THRESHOLD, HEADER_LINES, TEMPLATES, TEXT_THRESHOLD, THRESHOLD, scan_licenses

PROSE = "some words of prose that go on and on"


def test_headers_files_and_inheritance(spark):
    rows = [
        (1, "a/x.py", f"{PROSE}\nReleased under the MIT License.\n{PROSE}", "k"),
        (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", "k"),
        (3, "a/b/c/deep.txt", PROSE, "k"),
        (4, "a/b/own.txt", f"This work is licensed under the GNU General Public License, version 3.\n{PROSE}\nand it is a longer text than the notice that it begins with, which has next to no weight in it", "k"),
        (5, "z/y.txt", PROSE, "k"), (6, "LICENSE", "Licensed under CC BY-NC 4.0.", "k"), (7, None, None, "k"), (8, "a/b/c/d/e.txt", "", None),
        (9, "a/other.txt", "the licence to talk is free to all of you who are there", "k"), (3, "a/b/c/deep.txt", PROSE, "k"), (None, "a/b/n.txt", PROSE, "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, score string")
    got = scan_licenses(df).collect()
    by = {r.doc_id: (r.license, r.via) for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("MIT", "header") and by[2] == ("Apache-2.0", "file") and by[3] == ("Apache-2.0", "inherited") and by[4] == ("GPL-3.0", "header")
    assert by[5] == by[7] == by[9] == ("CC-BY-NC-4.0", "inherited") and by[6] == ("CC-BY-NC-4.0", "file") and by[8] == by[None] == ("Apache-2.0", "inherited")
    assert scan_licenses(df.limit(0)).collect() == []
    assert {(r.license, r.via, r.score) for r in scan_licenses(df.where("doc_id = 5")).collect()} == {(None, "none", 0.0)}


def brute(rows, templates=TEMPLATES, texts=TEXTS):
    """Plain TF-IDF cosines of all runs of lines and of whole texts, and a walk up the directories. Document frequencies of all terms over all rows."""
    terms = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    df = Counter(w for _, _, t, _ in rows for w in terms(t or ""))
    idf = lambda w: math.log((len(rows) + 1) / ((df[w] or 1) + 1)) + 1
    vec = lambda t: {w: n * idf(w) for w, n in terms(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    short, long = ([(name, vec(t)) for name, t in x] for x in (templates, texts))

    def best(v, made, least):
        found = [(-round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6), name) for name, t in made] if v else []
        return min((f for f in found if -f[0] >= least), default=None)

    own, folder = [], {}
    for _, path, text, _ in rows:
        text, up = text or "", "/".join((path or "").lstrip("/").split("/")[:-1])
        lines = re.split("\r\n|\n|\r", text)
        runs = {" ".join(lines[i : i + k]) for i in range(len(lines)) for k in range(1, HEADER_LINES + 1) if i + k <= len(lines)}
        whole = min((b for b in (best(vec(text), short, FILE_THRESHOLD), best(vec(text), long, TEXT_THRESHOLD)) if b), default=None)
        head = min((b for b in (best(vec(r), short, THRESHOLD) for r in runs) if b), default=None)
        own.append((whole, head, up))
        if whole:
            folder[up] = min(folder.get(up, whole), whole)
    out = []
    for (i, *_), (whole, head, up) in zip(rows, own, strict=True):
        parts = up.split("/") if up else []
        near = next((folder[d] for k in range(len(parts), -1, -1) if (d := "/".join(parts[:k])) in folder), None)
        got = whole or head or near
        out.append((i, got[1] if got else None, "file" if whole else "header" if head else "inherited" if near else "none", -got[0] if got else 0.0))
    return out


def same(got, want):
    rows = lambda x: sorted(((i, name, via) for i, name, via, _ in x), key=str)
    got = [(r.doc_id, r.license, r.via, r.score) for r in got]
    assert rows(got) == rows(want)
    scores = lambda x: [s for *_, s in sorted(x, key=lambda r: (str(r[:3]), r[3]))]
    assert all(abs(a - b) < 2e-6 for a, b in zip(scores(got), scores(want), strict=True))


def test_filter_changes_no_result(spark):
    rng = random.Random(3)
    rows = [(i, f"d{i}/x.txt", "All rights reserved.\n" + PROSE, "k") for i in range(5)]
    vocab = sorted({w for _, t in TEMPLATES for w in t.split()})
    for i in range(5, 200):  # parts of notices, with other words between
        part = [w for w in rng.choice(TEMPLATES)[1].split() if rng.random() < rng.choice((0.4, 0.7, 0.9))] + rng.sample(vocab, rng.randrange(3))
        rows.append((i, f"d{i}/x.txt", " ".join(part) + "\n" + " ".join(rng.choices(PROSE.split() + ["the", "under", "is", "all"], k=9)), "k"))
    want = brute(rows)
    same(scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, score string")).collect(), want)
    assert all(name == "Proprietary" for i, name, *_ in want if i < 5) and 50 < sum(name is not None for _, name, *_ in want) < 200


def wrapped(rng, text, mark):
    """A notice over several comment lines."""
    w, out = text.split(), []
    while w:
        n = rng.randrange(5, 14)
        out.append(f"{mark} {' '.join(w[:n])}")
        w = w[n:]
    return "\n".join(out)


def test_same_as_plain_cosines_and_a_walk_up(spark):
    rng = random.Random(11)
    stock = [f"w{i}" for i in range(400)] + PROSE.split() + "the of and to a in is it that for software work code license use".split()
    prose = lambda n: " ".join(rng.choices(stock, k=n))
    rows = []
    for i in range(200):
        path = "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/f{i}"
        kind = i % 8
        if kind == 0:  # a licence of 2,000 words and more: its template, said again and again with a few other words
            name, text = rng.choice(TEXTS)
            text = "\n".join([text] * (2000 // len(text.split()) + 1) + [prose(rng.randrange(150))])
        elif kind == 1:
            text = rng.choice(TEXTS)[1] + " " + prose(rng.randrange(60))
        elif kind == 2:
            text = wrapped(rng, rng.choice(TEMPLATES)[1], rng.choice(["#", "//", " *", ""])) + "\n\n" + prose(200)
        elif kind == 3:
            text = rng.choice(TEMPLATES)[1]
        elif kind == 4:  # a tie: the same notice under two names is in the templates below
            text = "Do as you like with it.\r\n" + prose(20)
        else:
            text = "\n".join(prose(rng.randrange(40)) for _ in range(rng.randrange(6)))
        rows.append((i, path, text, "k"))
    rows += [(500, None, None, "k"), (501, "a/b", "", "k"), (3, rows[3][1], rows[3][2], "k"), (3, "c/other", "Released under the MIT License.", "k"), (None, "a/c/x", prose(30), "k"), (600, "b/long", prose(200_000), "k"), (601, "q/x", prose(9), "k")]
    templates = (*TEMPLATES, ("Zeta", "Do as you like with it"), ("Alpha", "do as you like, with it!"))
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, license string")
    want = brute(rows, templates)
    same(scan_licenses(df, templates).collect(), want)
    assert {via for *_, via, _ in want} == {"file", "header", "inherited", "none"}
    assert all(via == "file" for i, _, via, _ in want if i is not None and i < 200 and i % 8 == 0) and any(name == "Alpha" for _, name, *_ in want)
    assert sum(via == "header" for i, _, via, _ in want if i is not None and i < 200 and i % 8 == 2) >= 20  # wrapped headers too


SYSTEM = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL": "GFDL-1.3", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL": "GPL-3.0", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL": "LGPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


def test_every_licence_of_the_system(spark):
    """All licence files as they are installed, where the machine has them, whole, with a head of another project's name and with words changed; their relatives are never named."""
    folder = "/usr/share/common-licenses/"
    if not all(os.path.exists(folder + f) for f in SYSTEM):
        pytest.skip("no licence files here")
    rng, rows, want = random.Random(4), [], {}
    for i, (f, name) in enumerate(SYSTEM.items()):
        text = open(folder + f, encoding="utf-8").read()
        words = text.split()
        for _ in range(len(words) // 40):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        for k, t in enumerate((text, f"The Project of {PROSE}\n\n" + text + "\n\nCopyright 2020 by all of us.", " ".join(words))):
            rows.append((10 * i + k, f"p{i}-{k}/LICENSE", t, "k"))
            want[10 * i + k] = (name, "file")
        rows.append((10 * i + 5, f"p{i}-0/src/x.py", PROSE, "k"))
        want[10 * i + 5] = (name, "inherited")
    got = {r.doc_id: (r.license, r.via) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, license string")).collect()}
    assert {i: x for i, x in got.items() if x != want[i]} == {}


def test_opening_of_a_licence_is_no_licence_file(spark):
    """The opening of a licence's text isn't the licence, and relatives without a template of their own are not named after what they quote."""
    text = dict(TEXTS)["GPL-2.0"].split()
    own = " ".join(f"clause{i} of the terms that bind you and us" for i in range(400))
    rows = [(1, "a/LICENSE", " ".join(text[: len(text) // 8]), "k"), (2, "b/LICENSE", own + " you may also use the GNU General Public License version 2", "k")]
    got = {r.doc_id: (r.license, r.via) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string, license string")).collect()}
    assert all(via != "file" for _, via in got.values())
