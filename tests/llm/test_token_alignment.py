"""Alignment and corpus-wide counts against the two libraries and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from newsloom.llm import token_alignment as T
from newsloom.llm.bpe import byte_letters
from newsloom.llm.queries import BYTE_BPE, PIECE_BPE

HEAD = "doc_id long, text string, block int, place string"
POOL = ["a", "the ", "Hello", "  ", " ", "\n", "\t", "▁", "é", "ﬁ", "½", "日本", "🙂", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "\x00", "\x1c", "\x85", "\xa0", "　", "'s", "don't", "12",
        "345", "...", "!?", "   x", "x\n y", "\r\n", "-", "_", "Zz", "​", "é"]


@pytest.fixture(scope="module")
def plain():
    tokens = Tokenizer.from_file(BYTE_BPE)
    tokens.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    byte = {c: b for b, c in byte_letters().items()}
    name = {i: t for t, i in tokens.get_vocab().items()}

    def one(text):
        """(numbers, groups, links) of one text."""
        if not text:
            return (0, 0, 0, 0), "", []
        whole = (" " + text).encode()
        a, b = tokens.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        ends = []
        for raws in ([bytes(byte[c] for c in name[i]) for i in a], [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]):
            if b"".join(raws) != whole:
                return (0, 0, 0, 0), "", []
            ends.append(np.cumsum([len(r) for r in raws]).tolist())
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        return (len(a), len(b), len(groups), len(links)), ";".join(groups), links

    return one


def random_texts(rng, n):
    return ["".join(rng.choice(POOL) for _ in range(rng.randrange(14))) for _ in range(n)]


def report_of(plain, rows):
    found = [plain(t) for _, t in rows]
    count = Counter(p for _, _, links in found for p in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest() if t else ""
    return [(i, *n, sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha(g)) for (i, _), (n, g, links) in zip(rows, found, strict=True)], count, most


def test_groups_of_random_texts(plain):
    texts = [*random_texts(random.Random(1), 3000), None, "", " ", "  ", "x" * 300, "word " * 2000]
    own = T.UnitAligner(BYTE_BPE, PIECE_BPE)
    assert own.b.by_unit
    for by_unit in (True, False):
        own.b.by_unit = by_unit
        own.forget()
        for s in range(0, len(texts), 400):
            part = texts[s : s + 400]
            total, groups, links, whose = own.align(part)
            for i, t in enumerate(part):
                numbers, text, pairs = plain(t)
                assert (*total[i].tolist(), groups[i].decode()) == (*numbers[:3], text), t
                assert [(k & (1 << T.A_BITS) - 1, k >> T.A_BITS) for k in links[whose == i].tolist()] == pairs


def test_report(spark, plain, monkeypatch):
    rng = random.Random(2)
    texts = random_texts(rng, 300) + ["the cat sat on the mat. " * rng.randrange(1, 30) for _ in range(60)]
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, " "), (None, "no id"), (None, "no id"), (3, texts[3]), (3, "another text"), (1003, "the ▁ mark"), (1004, "a " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], HEAD).repartition(3)
    expected, count, most = report_of(plain, rows)
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    out = T.alignment_report(df, BYTE_BPE, PIECE_BPE).collect()
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in out), key=repr) == sorted(expected, key=repr)
    assert sum(r.n_links > 0 for r in out) > 250 and any(r.n_best not in (0, r.n_links) for r in out)
    pairs = {(r.a, r.b): (r.links, r.best) for r in T.pair_counts(df, BYTE_BPE, PIECE_BPE).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in count.items()}
    shown = T.align(df, BYTE_BPE, PIECE_BPE, out_col="p").where("text = 'the cat sat on the mat. '").limit(1).collect()
    assert all(r.p.groups == plain(r.text)[1] and r.block == 1 for r in shown)
    empty = spark.createDataFrame([], HEAD)
    assert T.alignment_report(empty, BYTE_BPE, PIECE_BPE).collect() == [] and T.pair_counts(empty, BYTE_BPE, PIECE_BPE).collect() == []


def test_many_small_runs_and_levels(spark, plain, monkeypatch):
    """Merges in levels, over more runs than one merge takes."""
    monkeypatch.setattr(T, "FAN_IN", 2)
    monkeypatch.setattr(T, "SALT_RUNS", 3)
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(random_texts(rng, 120))]
    expected, _, _ = report_of(plain, rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], HEAD).repartition(9)
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    out = T.alignment_report(df, BYTE_BPE, PIECE_BPE).collect()
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in out) == sorted(expected)


def test_heap_merge_counts_like_a_counter():
    rng = np.random.default_rng(4)
    for last in (False, True):
        runs, total = [], Counter()
        for _ in range(20):
            keys = np.unique(rng.integers(0, 40, 30) << T.A_BITS | rng.integers(0, 400, 30))
            n = rng.integers(1, 5, len(keys))
            runs.append(T.pack(keys, n))
            total.update(dict(zip(keys.tolist(), n.tolist())))
        keys, counts, best = T.load(T.merge(runs, last))
        assert dict(zip(keys.tolist(), counts.tolist())) == total and (np.diff(keys) > 0).all()
        if last:
            most = {}
            for k, n in total.items():
                most[k >> T.A_BITS] = max(most.get(k >> T.A_BITS, 0), n)
            assert [bool(x) for x in best] == [total[k] == most[k >> T.A_BITS] for k in keys.tolist()]
    assert T.merge([]) == b"" and len(T.load(b"")[0]) == 0
    big = np.arange(3 * T.FRAME + 5)
    assert (T.load(T.merge([T.pack(big, big + 1), T.pack(big, big)], True))[1] == 2 * big + 1).all()


def test_spills_of_a_task_are_merged():
    own = T.UnitAligner(BYTE_BPE, PIECE_BPE)
    spill = T.Spill()
    spill.add([1, 2], *own.align(["one two two", None]))
    spill.add([3], *own.align(["two"]))
    found = {}
    for radix, n_docs, pairs, docs in spill.runs():
        keys, counts, _ = T.load(pairs)
        sizes, places, times = T.load_docs(docs)
        assert n_docs == 3 and ((keys >> T.A_BITS) % T.RADIX == radix).all() and sizes.sum() == len(places)
        for k, c, end, size in zip(keys.tolist(), counts.tolist(), np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
            found[k] = (c, list(zip(places[end - size : end].tolist(), times[end - size : end].tolist(), strict=True)))
    assert sorted(found.values()) == [(1, [(0, 1)]), (3, [(0, 2), (2, 1)])]
