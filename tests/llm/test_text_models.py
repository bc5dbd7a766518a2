"""Language identification, quality rules and HTML extraction."""

import random
import re
from collections import Counter
from html import unescape

import numpy as np

from newsloom.llm import html_text, langid, quality

LETTERS = {"aa": "the and ing tion her", "bb": "und der sch ein keit", "cc": "que les ment eau oir"}


def prose(rng, lang, n):
    parts = LETTERS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_of_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(3, 80)), lang, "x") for i, lang in enumerate(rng.choice(list(LETTERS)) for _ in range(500))]
    rows += [(900, None, "aa", "x"), (901, "12 !?", "aa", "x"), (902, prose(rng, "aa", 20), None, "x"), (None, prose(rng, "bb", 20), "bb", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = langid.language_report(df).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    by = {r.doc_id: r for r in out}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[900].score == 0 and by[902].lang_pred == "aa" and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.count() >= 0.99 * 502
    assert langid.language_report(df.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.language_report(blank).collect()] == ["und"]


def test_long_text_is_summed_by_blocks():
    rng = random.Random(2)
    model = langid.fit([(prose(rng, lang, 60), lang) for lang in LETTERS for _ in range(40)])
    text = prose(rng, "bb", 120_000)
    assert len(text) > 2 * langid.BLOCK_CHARS
    logits, has = langid.text_logits(model, [text, "", prose(rng, "cc", 30)])
    assert model.langs[logits[0].argmax()] == "bb" and model.langs[logits[2].argmax()] == "cc" and list(has) == [True, False, True]


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_counts_and_verdict(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        t = prose(rng, "aa", rng.randrange(30, 90))
        if i % 3 == 0:
            t = " ".join(w + rng.choice(["###", "%%%"]) for w in t.split())
        rows.append((i, t, 1))
        if i % 2:
            labels.append((i, int(i % 3 != 0), 0))
    pool = ["a", "é", " ", "\n", "\t", "the cat", "#", "🙂", "\x0b", "x\n", "a b c d e f g h\n", " "]
    for i in range(400, 700):
        rows.append((i, "".join(rng.choice(pool) for _ in range(rng.randrange(80))), 1))
    rows += [(701, None, 1), (702, "", 1), (None, "word " * 40, 1)]
    df, ldf = spark.createDataFrame(rows, "doc_id long, text string, n_words int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.quality_report(df, ldf).collect()}
    for i, t, _ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    right = [out[i].kept == (i % 3 != 0) for i in range(0, 400, 2)]
    assert sum(right) / len(right) > 0.97
    assert quality.quality_report(df.limit(0), ldf).collect() == []
    assert quality.quality_report(df.limit(5), ldf.limit(0)).count() == 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href="/x">One</a><li><a>Two</a></ul></nav>
<!-- <p>not this</p> --><div class="ad">Buy this now and here.</div>%s<div id="comments"><p>I say so too, and more of it.</p></div><form><input>Send</form><footer>&copy; all of us</footer></body></html>"""
BODY = "<h1>A  head</h1><p><b>Bold</b>ly said &amp; done.<br><p>Second\n\n line &lt;here&gt; of it<aside>See also</aside><script>x</script> and on.</p><ul><li>point a<li>point b</ul>"
TEXT = "A head\nBoldly said & done.\nSecond line <here> of it\nand on.\npoint a\npoint b"


def test_html(spark):
    score = html_text.weights([PAGE % f"<article>{BODY}</article>"] * 3)
    assert html_text.main_text(PAGE % f"<article>{BODY}</article>", score) == TEXT
    assert html_text.main_text((PAGE % f"<article>{BODY}</article>")[: (PAGE % f"<article>{BODY}").find("on.</p>") + 3], score) == "\n".join(TEXT.split("\n")[:4])
    assert html_text.main_text(PAGE % f"<div>{BODY}</div>", score) == TEXT  # no marked article: the scan finds it
    for bad in (None, "", "<", "<p", "<!--", "<script>", "&am", "</p>", "<a href='", "<" * 50, "<nav>x"):
        html_text.main_text(bad, score)
    rows = [(1, "u", PAGE % f"<article>{BODY}</article>", "x"), (2, "u", None, "x"), (3, None, "", "x"), (1, "u", PAGE % f"<article>{BODY}</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.page_report(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, "", 0), (3, "", 0)]
    assert html_text.page_report(df.limit(0)).collect() == []


PROSE = "The council met on Tuesday to talk about the new bridge over the river and the cost of it. " * 5
CLASSES = "share-price social-policy recommended-reading comments-on-budget navigation-systems promotion-news notice-board".split()


def labelled_pages(rng):
    """Pages with a menu, an advert, an article and a footer."""
    part = lambda n: " ".join(rng.choice("on it the bridge river council met and cost talk".split()) for _ in range(n))
    for _ in range(60):
        article = f"<h1>{part(6)}</h1>" + "".join(f"<p>{part(rng.choice([1, 2, 3, 9, 40, 80]))}</p>" for _ in range(8))
        yield f"<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>{part(1)}</a></ul></nav><div class='ad'>{part(8)}</div><article>{article}</article><footer>{part(6)}</footer></body></html>"


def test_scores_decide(spark):
    trained, untrained = html_text.weights(list(labelled_pages(random.Random(1)))), html_text.scores({}, {})
    text = PROSE.strip()
    page = "<html><body>%s</body></html>"
    for c in CLASSES:  # names that only hold a word like those of menus and adverts
        for body in (PROSE, f"<p>{PROSE}</p>"):
            assert html_text.main_text(page % f"<nav><ul><li><a>Home</a></ul></nav><div class='{c}'>{body}</div><footer>All rights</footer>", trained) == text
    # no article, menu or footer elements and no telling classes
    bare = page % f"<div>Home News Sport Contact us</div><div>{PROSE}</div><div>Copyright 2024 of all of us</div>"
    assert html_text.main_text(bare, trained) == text != html_text.main_text(bare, untrained)
    cells = page % f"<table><tr><td><a href=a>One</a></td><td><a href=b>Two</a></td></tr></table><table><tr><td>{PROSE}</td></tr></table>"
    assert html_text.main_text(cells, trained) == text
    # adverts of an unknown class, comments and related links within the article; short paragraphs and lists after them
    inner = f"<h1>Head of it</h1><p>{PROSE}</p><div class='zq9'>Buy this now and here.</div><p>Short.</p><aside>See also</aside><ul><li>point a<li>point b</ul><ul><li><a>More of it</a></ul><form>Send</form>"
    comments = "<div class=comments><p>I say so too, and more of it, as long as this is.</p></div>"
    want = f"Head of it\n{text}\nShort.\npoint a\npoint b"
    for body in (f"<article>{inner}{comments}</article>", f"<div class=content>{inner}</div>{comments}", f"<main>{inner}</main>"):
        assert html_text.main_text(page % body, trained) == want
    assert "Buy" in html_text.main_text(page % f"<article>{inner}</article>", untrained)
    df = spark.createDataFrame([(1, "u", page % f"<article>{inner}{comments}</article>")] * 3 + [(2, "u", h) for h in labelled_pages(random.Random(1))], "page_id long, url string, html string")
    assert [r.text for r in html_text.page_report(df).where("page_id = 1").collect()] == [want] * 3


def test_given_pages_give_their_articles(spark):
    """All 250 pages: the text of the one article element, by plain patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.page_report(pages).collect():
        inside = re.search(r"(?s)<article>(.*?)</article>", raw[r.page_id])[1]
        lines = re.split(r"</?(?:p|h1|br)\b[^>]*>", inside)
        want = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", x))).strip() for x in lines]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_calibration_is_finite():
    rng = np.random.default_rng(4)
    cases = [
        (np.array([-5.0, -4.0, 4.0, 5.0]), [0, 0, 1, 1]),  # parted by far
        (np.array([1e6, 1e6 + 1, -1e6]), [1, 1, 0]),
        (np.array([0.1, 0.2]), [1, 0]),  # the wrong way round
        (np.array([3.0]), [1]), (np.zeros(0), []), (np.ones(50), [1] * 50), (np.ones(50), [0] * 25 + [1] * 25),
        (np.r_[rng.normal(-30, 1, 60), rng.normal(30, 1, 400)], [0] * 60 + [1] * 400),
        (np.r_[rng.normal(6.588, 1e-4, 60), rng.normal(6.592, 1e-4, 400)], [0] * 60 + [1] * 400),  # the scores that undamped steps diverge on
    ]
    for z, y in cases:
        slope, shift = quality.platt(z, np.array(y, dtype=float))
        p = quality.sigmoid(slope * z + shift)
        assert np.isfinite([slope, shift]).all() and slope > 0 and ((p > 0) & (p < 1)).all()
        # as good as a fine descent from there
        if 0 < sum(y) < len(y) and slope != 1.0:
            target = np.where(np.array(y) == 1, (sum(y) + 1) / (sum(y) + 2), 1 / (len(y) - sum(y) + 2))
            loss = lambda a, b: (np.logaddexp(0, a * z + b) - target * (a * z + b)).sum()  # noqa: E731,B023
            assert all(loss(slope, shift) <= loss(slope * f, shift + g) + 1e-3 for f in (0.99, 1, 1.01) for g in (-0.01, 0, 0.01))


def test_scores_do_not_depend_on_the_block():
    rng = random.Random(8)
    texts = [prose(rng, rng.choice(list(LETTERS)), rng.randrange(0, 200)).encode() for _ in range(60)] + [b"", b"a", b"ab", b"one two", b" \n ", "é".encode()]
    rows = []
    with np.errstate(over="ignore"):
        for t in texts:
            rows.append((*quality.shares(t), len(t) % 2))
    model = quality.fit(rows)
    alone = [quality.probability(model, [t])[0] for t in texts]
    for _ in range(5):
        order = rng.sample(range(len(texts)), len(texts))
        assert list(quality.probability(model, [texts[i] for i in order])) == [alone[i] for i in order]
    # what is trained on is what is scored
    raw = quality.raw_scores(model, texts)
    assert np.allclose(raw, [model.weight[b] @ c + model.bias for b, c, _ in rows])


def test_quality_of_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, "aa", 40)) for i in range(40)] + [(7, prose(rng, "bb", 40)), (7, None), (41, "x " * 400_000), (42, "y" * 3_000_000)]
    labels = [(i, i % 2, 0) for i in range(20)] + [(3, 0, 0), (3, 1, 0), (None, 1, 0), (5, None, 0)]
    df, ldf = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.quality_report(df, ldf).collect()
    assert len(out) == len(rows) and all(0 < r.score < 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[41].n_words == by[41].n_repeat_words == 400_000 and by[42].word_chars == 3_000_000 and by[42].n_words == 1


def test_best_run_is_the_greatest_of_all_sums():
    rng = random.Random(7)
    for _ in range(400):
        values = [rng.choice([rng.uniform(-3, 3), -0.3, 1.0, 0.0, -0.05]) for _ in range(rng.randrange(30))]
        a, b = html_text.best_run(values)
        most = max((sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)), default=0.0)
        assert abs(sum(values[a:b]) - max(most, 0.0)) < 1e-9 and (a < b) == (most > 1e-12)


def test_pages_that_are_long_or_alike(spark):
    body = "<p>" + "many words that are in it " * 40_000 + "</p>"
    rows = [(i, "u", PAGE % f"<article>{BODY}</article>", 1) for i in range(1, 2000)] + [(5000, "u", PAGE % f"<article>{body}</article>", 1), (5001, "u", PAGE % f"<main>{BODY}</main>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.page_report(df).collect()}
    assert len(got) == len(rows) and got[1].text == got[1999].text == got[5001].text == TEXT
    assert got[5000].text == ("many words that are in it " * 40_000).strip() and got[5000].n_chars == len(got[5000].text)


def test_language_of_repeated_and_long_rows(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(rng.choice(list(LETTERS)) for _ in range(200))]
    rows += [rows[7], rows[7], (7, prose(rng, "cc", 40), "cc"), (900, prose(rng, "bb", 90_000), None), (901, "sch" * 200_000, None)]
    out = langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if r.doc_id in (900, 901)} == {"bb"}
    assert len({(r.lang_pred, r.score, r.accepted) for r in out if r.doc_id == 7}) == 2 and all(r.accepted is not None for r in out)
