"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand, tags score below zero; the contiguous run with the greatest sum, found by one scan, is the content.
Sums are taken of each element too: those whose words sum up below zero, such as an advert or reader comments in the middle of an article, are left out.

The scores are log-odds from labelled pages: those that mark their article by an ``article`` or ``main`` element, up to ``SAMPLE_PAGES`` of them, with all text counted inside
or outside. A word's score is that of its block's element, or less where one of the classes, ids, roles or sections that it lies in scores less, and that of the
block's shape: its length and whether it is links, which is all that is known of classes that no labelled page had. An element with an unknown class counts ``UNKNOWN_CLASS`` of the element's score.
What HTML defines as no article text, and plain names of such parts, start with ``PRIOR_COUNT`` counted outside; labelled pages outweigh them. Only elements that are never shown are left out by rule.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400
LABEL_LIMIT, SHAPE_LIMIT, TAG_BASE, TAG_LIMIT = 4.0, 2.0, 0.3, 1.0
BASE, UNKNOWN_CLASS, PRIOR_COUNT, SEEN, GAP = 0.5, 0.4, 400, 5, 0.5

#: Kinds of HTML elements.
RAW = "script style textarea title noscript template iframe svg"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
HIDDEN = "script style textarea title noscript template iframe svg head select"
SECTIONS = "nav footer aside form header button dialog menu article main"
#: Names in a class, id or role that start with words counted outside, as the sections but article and main do.
PRIOR = (
    "ad ads advert advertisement adverts sponsored promo banner cookie cookies cookie-banner cookie-notice cookie-consent consent notice menu nav navbar navigation sidebar side-bar "
    "footer masthead comment comments user-comments comment-list disqus_thread share share-buttons social social-share related related-articles related-posts recommended "
    "newsletter newsletter-signup subscribe breadcrumb breadcrumbs popup modal widget pagination site-header site-footer page-header page-footer complementary contentinfo search"
)
_RAW, _VOID, _INLINE, _HIDDEN, _SECTIONS = (frozenset(x.split()) for x in (RAW, VOID, INLINE, HIDDEN, SECTIONS))
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?i)(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")


class Element:
    """An open element: its name, where it stands, and the keys of the classes, ids, roles and sections that it lies in."""

    __slots__ = ("name", "keys", "classed", "hidden", "article", "block", "linked")

    def __init__(self, name: str, names: list[str], parent: Element | None):
        self.name, self.classed = name, bool(names)
        self.article = name in ("article", "main") or parent is not None and parent.article
        own = [f".{n.lower()}" for n in names]
        if name in _SECTIONS and not (name == "header" and parent is not None and parent.article):
            own.append(f"#{name}")
        self.keys = (parent.keys if parent is not None else ()) + tuple(own)
        self.hidden = name in _HIDDEN or parent is not None and parent.hidden
        self.block = self if name not in _INLINE or parent is None else parent.block
        self.linked = name == "a" or name in _INLINE and parent is not None and parent.linked


_PAGE = Element("html", [], None)


def tokens(html: str) -> list[tuple[str, Element, str]]:
    """(kind, element, text) in page order: kind is 'w' for text, '<' and '>' for tags that begin and end an element, '-' for those of empty elements."""
    out: list[tuple[str, Element, str]] = []
    stack: list[Element] = []
    at = 0

    def text(s: str) -> None:
        if s:
            out.append(("w", stack[-1] if stack else _PAGE, s))

    def close(n: int) -> None:
        while len(stack) > n:
            out.append((">", stack.pop(), ""))

    low = ""
    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        slash, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        names = " ".join(next(filter(None, x), "") for x in _MARK.findall(attrs)).split() if attrs and "=" in attrs else []
        if name not in _INLINE and name not in _VOID:
            for i in range(len(stack) - 1, -1, -1):  # a new block ends an open paragraph and the inline elements in it
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in _INLINE:
                    break
            if name == "li" and stack and stack[-1].name == "li":
                close(len(stack) - 1)
        element = Element(name, names, stack[-1] if stack else None)
        if name in _VOID or attrs.rstrip().endswith("/") and name not in _RAW:
            out.append(("-", element, ""))
            continue
        stack.append(element)
        out.append(("<", element, ""))
        if name in _RAW:  # up to its own end tag, whatever is inside
            low = low or html.lower()
            end = low.find(f"</{name}", at)
            end = len(html) if end < 0 else end
            if name in ("textarea", "title"):
                text(html[at:end])
            at = end
    text(html[at:])
    close(0)
    return out


def shown_blocks(parts: list[tuple[str, Element, str]]) -> list[tuple[list[int], int, Element, bool]]:
    """Blocks of text that is shown: the places of their words' tokens, the number of words, the element, and whether most words are links."""
    out: list[tuple[list[int], int, Element, bool]] = []
    held: list[int] = []
    count = links = 0
    for i, (kind, element, s) in enumerate(parts):
        if kind == "w":
            if not element.hidden and (n := len(s.split())):
                if held and parts[held[0]][1].block is not element.block:
                    out.append((held, count, parts[held[0]][1].block, 2 * links > count))
                    held, count, links = [], 0, 0
                held.append(i)
                count += n
                links += n * element.linked
        elif held and element.name not in _INLINE:
            out.append((held, count, parts[held[0]][1].block, 2 * links > count))
            held, count, links = [], 0, 0
    if held:
        out.append((held, count, parts[held[0]][1].block, 2 * links > count))
    return out


def block_keys(words: int, element: Element, linked: bool) -> tuple[str, str, str]:
    """Keys of a block: the element as it is, the element by name, and the shape."""
    flag = "~" if linked else ""
    return f"b{element.name}{'.' if element.classed else ''}{flag}", f"e{element.name}{flag}", f"s{min(words.bit_length(), 7)}{flag}"


def tally(html: str) -> tuple[Counter, Counter]:
    """Blocks by key, each by the number of binary digits of its words, and tags, inside and outside the page's marked article; a page without one gives none."""
    inside, outside = Counter(), Counter()
    parts = tokens(html)
    if any(e.name in ("article", "main") for kind, e, _ in parts if kind == "<"):
        for _, n, element, linked in shown_blocks(parts):
            into = inside if element.article else outside
            for key in {*block_keys(n, element, linked), *element.keys, "all"}:
                into[key] += n.bit_length()  # so that no page of very long blocks outweighs the others
        for kind, element, _ in parts:
            if kind != "w" and not element.hidden:
                (inside if element.article else outside)["t" + element.name] += 1
    return inside, outside


def scores(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Scores by key from counts inside and outside articles. A key that isn't there was counted less than ``SEEN`` times."""
    outside = Counter(outside)
    for name in PRIOR.split():
        outside[f".{name}"] += PRIOR_COUNT
    for name in _SECTIONS - {"article", "main"}:
        outside[f"#{name}"] += PRIOR_COUNT
    within = lambda x, most: max(-most, min(most, x))
    all_in, all_out = inside.get("all", 0) + 1, outside.get("all", 0) + 1
    score = {}
    for key in inside.keys() | outside.keys():
        a, b = inside.get(key, 0) + 0.5, outside.get(key, 0) + 0.5
        if key[0] == "t":
            score[key] = within(min(0.0, math.log(a / b)), TAG_LIMIT) - TAG_BASE
        elif key[0] == "s":
            score[key] = within(math.log(a / all_in * all_out / b), SHAPE_LIMIT)
        elif key != "all" and a + b > SEEN:
            score[key] = within(math.log(a / b), LABEL_LIMIT)
    return score


def block_score(score: dict[str, float], words: int, element: Element, linked: bool) -> float:
    """The score of each word of a block."""
    own, name, shape = block_keys(words, element, linked)
    label = score[own] if own in score and not element.classed else UNKNOWN_CLASS * score.get(name, 0.0)
    label = min([label, *(score[k] for k in element.keys if k in score)])
    return BASE + label + score.get(shape, 0.0)


def weights(pages: list[str]) -> dict[str, float]:
    """Scores from some pages."""
    inside, outside = Counter(), Counter()
    for html in pages:
        a, b = tally(html)
        inside.update(a)
        outside.update(b)
    return scores(inside, outside)


def best_run(values: list[float]) -> tuple[int, int]:
    """The first contiguous run with the greatest sum, by one scan; empty where no sum is above zero."""
    best, best_from, best_to, now, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(values):
        now += x
        if now <= 0:
            now, start = 0.0, i + 1
        elif now > best:
            best, best_from, best_to = now, start, i + 1
    return best_from, best_to


def negative_elements(parts: list[tuple[str, Element, str]], values: list[float]) -> list[tuple[int, int, float]]:
    """(first place, last place, sum) of the outermost elements whose words sum up below zero; what was found so inside an element no longer counts for it."""
    found: list[tuple[int, int, float]] = []
    open_: list[tuple[Element | None, int, float]] = [(None, 0, 0.0)]
    for i, (kind, element, _) in enumerate(parts):
        if kind == "w":
            first, at, total = open_[-1]
            open_[-1] = (first, at, total + values[i])
        elif kind == "<" and element.name not in _INLINE:
            open_.append((element, i, 0.0))
        elif kind == ">" and open_[-1][0] is element:
            _, at, total = open_.pop()
            if total < 0:
                while found and found[-1][0] > at:
                    total += found.pop()[2]
                found.append((at, i, total))
            else:
                first, before, outer = open_[-1]
                open_[-1] = (first, before, outer + total)
    return found


def main_text(html: str | None, score: dict[str, float]) -> str:
    """The best run's blocks, one a line; empty where no run scores above zero. An element that is left out costs the run around it ``GAP`` at most."""
    parts = tokens(html or "")
    values = [0.0 if kind == "w" or element.hidden else score.get("t" + element.name, -TAG_BASE) for kind, element, _ in parts]
    for places, words, element, linked in shown_blocks(parts):
        each = block_score(score, words, element, linked)
        for i in places:
            values[i] = each * len(parts[i][2].split())
    gone: set[int] = set()
    for at, end, total in negative_elements(parts, values):
        gone.update(range(at, end + 1))
        for i in range(at, end + 1):
            values[i] *= min(1.0, GAP / -total) if parts[i][0] == "w" else 0.0
    begin, end = best_run(values)
    blocks: list[str] = []
    held: list[str] = []
    for i in range(begin, end):
        kind, element, s = parts[i]
        if kind == "w":
            if not element.hidden and i not in gone:
                held.append(s)
        elif element.name not in _INLINE:
            blocks.append("".join(held))
            held = []
    blocks.append("".join(held))
    clean = (_SPACE.sub(" ", unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def train(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Scores from at most ``2 * SAMPLE_PAGES`` pages that mark their article, about ``SAMPLE_PAGES``, picked by hash of the page.

    Pages are counted on the executors; the driver gets the sums by kind and name.
    """
    marked = pages.select(F.col(html_col).cast("string").alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
    n = marked.count()
    order = F.xxhash64("html", F.lit(3)).bitwiseAND(F.lit((1 << 40) - 1))
    share = order / F.lit(float(1 << 40)) < F.lit(min(1.0, SAMPLE_PAGES / max(n, 1)))
    # repeated pages have one hash, so a bound is needed besides: the least hashes
    least = marked.where(share).select(order.alias("order")).groupBy("order").agg(F.count("*").alias("n")).orderBy("order").limit(2 * SAMPLE_PAGES).collect()
    kept, room = [], 2 * SAMPLE_PAGES
    for r in least:
        if (room := room - r["n"]) < 0 and kept:
            break
        kept.append(r["order"])

    def count(batches):
        for part in batches:
            for html in part["html"]:
                for at, found in enumerate(tally(html)):
                    yield pd.DataFrame({"key": list(found.keys()), "inside": [v * (at == 0) for v in found.values()], "outside": [v * (at == 1) for v in found.values()]})

    own = marked.where(order.isin(kept) if kept else F.lit(False)).groupBy("html").agg(F.count("*"))  # each different page once
    sums = own.select("html").mapInPandas(count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    rows = sums.collect()
    return scores({r["key"]: r["inside"] for r in rows}, {r["key"]: r["outside"] for r in rows})


def page_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds ``out_col``: the main text, empty for a null or contentless page. Rows and other columns stay."""
    score = train(pages, html_col)

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, score) for h in html], dtype=object)

    return pages.withColumn(out_col, extract(F.col(html_col).cast("string")))


def page_report(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``."""
    return page_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
