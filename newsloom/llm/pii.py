"""Personal data: patterns propose spans, checksums confirm them, context words near a span adjust its score.

Four base kinds (email, ip, card, phone) are always reported where their pattern and validator hold. The method adds
kinds that need more than a pattern: ``iban`` (mod-97), ``ssn`` (area and group rules and a context word) and
``national_id`` digits that only a context word makes likely. Scores run from 0 to 1; an added span is kept from
``min_score`` up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shingles import give_back

#: Fixed values of the query's contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match never starts inside a run of digits: the lookbehind keeps long runs linear
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9.+-])[0-9]{8,12}(?![0-9.-])")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words that make a span of the kind likelier, and words that make it less likely.
CONTEXT = {
    "email": ({"email", "e-mail", "mail", "contact", "write", "address"}, {"example", "noreply"}),
    "ip": ({"ip", "host", "server", "address", "login"}, {"version", "release", "build"}),
    "card": ({"card", "visa", "credit", "payment", "pay"}, {"isbn", "order", "tracking"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax", "contact"}, {"isbn", "order"}),
    "iban": ({"iban", "bank", "account", "transfer", "konto", "compte", "cuenta"}, {"code", "hash"}),
    "ssn": ({"ssn", "social", "security"}, {"part", "model", "isbn"}),
    "national_id": ({"passport", "ssn", "license", "licence", "identity", "ausweis", "dni", "passeport"}, {"isbn", "order", "total"}),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "national_id": 0.2}
NEAR_CHARS = 50
MIN_SCORE = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ssn_rules(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` so that a long run without one costs nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {"email": list(emails(text))}
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15] if "+" in text else []
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(re.findall(r"[\w-]+", (text[max(0, start - NEAR_CHARS) : start] + " " + text[end : end + NEAR_CHARS]).lower()))
    more, less = CONTEXT[kind]
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.4 * bool(near & more) - 0.3 * bool(near & less))), 3)


def find_spans(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive, by kind and then start; a null text has none."""
    text = text or ""
    found = base_spans(text)
    spans = [(k, a, b, score(text, k, a, b)) for k in KINDS for a, b in found[k]]
    taken = [(a, b) for k in KINDS for a, b in found[k]]
    for kind, pattern, valid in (("iban", IBAN, mod97), ("ssn", SSN, ssn_rules), ("national_id", NATIONAL, lambda _: True)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if valid(m[0]) and (s := score(text, kind, a, b)) >= min_score and not any(x < b and a < y for x, y in taken):
                spans.append((kind, a, b, s))
                taken.append((a, b))
    return spans


def redact_text(text: str | None, spans: list[tuple[str, int, int, float]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans merge into the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def pii_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """Adds ``out_col``: array of (kind, start, end, score). Rows, nulls and other columns stay as they are."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(kind=k, start=a, end=b, score=s) for k, a, b, s in find_spans(t)] for t in texts])

    return docs.withColumn(out_col, spans(F.col(text_col).cast("string")))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces personal data in ``text_col``; a null text stays null, every row and column stays."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = pd.Series([redact_text(t, find_spans(t)) for t in texts], dtype=object)
        give_back()
        return out

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of their spans, and all spans as text."""
    spans = pii_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "pii").drop("text")
    key = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("pii", lambda x: x["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind))
    return spans.select(
        "doc_id",
        *(count(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, key), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", key), ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )
