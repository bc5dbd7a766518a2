import hashlib
import random
import re

from newsloom.llm.pii import KINDS, find_spans, luhn, mod97, pii_report, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m[0])
            ok = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    pool = ["a", "b.c", "@", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "é", "🙂", "4111111111111111", "4111 1111 1111 1111", "@x.y", "10.0.0.1", "+49 30 1234567", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))
        assert [s[:3] for s in find_spans(text) if s[0] in KINDS] == plain(text), text


def test_checksums_and_added_kinds():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89 3704 0044 0532 0130 00") and not mod97("DE88 3704 0044 0532 0130 00")
    text = "my bank account IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789"
    assert [s[0] for s in find_spans(text) if s[0] not in KINDS] == ["iban", "ssn"]
    assert [s[0] for s in find_spans("model and part 123-45-6789") if s[0] not in KINDS] == []


def test_long_runs_are_linear():
    assert find_spans("a" * 300_000) == [] and find_spans("1" * 300_000) == [] and find_spans("a@" * 100_000) == []


def test_report_and_redaction(spark):
    rows = [(1, "write to ann@x.org or 10.0.0.1", "k"), (2, None, "k"), (3, "", None), (None, "call +49 30 1234567", "k"), (1, "write to ann@x.org or 10.0.0.1", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii_report(df).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = (1, 1, 1, 0, 0, digest("email:9:18,ip:22:30"), "email:9:18,ip:22:30")
    assert got == sorted([one, one, (2, 0, 0, 0, 0, digest(""), ""), (3, 0, 0, 0, 0, digest(""), ""), (None, 0, 0, 0, 1, digest("phone:5:19"), "phone:5:19")], key=str)
    clean = {tuple(r) for r in redact(df).collect()}
    assert (1, "write to [EMAIL] or [IP]", "k") in clean and (2, None, "k") in clean and (3, "", None) in clean
    assert pii_report(df.limit(0)).collect() == []
