import hashlib
import random
import re

from tallyfolio.llm import pii

# The contract's patterns, applied as they stand.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    pieces = list("@+.- ()0123459aZé_%") + ["a@b.co", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "http://x.y/z", "token = ", "\n", "ж", "😀", "..", "255", "0007"]
    found = 0
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        got = pii.spans(text)
        assert {k: got[k] for k in BASE} == slow(text), text
        found += sum(map(len, got.values()))
    assert found > 3000


def test_added_spans():
    text = 'see https://Example.org/a?b=1, IBAN: DE44500105175407324931; token = "4d44c79e8bf7c557" passwordless account of mine'
    got = pii.spans(text)
    assert [text[s:e] for s, e in got["url"]] == ["https://Example.org/a?b=1"]
    assert [text[s:e] for s, e in got["account"]] == ["DE44500105175407324931", "4d44c79e8bf7c557"]


def test_linear_on_long_texts():
    for text in ("1." * 5_000, "+1" + " (" * 5_000, "@a" * 5_000, "9 " * 5_000):
        assert {k: v for k, v in pii.spans(text).items() if k in BASE} == slow(text)
    assert pii.spans("a" * 300_000 + "@b.c")["email"] == [(0, 300_004)]


def test_find_and_redact(spark):
    text = "Mail é.x@mail.example.com or +1 (555) 123-4567, ip 10.0.0.1."
    rows = [(1, text, "a", 1), (1, text, "a", 1), (2, None, None, None), (3, "", "b", 0), (None, "nothing", "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = pii.find(docs).collect()
    assert len(got) == 5
    one = [r for r in got if r.doc_id == 1][0]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 1)
    base = ",".join(f"{k}:{s}:{e}" for k, v in slow(text).items() for s, e in v)
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and one.spans == base
    assert [r.base_sha256 for r in got if r.doc_id == 3] == [hashlib.sha256(b"").hexdigest()]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert [r.text for r in clean.collect() if r.doc_id == 1] == ["Mail é[EMAIL] or [PHONE], ip [IP]."] * 2
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in clean.collect())
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_overlaps_are_replaced_together():
    assert pii.redacted("+1.2.3.44567890 x") == "[PHONE] x"
