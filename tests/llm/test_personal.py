"""Anchor expansion against whole-text regular expressions."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, span):
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    rows = [
        (m.start(), i, m.end())
        for i, (kind, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text)
        if valid(kind, m[0])
    ]
    return [(list(PATTERNS)[i], s, e) for s, i, e in sorted(rows)]


def base(text):
    return [s for s in personal.find(text) if s[0] in personal.BASE]


CASES = [
    "", "a@b@c.com", "a@b.co@c.com", "x.y+z%1@m-1.example.com.", "1.2.3.4.5.6.7.8", "1.2.3", "999.1.1.1 1.2.3.4567",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (555) 555-1234", "+49 (0) 1234567890123456", "++1 234 567 8901",
    "4539148803436467 4111111111111111", "é😀 a@b.c 1.2.3.4", "@a.b", "a@.b", "a@-.-", "0000001.2.3.4", "+1" + " " * 50 + "2",
]


def test_cases():
    for text in CASES:
        assert base(text) == brute(text), text


@settings(max_examples=1500, deadline=None)
@given(st.text("aZ.@@+-_% ()0123499é\n", max_size=60))
def test_against_regular_expressions(text):
    assert base(text) == brute(text)


def test_added_kinds():
    text = 'see https://a.example/x?y=1 token = "ab12cd34ef56" and 12 Long Street'
    found = {k: text[s:e] for k, s, e in personal.find(text)}
    assert found["url"] == "https://a.example/x?y=1" and found["account"] == "ab12cd34ef56"
    assert found["postal"] == "12 Long Street"
    assert personal.mask(text) == 'see [URL] token = "[ACCOUNT]" and [POSTAL]'


def test_rows(spark):
    long = "word " * 300_000 + "a@b.cd"
    rows = [(1, "a@b.cd 1.2.3.4", 9), (1, "a@b.cd 1.2.3.4", 9), (2, None, 9), (3, "", 9), (4, long, 9), (None, "+1 234 567 8901", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    from evidara.llm.base import texts

    made = sorted(personal.spans_of(texts(df)).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in made] == [
        (1, 1, 1, 0, 0), (1, 1, 1, 0, 0), (2, 0, 0, 0, 0), (3, 0, 0, 0, 0), (4, 1, 0, 0, 0), (None, 0, 0, 0, 1),
    ]
    assert made[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() and made[2].spans == ""
    clean = personal.masked(df).collect()
    assert sorted(clean[0].asDict()) == ["doc_id", "spans", "text"]
    assert [r.text for r in clean if r.doc_id == 1] == ["[EMAIL] [IP]"] * 2
    assert personal.spans_of(texts(df.limit(0))).collect() == []


def test_long_values_are_masked_whole():
    for size in (64, 65, 700):
        for value in ("a1" * size)[:size], ("aB3+/x~y=" * size)[: size - 2] + "==":
            for quote in ("", '"'):
                text = f"api_key = {quote}{value}{quote} end"
                assert personal.mask(text) == f"api_key = {quote}[ACCOUNT]{quote} end"
    assert personal.mask("token: " + "eyJh.eyJz-_9." * 40 + " end") == "token: [ACCOUNT] end"
    assert personal.mask("token password: abc123 token-" + "password-" * 9) == "token password: [ACCOUNT] token-" + "password-" * 9
    assert personal.find("token=" + "a-token-" * 100_000) == []


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([*personal.CUES, *personal.SCHEMES, *personal.STREETS]), st.integers(0, 2**16))
def test_anchors_in_any_spelling(word, flips):
    """Cues, schemes and streets are found whatever the case of each letter; places are those of the text given."""
    spelt = "".join(c.upper() if c.isascii() and flips >> i & 1 else c for i, c in enumerate(word))
    text = f"\u0130 {{}} 12 12 {spelt} 12 abc12345 {spelt}: abc12345"
    same = text.replace(spelt, word)
    assert personal.find(text) == personal.find(same)


def test_cues_of_mixed_spelling():
    for text in ("PassWord: abc12345", "pAssword=abc12345", "\u0130 passWORD abc12345"):
        found = [s for s in personal.find(text) if s[0] == "account"]
        assert [text[a:b] for _, a, b in found] == ["abc12345"], text
