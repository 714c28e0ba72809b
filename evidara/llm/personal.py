"""Personal data: anchors found by Aho-Corasick, expanded and validated by local parsers.

One pass of the automaton over a text gives the places of at-signs, plus signs, digit starts,
URL schemes and identifier cues.  Each kind of anchor has a deterministic local parser that
looks at the neighbourhood only: it grows an email to both sides of its at-sign, follows a run
of digits as address or card, and reads the value behind a cue such as ``account`` or ``token``.

Kinds: ``email``, ``ip``, ``card``, ``phone`` (leftmost, non-overlapping per kind; candidates
that fail validation are dropped) and, beyond them, ``url``, ``account`` and ``postal``.
Defined results: a null text is empty, an empty text has no spans, a text of any length is read
whole, repeated rows give repeated rows, other columns are ignored, an empty table gives an empty result.
Schemes, cues and streets are found in any case of A-Z; a house number before its street is sought in the 80 characters
before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from evidara.llm.base import numbered

KINDS = ("email", "ip", "card", "phone", "url", "account", "postal")
BASE = KINDS[:4]
SCHEMES = ("https://", "http://", "ftp://")
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "secret", "password", "api_key", "apikey", "api-key")
STREETS = ("street", "avenue", "road", "strasse", "straße", "rue", "calle", "boulevard")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'\x00-\x20]+")
_VALUE = re.compile(r"(?:[ _-]?(?:number|no|id|nr))?\.?[\x20\t]*[:=#]?[\x20\t]*[\"']?(?=([A-Za-z0-9][A-Za-z0-9._+/=~-]{5}))")
_REST = re.compile(r"[A-Za-z0-9._+/=~-]+")
_NUMBER_AHEAD = re.compile(r"[0-9]{1,5}[a-z]?,? (?:[^\W\d_]+ ){0,3}$")
_NUMBER_BEHIND = re.compile(r"(?: [^\W\d_]+){0,3},? [0-9]{1,5}[a-z]?\b")
_DIGITS = frozenset("0123456789")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES), ("street", STREETS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()
# Letter by letter, so places stay the same.
_LOWER = {**{ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, ord("\u1e9e"): "\u00df"}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    tail = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, tail.end()) if tail else None


def _ip_ok(span: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in span.split("."))


def _card_ok(span: str) -> bool:
    digits = span.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(span: str) -> bool:
    return 10 <= sum(c in _DIGITS for c in span) <= 15


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start, then kind as in ``KINDS``."""
    spans: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # end of the last candidate of a kind
    bare = 0  # end of the last value without a digit

    def take(kind: int, hit, valid=None) -> None:
        if hit is not None:
            start, end = hit
            done[kind] = end
            if valid is None or valid(text[start:end]):
                spans.append((start, kind, end))

    for last, (anchor, size) in _ANCHORS.iter(text.translate(_LOWER)):
        begin = last + 1 - size
        if anchor == "digit":
            for kind, pattern, valid in ((1, _IP, _ip_ok), (2, _CARD, _card_ok)):
                if begin >= done[kind]:
                    hit = pattern.match(text, begin)
                    if hit:
                        take(kind, hit.span(), valid)
                    elif kind == 1:  # no later digit of this run starts an address either
                        end = begin
                        while end < len(text) and text[end] in _DIGITS:
                            end += 1
                        done[kind] = end
        elif anchor == "at":
            take(0, _email(text, last, done[0]))
        elif anchor == "plus":
            if begin >= done[3]:
                hit = _PHONE.match(text, begin)
                take(3, hit.span() if hit else None, _phone_ok)
        elif anchor == "scheme":
            hit = _URL.match(text, last + 1) if begin >= done[4] else None
            take(4, (begin, hit.end()) if hit else None)
        elif anchor == "cue":
            if begin >= done[5] and not (begin and text[begin - 1].isalnum()):
                hit = _VALUE.match(text, last + 1)
                # A value that was read to its end without a digit is not read again by a cue inside it.
                if hit and hit.start(1) >= bare:
                    value = _REST.match(text, hit.start(1))
                    if any(c in _DIGITS for c in value[0]):
                        take(5, value.span())
                    else:
                        bare = value.end()
        elif begin >= done[6] and not (last + 1 < len(text) and text[last + 1].isalpha()):
            low = max(done[6], begin - 80)
            hit = _NUMBER_AHEAD.search(text, low, begin)
            if hit:
                take(6, (hit.start(), last + 1))
            elif hit := _NUMBER_BEHIND.match(text, last + 1):
                take(6, (begin, hit.end()))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(spans)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, text -> counts and spans per row; ``docs`` has exactly these two columns."""
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(text or "") for text in batch.column(1).to_pylist()]
            base = [[s for s in row if s[0] in BASE] for row in found]
            counts = [pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in BASE]
            hashes = pa.array([hashlib.sha256(_joined(row).encode()).hexdigest() for row in base], pa.string())
            lists = pa.array([_joined(row) for row in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, lists], names)

    kinds = ", ".join(f"n_{k} long" for k in BASE)
    return docs.mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string")


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    out, place = [], 0
    for kind, start, end in find(text):
        if start >= place:
            out += [text[place:start], f"[{kind.upper()}]"]
        place = max(place, end)
    return "".join([*out, text[place:]])


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all other columns as they are."""
    place, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if text is None else mask(text) for text in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(clean, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return numbered(docs).mapInArrow(run, docs.schema)
