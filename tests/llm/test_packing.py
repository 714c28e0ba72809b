"""Packing: the decision equals piece-by-piece best fit; pieces tile documents and windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidara.llm import packing, queries
from evidara.llm.base import texts


def brute(lengths, window):
    """Fill of every window after best-fit decreasing, piece by piece."""
    free: list[int] = []
    for length in sorted(lengths, reverse=True):
        at = bisect_left(free, length)
        left = (free.pop(at) if at < len(free) else window) - length
        insort(free, left)
    return sorted(window - f for f in free)


def expand(runs):
    for length, first, count, low, per, offset in runs.tolist():
        for j in range(count):
            yield length, first + j, low + j // per, offset + j % per * length


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_decision_equals_piecewise_best_fit(lengths):
    runs = packing.decide(dict(Counter(lengths)), 32)
    placed = list(expand(runs))
    assert Counter(p[0] for p in placed) == Counter(lengths)
    numbers = defaultdict(list)
    windows = defaultdict(list)
    for length, number, window, offset in placed:
        numbers[length].append(number)
        windows[window].append((offset, length))
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    assert sorted(windows) == list(range(len(windows)))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32
    assert sorted(sum(x[1] for x in own) for own in windows.values()) == brute(lengths, 32)


def test_runs_stay_few():
    random = np.random.default_rng(1)
    histogram = {int(k): int(random.integers(1, 10**9)) for k in range(1, 4097)}
    assert len(packing.decide(histogram)) < 200_000


def _check(rows, given_texts):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    windows, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    for doc_id, text in given_texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END]
        at = 0
        for r in sorted(documents[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return windows


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op1_packing(spark, folder).collect()
    windows = _check(rows, docs)
    fill = sum(r.length for r in rows) / (len(windows) * packing.WINDOW)
    assert fill > 0.99, fill


def test_encoder_on_every_kind_of_blank():
    encoder = packing.Encoder(packing.VOCABULARY)
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace() or c < 33] + ["\u180e", "\u200b", "\ufeff"]
    for text in [f"ab{c}cd {c}e's{c}" for c in blanks] + ["".join(blanks) + "\x1cx" + "".join(blanks)]:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids, text


@settings(max_examples=400, deadline=None)
@given(st.text("aBÉéΣ09.,!'%<|>&stSreéx \t", max_size=40) | st.sampled_from(["x<|endoftext|>.", "It's'.", "''s,", "a,.B!!", "1.2,", "İ.", "ΑΣ."]))
def test_encoder_on_marks_and_cases(text):
    known = packing.encoder(packing.VOCABULARY)
    ids = known.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(known.encode(text), "<u4").tolist() == ids


def test_odd_inputs(spark):
    long = "alpha beta, gamma's 12 " * 40_000
    rows = [(1, None, 5), (2, "", 5), (3, long, 5), (4, "<|endoftext|> É́ x y\x1cz", 5), (None, " \n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    made = packing.packed(packing.pieces(texts(df))).collect()
    _check(made, {r[0]: r[1] for r in rows})
    twice = packing.packed(packing.pieces(texts(df.where("doc_id = 3").unionAll(df.where("doc_id = 3"))))).collect()
    assert Counter(r.start for r in twice) == {s: 2 for s in {r.start for r in twice}}
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.packed(packing.pieces(texts(df.limit(0)))).collect() == []
