"""Alignment against the libraries on whole texts and plain loops."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidara.llm import align, queries
from evidara.llm.base import texts

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def tokens(libraries, text):
    """(id, bytes) of both over the whole text, or nothing."""
    a, b = libraries
    if not text:
        return None
    signs = align.byte_of_sign()
    left = [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        name = b.id_to_piece(i)
        right.append((i, bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == raw == b"".join(x for _, x in right) else None


def plain_groups(found):
    """Sets of ends, without divide and conquer."""
    left, right = found
    ends = [list(accumulate(len(x) for _, x in side)) for side in found]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups = [([], []) for _ in cuts]
    for n, (side, own) in enumerate(zip((left, right), ends, strict=True)):
        for (i, _), end in zip(side, own, strict=True):
            groups[bisect_left(cuts, end)][n].append(i)
    return groups


def brute(libraries, rows):
    held, count, highest = [], Counter(), defaultdict(int)
    for doc_id, text in rows:
        found = tokens(libraries, text)
        groups = plain_groups(found) if found else []
        links = Counter((x, y) for a, b in groups for x in a for y in b)
        count.update(links.keys())
        held.append((doc_id, found, groups, links))
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for doc_id, found, groups, links in held:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        sizes = (len(found[0]), len(found[1])) if found else (0, 0)
        best = sum(n for p, n in links.items() if count[p] == highest[p[0]])
        total = sum(n * count[p] for p, n in links.items())
        sha = hashlib.sha256(text.encode()).hexdigest() if found else ""
        out.append((doc_id, *sizes, len(groups), sum(links.values()), best, total, sha))
    return out


def answer(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert answer(queries.op11_alignment(spark, FOLDER)) == sorted(brute(libraries, rows))


CASES = [
    "", None, " ", "  ", "a ", " a", "a  b", "a\n b", "a\n  b", "x \n", "don't  I'LL", "<|endoftext|> </s> <s> <unk> <0x0A>", "\x00\x01\x7f", "\t\n\r ",
    "héllo wörld 日本語 😀👍🏽", "a▁b", "▁", "aaaa" * 500, "=" * 300 + "-" * 77, "12345 678.90", "foo\x85bar baz᠎ q\x1c z \xa0 x", "é é x́ y",
    "the " * 5000, "x" + " " * 500 + "y", "！ 全角　space", "ﬁ ligature", "​ z", "日本" * 4000,
]


def test_cases(spark, libraries):
    rows = list(enumerate(CASES))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(align.scored(texts(df))) == sorted(brute(libraries, rows))
    made = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in align.aligned(texts(df)).collect()}
    for i, text in rows:
        found = tokens(libraries, text)
        assert made[i] == (plain_groups(found) if found else []), text


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("etaoin shrdlu'sTHE.,!?\n\t0129éß😀\xa0́", max_size=120), max_size=60))
def test_random_texts(spark, libraries, given_texts):
    rows = list(enumerate(given_texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(align.scored(texts(df))) == sorted(brute(libraries, rows))


def test_small_blocks_share_counts(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 60)
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(["alpha", "betas,", "12%", "übergroß", "x" * 9, "don't", "日本"], k=pick.randrange(9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = align.linked(texts(df)).where("pairs IS NOT NULL").count()
    assert held > 20
    assert answer(align.scored(texts(df))) == sorted(brute(libraries, rows))


def test_divide_and_conquer():
    pick = random.Random(3)
    for _ in range(400):
        n = pick.randrange(1, 80)
        a, b = ({n, *pick.sample(range(1, n + 1), pick.randrange(n))} for _ in "ab")
        a, b = sorted(a), sorted(b)
        low_a = low_b = 0
        want = []
        for cut in sorted(set(a) & set(b)):
            i, j = a.index(cut) + 1, b.index(cut) + 1
            want.append((low_a, i, low_b, j))
            low_a, low_b = i, j
        assert align.align(a, b) == want
    long = list(range(1, 200_001))
    assert len(align.align(long, long[1::2])) == 100_000
    assert align.align([2 * x + 1 for x in range(100_000)] + [300_000], [2 * x for x in range(1, 100_000)] + [300_000]) == [(0, 100_001, 0, 100_000)]


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "ab cd", 2, "x"), (1, "ab cd", 2, "x"), (None, None, 2, "x")], "doc_id long, text string, block int, pairs string")
    made = align.scored(texts(df)).collect()
    assert len(made) == 3 and sorted(r.count_sum for r in made) == [0, 4, 4]
    assert align.scored(texts(df.limit(0))).collect() == []


@pytest.mark.parametrize("few", [0, 1, 5])
def test_intervals_aligned_together(monkeypatch, few):
    monkeypatch.setattr(align, "FEW", few)
    draw = random.Random(few)
    a, b, starts, base = [], [], [], 0
    for _ in range(400):
        size = draw.choice([1, 2, 5, 40, 400])
        i, j = len(a), len(b)
        for side in (a, b):
            inner = draw.sample(range(1, size), draw.randrange(size)) if size > 1 else []
            side += [base + x for x in sorted(inner)] + [base + size]
        starts.append((i, len(a), j, len(b)))
        base += size
    made = align.align_all(np.array(a), np.array(b), np.array(starts))
    assert [tuple(g) for g in made.tolist()] == align.align(a, b, starts)


def test_bytes_given_back_are_compared_per_stretch():
    both = align.coders(align.BYTE_LEVEL, align.PIECES)
    given_texts = [" one", " two", " three"]
    coded = both.encode(given_texts)
    assert both.all_give(given_texts, coded) == [True] * 3
    assert both.all_give(given_texts, [coded[0], coded[2], coded[1]]) == [True, False, False]
    assert both.all_give([" on", "e two", " three"], coded) == [False, False, True]
