"""Katz backoff against a plain recursive model, normalisation, and held-out likelihood."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from evidara.llm import katz, queries
from evidara.llm.base import bucket_of, texts

FOLDER = "/root/testdata/sf0.001"
END = "\n"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [END]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class Plain:
    """The model by dictionaries, for tables of one partition."""

    def __init__(self, rows):
        self.one, self.two = Counter(), Counter()
        for doc_id, text in rows:
            if not held(doc_id):
                t = tokens(text)
                self.one.update(t)
                self.two.update(zip([END, *t], t, strict=False))
        self.n, self.v = sum(self.one.values()), len(self.one)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.CUT + 2)]
        self.d1, self.d2 = katz.discounts(of(self.one)), katz.discounts(of(self.two))
        kept = sum(self.discount(self.d1, c) * c for c in self.one.values())
        self.free = max(1 - kept / self.n, 0.5 / self.n) if self.n else 1.0
        ones = of(self.one)
        self.many = max(1.0, ones[0] ** 2 / (2 * max(1, ones[1])))
        self.scale = (1 - self.free) * self.n / kept if self.n else 1.0
        self.after = {}
        for (a, b), c in self.two.items():
            if c >= katz.KEEP:
                self.after.setdefault(a, {})[b] = self.discount(self.d2, c) * c / (self.one[a] + 1)

    @staticmethod
    def discount(d, c):
        return d[c] if c <= katz.CUT else 1.0

    def word(self, w):
        c = self.one[w]
        return self.scale * self.discount(self.d1, c) * c / self.n if c else self.free / self.many

    def pair(self, a, b):
        kept = self.after.get(a, {})
        if b in kept:
            return kept[b]
        return (1 - sum(kept.values())) / (1 - sum(self.word(w) for w in kept)) * self.word(b)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.pair(a, b)) for a, b in zip([END, *t], t, strict=False))

    def base(self, text):
        return sum(math.log10((self.one[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))


def check(spark, rows, made):
    plain = Plain(rows)
    want = sorted(
        ((i is None, i or 0), held(i), len(t := tokens(x)), sum(plain.one[w] > 0 for w in t), plain.n, plain.base(x), plain.score(x)) for i, x in rows
    )
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in made)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-7)
    return plain


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    made = queries.op5_katz_backoff(spark, FOLDER).collect()
    plain = check(spark, rows, made)
    for context in [END, *list(plain.after)[:40]]:
        total = sum(plain.pair(context, w) for w in plain.one) + plain.pair(context, "never seen word") * plain.many
        assert abs(total - 1) < 1e-9
    out = [r for r in made if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("hot", [10**9, 30])
def test_many_chunks_and_spread_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "CHUNK_CHARS", 3000)
    random = np.random.default_rng(hot)
    rows = [(i, " ".join(f"w{int(x)}" for x in random.zipf(1.4, 40) % 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(katz, "HOT", hot)
    check(spark, rows, katz.scored(texts(df), bucket_of("doc_id", 7) == 2).collect())


def test_spread_contexts_over_partitions(spark, monkeypatch):
    """With several partitions discounts are by partition; spreading must keep sums at one."""
    monkeypatch.setattr(katz, "PART_TOKENS", 800)
    monkeypatch.setattr(katz, "CHUNK_CHARS", 5000)
    monkeypatch.setattr(katz, "HOT", 200)
    rows = [(i, " ".join(f"v{(i * 7 + j * j) % 31}" for j in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: r for r in katz.scored(texts(df), bucket_of("doc_id", 7) == 2).collect()}
    assert len(made) == 300 and all(np.isfinite(r.score) and r.score < 0 for r in made.values())
    assert np.mean([r.score - r.base_score for r in made.values()]) > 0


def test_odd_inputs(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, "A a\tÉ é", 1.0), (3, "A a\tÉ é", 1.0), (None, "b", 1.0), (4, "w " * 100_000, 1.0), (5, " \n", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    check(spark, [r[:2] for r in rows], katz.scored(texts(df), bucket_of("doc_id", 7) == 2).collect())
    assert katz.scored(texts(df.limit(0)), bucket_of("doc_id", 7) == 2).collect() == []
    none = katz.scored(texts(df), bucket_of("doc_id", 1) == 0).collect()
    assert len(none) == 7 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in none)


@pytest.mark.parametrize("hot", [10**9, 60])
def test_several_partitions_against_the_global_model(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "PART_TOKENS", 800)
    monkeypatch.setattr(katz, "CHUNK_CHARS", 5000)
    monkeypatch.setattr(katz, "HOT", hot)
    random = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{int(x)}" for x in random.zipf(1.3, 40) % 400)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = check(spark, rows, katz.scored(texts(df), bucket_of("doc_id", 7) == 2).collect())
    assert any(plain.d2[1:] < 1)
