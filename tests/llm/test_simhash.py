"""Fingerprints bit by bit, the trie join against all pairs, components against union-find."""

from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm import queries, simhash
from evidara.llm.base import texts


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def slow_components(prints):
    """Least position reachable, by position."""
    values = np.array(prints, np.uint64)
    label = list(range(len(values)))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
        low = min(label[j] for j in near)
        old = {label[j] for j in near}
        label = [low if x in old else x for x in label]
    return label


@settings(max_examples=200, deadline=None)
@given(st.text("aB \t\n\x0b éÉ\x85x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_long_fingerprint():
    text = " ".join(str(i * 7919 % 1000) for i in range(150_000))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def _family(random, size):
    """Loose values, chains of 3-bit steps, and a dense ball."""
    out = list(random.integers(0, 2**63, size, dtype=np.uint64))
    for _ in range(size // 10):
        value = int(random.integers(0, 2**63))
        for _ in range(6):
            for bit in random.integers(0, 64, random.integers(1, 5)):
                value ^= 1 << int(bit)
            out.append(np.uint64(value))
    centre = int(random.integers(0, 2**63))
    for _ in range(size):
        bits = random.choice(12, random.integers(0, 4), replace=False) * 5
        out.append(np.uint64(centre ^ sum(1 << int(b) for b in bits)))
    return np.unique(np.array(out, np.uint64))


def _components(spark, values):
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, len(values))).collect()}
    root = [found.get(int(v), int(v)) for v in values.view(np.int64)]
    first = {}
    return [first.setdefault(r, i) for i, r in enumerate(root)]


def test_trie_join_against_all_pairs(spark):
    values = _family(np.random.default_rng(5), 400)
    assert _components(spark, values) == slow_components(values)


def test_large_subtrees_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTREE", 50)
    values = _family(np.random.default_rng(6), 300)
    assert _components(spark, values) == slow_components(values)


def test_long_chains(spark):
    rows = [(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)]
    made = simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.root for r in made if r.node < 1000} == {0} and len(made) == 300 + 199


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = sorted(spark.read.parquet(f"{folder}/documents.parquet").collect(), key=lambda r: r.doc_id)
    prints = [slow_fingerprint(r.text or "") for r in rows]
    want = {r.doc_id: (f"{p:016x}", rows[c].doc_id) for r, p, c in zip(rows, prints, slow_components(prints), strict=True)}
    made = queries.op2_simhash(spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in made} == want and len(made) == len(rows)


def test_odd_inputs(spark):
    rows = [(7, None, 1), (5, "", 1), (6, " \n\t", 1), (None, "one two three four", 1), (None, "one two three four", 1), (9, "A", 1), (9, "A", 1), (2, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    made = simhash.near_duplicates(texts(df)).collect()
    assert len(made) == len(rows)
    by = {(r.doc_id, r.component_id) for r in made}
    assert by == {(7, 5), (5, 5), (6, 5), (None, None), (9, 2), (2, 2)}
    assert simhash.near_duplicates(texts(df.limit(0))).collect() == []
