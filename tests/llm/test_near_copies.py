"""Near copies against exact Jaccard of five-word shingles, and the walk against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm import near_copies


def sets(text: str | None) -> frozenset:
    """Five-word shingles, restated on strings."""
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(one: frozenset, two: frozenset) -> float:
    return len(one & two) / len(one | two) if one or two else 1.0


def groups(found: dict) -> tuple[dict, dict]:
    """Of {id: text}: the smallest id reachable over pairs of 0.8 or more, and the highest similarity to a smaller id."""
    made = {i: sets(t) for i, t in found.items()}
    holders: dict = {}
    for i in sorted(made):
        for s in made[i] or [None]:
            holders.setdefault(s, []).append(i)
    label = {i: i for i in made}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    best = dict.fromkeys(made, 0.0)
    for i in sorted(made):
        near = {j for s in made[i] or [None] for j in holders[s] if j < i}
        for j in near:
            share = jaccard(made[i], made[j])
            best[i] = max(best[i], share)
            if share >= 0.8:
                x, y = top(i), top(j)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in made}, best


def all_pairs(leaves: np.ndarray, cut: int, budget: int) -> list:
    far = np.bitwise_count(leaves[:, None] ^ leaves[None, :])
    return [(i, j) for j in range(len(leaves)) for i in range(j) if far[i, j] <= budget and (not cut or i < cut <= j)]


def labels(size: int, edges) -> list:
    label = list(range(size))
    for _ in range(size):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 60), st.integers(1, 11), st.booleans())
def test_walk_equals_all_pairs(seed, size, flips, two):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, size // 15), dtype=np.uint64)
    leaves = base[rng.integers(0, len(base), size)]
    for _ in range(flips):
        leaves = leaves ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
    cut = size // 2 if two else 0
    leaves = np.concatenate((np.sort(leaves[:cut]), np.sort(leaves[cut:])))
    runs = np.array([[0, cut, cut, size]] if two else [[0, size, 0, size]])
    a, b = near_copies.walk(leaves, runs)
    last = near_copies.ROUNDS[-1]
    assert (np.bitwise_count(leaves[a] ^ leaves[b]) <= last).all()
    want = labels(size, all_pairs(leaves, cut, last))
    assert labels(size, list(zip(a.tolist(), b.tolist(), strict=True))) == want
    assert len(a) == size - len(set(want))


def test_walk_of_equal_leaves_and_several_runs():
    leaves = np.array([5, 5, 5, 5, 2**63, 2**63], np.uint64)
    a, b = near_copies.walk(leaves, np.array([[0, 2, 2, 4], [4, 6, 4, 6]]))
    assert labels(6, list(zip(a.tolist(), b.tolist(), strict=True))) == [0, 0, 0, 0, 4, 4]


def test_layout_follows_the_number_of_texts():
    for texts in (1, 10**5, 10**8, 10**11):
        lead, tables = near_copies.layout(texts)
        assert texts / 2**lead <= 8
        kept = 1 - (1 - (1 - near_copies.differing(0.8)) ** lead) ** tables
        assert near_copies.RECALL <= kept < near_copies.RECALL + 0.02
        assert near_copies._tables(lead, tables)


def test_share_of_differing_bits():
    rng = np.random.default_rng(3)
    for changed in (0, 4, 8, 40):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
        other = list(words)
        for at in np.linspace(5, 390, changed).astype(int):
            other[at] += "x"
        one, two = (np.frombuffer(near_copies.fingerprint(" ".join(w)), np.uint64) for w in (words, other))
        share = int(np.bitwise_count(one ^ two).sum()) / near_copies.BITS
        assert abs(share - near_copies.differing(jaccard(sets(" ".join(words)), sets(" ".join(other))))) < 0.035


def test_whole_table(spark):
    """All removed documents are near copies; of the near copies at least nine in ten are removed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.text for r in docs.collect()}
    label, best = groups(found)
    kept = {r.doc_id for r in near_copies.heads(docs).collect()}
    gone = found.keys() - kept
    assert gone and all(label[i] != i for i in gone)
    copies = {i for i in found if best[i] >= 0.8}
    assert len(copies & gone) >= 0.9 * len(copies)


@pytest.mark.parametrize("cell", [near_copies.CELL, 8])
def test_groups_of_near_copies(spark, monkeypatch, cell):
    """One document stays of each group, also where its cells are cut into parts."""
    monkeypatch.setattr(near_copies, "CELL", cell)
    rng = np.random.default_rng(7)
    rows = []
    for group in range(4):
        words = [f"g{group}w{i}" for i in rng.integers(0, 10**6, 300)]
        for copy in range(40):
            own = list(words)
            for at in rng.integers(0, 300, 2):
                own[at] = f"x{copy}"
            rows.append((len(rows), " ".join(own)))
    lone = [(1000 + i, " ".join(f"l{i}v{j}" for j in range(200))) for i in range(30)]
    docs = spark.createDataFrame(rows + lone, "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_copies.heads(docs).collect())
    assert kept == sorted(set(groups(dict(rows + lone))[0].values())) == [0, 40, 80, 120, *range(1000, 1030)]


def test_exact_check(spark):
    words = [f"w{i}" for i in range(104)]
    pairs = [(i, -i, " ".join(words), " ".join([*words[: 104 - i], *[f"x{j}" for j in range(i)]])) for i in range(1, 30)]
    got = {r.a for r in near_copies.similar(spark.createDataFrame(pairs, "a long, b long, one string, two string")).collect()}
    assert got == {i for i, _, one, two in pairs if jaccard(sets(one), sets(two)) >= 0.8}


def test_odd_rows(spark):
    long = "very long text " * 60_000
    rows = [(1, None), (2, ""), (3, " \t"), (4, "Four Words Are Here"), (5, "four words are here"), (6, "other"), (None, "no id at all"),
            (7, long), (8, long + "end"), (9, "other"), (9, "other"), (10, "no id at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_copies.heads(docs).collect())
    # The long texts have 3 and 5 distinct shingles, a similarity of 0.6.
    assert kept == [1, 4, 6, 7, 8, 10]
    assert near_copies.heads(docs.limit(0)).collect() == []
