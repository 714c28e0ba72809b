"""Ranked search against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from evidara.llm import queries, ranked

FOLDER = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) over (doc_id, text) and (item_id, text)."""
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for doc_id, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def answer(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    made = answer(queries.op13_ranked_search(spark, FOLDER))
    assert sorted(made) == sorted(brute(docs, items, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_small_blocks(spark, monkeypatch, seed):
    """Bands over several blocks, several blocks of items, and visits that stop early."""
    monkeypatch.setattr(ranked, "BLOCK", 700)
    monkeypatch.setattr(ranked, "ITEM_BLOCK", 40)
    monkeypatch.setattr(ranked, "FIRST", 3)
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "été", "x1", "中文"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i % 180, " ".join(pick.choices(words, weights, k=int(pick.paretovariate(0.7)) % 400))) for i in range(200)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(60)]  # ties
    items = [(i, " ".join(pick.choices(words, k=9))) for i in range(25)]
    made = answer(ranked.top_k(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4))
    assert sorted(made) == sorted(brute(docs, items, 4))


def test_visits_stop_early(monkeypatch):
    """Short documents come first; the others cannot reach the score and are not read."""
    monkeypatch.setattr(ranked, "FIRST", 10)
    ms, n = [30] * 20 + [900] * 5000, 5020
    table = pa.table({"doc_id": list(range(n)), "m": ms, "terms": [b"a b"] * n, "tfs": [[2, 1]] * n, "block": [0] * n})
    block = ranked.Block(ranked.build(table))
    read = []
    strata, impacts, counts, docs, *rest = block.terms["a"]

    class Seen:
        def __getitem__(self, mask):
            read.append(int(mask.sum()))
            return docs[mask]

    block.terms["a"] = (strata, impacts, counts, Seen(), *rest)
    at, scores = block.search([("a", 7)], 5)
    assert block.ids[at].tolist() == [0, 1, 2, 3, 4] and len(set(scores.tolist())) == 1
    assert read == [20]


def test_places_hold_every_term(spark):
    words = [(i, f"t{i} {i}é") for i in range(3000)]
    flags = ranked.places(ranked.item_terms(spark.createDataFrame(words, "item_id long, text string")))
    docs = spark.createDataFrame(words + [(-1, "nothing of it zzz " * 3)], "doc_id long, text string")
    kept = {r.doc_id: (r.n, bytes(r.terms).decode().split()) for r in ranked.counted(docs, flags).collect()}
    assert all(sorted(kept[i][1]) == sorted([f"t{i}", f"{i}é"]) and kept[i][0] == 2 for i, _ in words)
    assert kept[-1][0] == 12 and len(kept[-1][1]) < 4
    assert len(flags) < 1_200_000


def test_odd_rows(spark):
    docs = [
        (1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (4, "—… !?"), (5, "\x00ALPHA\x7f_beta`"),
        (6, "alpha " * 60_000), (7, "b" * 100_000), (8, "naïve—text 日本"),
    ]
    items = [(1, "Alpha alpha gamma"), (1, "Alpha alpha gamma"), (1, "beta"), (2, None), (3, ""), (4, "日本 —"), (None, "beta"), (5, "b" * 100_000), (6, "zzz")]
    extra = lambda rows, kind: spark.createDataFrame([(*r, "1", 2) for r in rows], f"{kind} long, text string, term string, block int")
    made = answer(ranked.top_k(extra(docs, "doc_id"), extra(items, "item_id"), 10))
    assert sorted(made, key=key) == sorted(brute(docs, items, 10), key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert answer(ranked.top_k(empty, asked, 3)) == []
    assert answer(ranked.top_k(spark.createDataFrame(docs, "doc_id long, text string"), asked.limit(0), 3)) == []
