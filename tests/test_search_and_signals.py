"""Retrieval and reading checks against brute force and the known sample results."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidara.functions import vocab as V
from evidara.operators import scorecard as C
from evidara.operators import search, signals


def python_lexical(chunks, query, k):
    tok = lambda x: re.findall(V.TOKEN, x.lower())
    terms = [t for t in tok(query) if t not in V.RETRIEVAL_STOP_WORDS] or tok(query)
    toks = {c[0]: tok(c[4]) for c in chunks}
    df = {}
    for words in toks.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((len(chunks) + 1) / (n + 1)) + 1 for w, n in df.items()}
    out = []
    for cid, document, page, index, _ in chunks:
        score, words = 0.0, toks[cid]
        for t in terms:
            if t in words:
                score += (1 + math.log(words.count(t))) * idf[t]
            if t in tok(document):
                score += 0.5 * idf.get(t, 1.0)
            if re.fullmatch(r"[a-z]{1,8}-\d+[a-z0-9-]*|\d+(?:\.\d+)?", t) and t in words:
                score += 2.0
        pairs = set(zip(words, words[1:]))
        score += 1.25 * sum(p in pairs for p in zip(terms, terms[1:])) if len(terms) > 1 else 0
        if score > 0:
            out.append((-round(score, 6), document, page, index, cid))
    return [(x[4], -x[0]) for x in sorted(out)[:k]]


def test_lexical_matches_brute_force(spark):
    rng = random.Random(4)
    words = ["pump", "p-101", "seal", "the", "leak", "7.5", "bearing", "oil", "report"]
    chunks = [(f"c{i}", rng.choice(["pump-log.txt", "oil.txt"]), rng.randint(1, 3), i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    asked = {1: "What is the pump p-101 seal leak leak", 2: "the of", 3: "oil 7.5 txt", 4: "unknown"}
    df = spark.createDataFrame(chunks, "chunk_id string, document string, page int, chunk_index int, text string")
    q = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    got: dict = {}
    for r in search.lexical_top_k(df, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for key, text in asked.items():
        want = python_lexical(chunks, text, 5)
        assert [c for c, _ in got.get(key, [])] == [c for c, _ in want]
        assert [s for _, s in got.get(key, [])] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("size", [8192, 7])
def test_cosine_in_blocks_matches_brute_force(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(900, [0.0] * 8), (901, None), (902, [1.0])]
    asked = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(5)]
    vectors = spark.createDataFrame(rows, "id int, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    got: dict = {}
    for r in search.cosine_top_k(vectors, queries, 4, query_block=2, slice_rows=size).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q, v in asked:
        score = {i: (float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x))) for i, x in rows[:200]}
        assert got[q] == [i for i, _ in sorted(score.items(), key=lambda p: (-p[1], p[0]))[:4]]


TREND = [("2030-01-01 00:00", 6.8), ("2030-01-01 06:00", 7.0), ("2030-01-02 00:00", 7.4), ("2030-01-03 00:00", 8.2)]


def test_known_trend_and_breaches(spark):
    df = spark.createDataFrame([("P-101", "Vibration", t, v) for t, v in TREND], "asset string, signal string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    breach = signals.threshold_breaches(df, ["asset", "signal"], "value", 7.0).first()
    assert (breach.breach_count, breach.peak_value) == (2, 8.2)
    trend = signals.rising_trends(df, ["asset", "signal"], "ts", "value").first()
    assert (trend.points, trend.increasing, trend.trend_delta) == (4, True, 1.4)
    falling = df.union(spark.createDataFrame([("P-101", "Vibration", "2030-01-04 00:00", 1.0)], "a string, s string, ts string, v double").withColumn("ts", F.to_timestamp("ts")))
    assert signals.rising_trends(falling, ["asset", "signal"], "ts", "value").first().increasing is False


def test_date_gap_and_stock(spark):
    text = spark.createDataFrame([("C-204", "Done 2030-01-10. Missing 2030-02-10. Done 2030-03-12.")], "asset string, text string")
    days = signals.dates_in_text(text, ["asset"]).where(F.col("day").isin("2030-01-10", "2030-03-12"))
    assert signals.last_interval(days, ["asset"], "day", ["pos"]).first().completed_gap_days == 61
    stock = spark.createDataFrame([(1, "seal", "P-101", 0.0, 2.0, "Stockout"), (2, "seal", "P-101", 9.0, 2.0, "OK")], "o int, part string, asset string, available_qty double, minimum_qty double, status string")
    assert signals.stock_checks(stock, ["part", "asset"], "o", "Stockout").first().stockout is True


def test_retrieval_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (1, "a", 1, 3)], "query_id int, file string, page int, rank int")
    refs = spark.createDataFrame([(1, "a", 1), (1, "c", 1)], "query_id int, file string, page int")
    limits = spark.createDataFrame([(1, 5), (2, 5)], "query_id int, k int")
    rows = {r.query_id: r for r in C.retrieval_metrics(ranked, refs, limits).collect()}
    dcg, ideal = 1 + 1 / math.log2(4), 1 + 1 / math.log2(3)
    assert tuple(rows[1])[1:] == (round(2 / 3, 4), round((1 + 2 / 3) / 2, 4), 0.5, 1.0, round(dcg / ideal, 4))
    assert tuple(rows[2])[1:] == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_present_terms(spark):
    texts = spark.createDataFrame([("Alpha  beta",), ("gamma",)], "text string")
    terms = spark.createDataFrame([(t,) for t in ("alpha BETA", "beta g", "gam", "zeta", "a", "q1", "q2", "q3")], "term string")
    assert {r.term for r in C.present_terms(texts, terms).collect()} == {"alpha BETA", "gam", "a"}


def test_gates(spark):
    metrics = spark.createDataFrame([(0.9, 12)], "score double, benchmark_check_count bigint")
    gates = spark.createDataFrame([("minimum_score", 0.95), ("minimum_check_count", 12.0), ("maximum_unknown", 1.0)], "name string, expected double")
    assert {r.name: r.passed for r in C.quality_gates(metrics, gates).collect()} == {"minimum_score": False, "minimum_check_count": True, "maximum_unknown": False}
