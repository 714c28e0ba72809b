"""Pivot search against all pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from evidara.llm import exact, queries

FOLDER = "/root/testdata/sf0.01"


def brute(rows, ask, k):
    """(query, rank, id, score) by plain loops; rows: id -> integers."""
    out = set()
    for q in filter(ask, rows):
        scored = sorted((-sum(a * b for a, b in zip(rows[q], v, strict=False)), i) for i, v in rows.items() if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def answer(df):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()]


def test_whole_table(spark):
    rows = {r.vec_id: [math.floor(256 * float(x)) for x in r.embedding] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    made = answer(queries.op9_exact_top_k(spark, FOLDER))
    assert set(made) == brute(rows, lambda i: i % 50 == 0, 5) and len(made) == len(set(made))


def test_small_blocks_and_early_stop(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK", 60)
    monkeypatch.setattr(exact, "QUERY_BLOCK", 7)
    random = np.random.default_rng(2)
    centres = random.integers(-500, 500, (6, 3))
    rows = {i: (centres[i % 6] + random.integers(-9, 9, 3)).tolist() for i in range(700)}
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id long, v array<long>")
    made = answer(exact.top_k(df, F.col("vec_id") % 10 == 0, 4))
    assert set(made) == brute(rows, lambda i: i % 10 == 0, 4) and len(made) == len(set(made))


def test_bound_is_a_bound_and_stops_early():
    random = np.random.default_rng(4)
    rows = np.concatenate([random.integers(-20, 20, (4000, 3)), random.integers(900, 1000, (1000, 3))])
    pivots = exact.choose_pivots(rows[:200])
    table = exact.distances(rows, pivots)
    apart = np.abs(table[:50, None, :] - table[None]).max(-1)
    assert (apart <= np.linalg.norm((rows[:50, None] - rows[None]).astype(float), axis=-1) + 1e-6).all()


def test_odd_inputs(spark):
    big = 3.0e6
    rows = [
        (0, [1.0, 2.0], "a"), (0, [0.5, 9.0], "a"), (50, None, "a"), (100, [1.0, None], "a"), (150, [float("nan"), 1.0], "a"),
        (200, [float("inf"), 1.0], "a"), (None, [1.0, 1.0], "a"), (7, [0.0, 0.0], "a"), (8, [0.0, 0.0], "a"), (9, [2.0], "a"),
        (10, [], "a"), (250, [big, -big, 1.0], "a"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    held = exact.quantised(df)
    want = {0: [128, 2304], 7: [0, 0], 8: [0, 0], 9: [512], 10: [], 250: [768000000, -768000000, 256]}
    assert {r.vec_id: r.v for r in held.collect()} == want
    made = answer(exact.top_k(held, F.col("vec_id") % 50 == 0, 5))
    padded = {i: v + [0] * (3 - len(v)) for i, v in want.items()}
    assert set(made) == brute(padded, lambda i: i % 50 == 0, 5) and len(made) == 10
    assert answer(exact.top_k(held.limit(0), F.col("vec_id") % 50 == 0, 5)) == []
    assert answer(exact.top_k(held.where("vec_id = 0"), F.col("vec_id") % 50 == 0, 5)) == []
