"""Multiprobe hashing: recall against brute force, exact scores, order of probes, odd inputs."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from evidara.llm import nearest, queries


def brute(ids, rows, ask, k):
    out = {}
    for i in np.flatnonzero(ask(ids)):
        score = (rows * rows[i]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def answer(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def recall(made, want):
    return np.mean([len({i for i, _ in made.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def frame(spark, rows):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, x array<double>")


def test_recall_and_scores_on_given_vectors(spark):
    folder = "/root/testdata/sf0.1"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in given])
    rows = np.array([r.embedding for r in given], float)
    made = answer(queries.op4_nearest(spark, folder))
    want = brute(ids, rows, lambda i: i % 20 == 0, 20)
    assert made.keys() == want.keys() and all(len(v) == 20 for v in made.values())
    at = {i: r for i, r in zip(ids, rows, strict=True)}
    for q, own in made.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in own}
        assert all(abs(s - at[q] @ at[i]) < 1e-12 for i, s in own)
    assert recall(made, want) >= 0.95, recall(made, want)


def test_copies_hot_buckets_and_norms(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BUCKET", 50)
    monkeypatch.setattr(nearest, "CELL", 200)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 10)
    random = np.random.default_rng(8)
    rows = random.normal(size=(900, 6)) * random.random((900, 1)) * 5
    rows[100:400] = rows[100]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, x array<double>")
    made = answer(nearest.top_k(df, F.col("vec_id") % 20 == 0, 5, probes=81))
    want = brute(np.arange(900), rows, lambda i: i % 20 == 0, 5)
    assert recall(made, want) >= 0.95
    for q in (100, 200):
        if {i for i, _ in want[q]} <= set(range(100, 400)):
            assert [i for i, _ in made[q]] == [i for i, _ in want[q]]


def test_probes_come_in_order_of_success():
    place = np.array([0.2, 0.9, 0.5])
    made = nearest.perturbations(place, 27)
    cost = lambda m: sum((p if x < 0 else 1 - p) ** 2 for p, x in zip(place, m, strict=True) if x)
    assert len(set(made)) == 27 and set(made) == set(product((-1, 0, 1), repeat=3))
    assert [cost(m) for m in made] == sorted(cost(m) for m in made)


def test_odd_inputs(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [0.5, 9.0], 1), (20, None, 1), (40, [1.0, None], 1), (60, [float("nan"), 1.0], 1),
        (80, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (7, [3.0], 1), (8, [3.0, 0.0], 1), (100, [], 1), (120, [float("-inf"), 1.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    held = nearest.usable(df)
    assert sorted(r.vec_id for r in held.collect()) == [0, 7, 8]
    made = answer(nearest.top_k(held, F.col("vec_id") % 20 == 0, 5, probes=81))
    assert made == {0: [(7, 1.5), (8, 1.5)]}
    assert answer(nearest.top_k(held.limit(0), F.col("vec_id") % 20 == 0, 5)) == {}


def test_no_query_is_short_with_registered_parameters(spark):
    random = np.random.default_rng(3)
    few = random.normal(size=(15, 8))
    few /= np.linalg.norm(few, axis=1)[:, None]
    made = answer(nearest.top_k(frame(spark, few), F.col("vec_id") >= 0, 20))
    assert {q: [i for i, _ in own] for q, own in made.items()} == {
        q: [i for i, _ in own] for q, own in brute(np.arange(15), few, lambda i: i >= 0, 20).items()
    }


def test_norms_with_registered_parameters(spark):
    random = np.random.default_rng(4)
    unit = random.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for norm in (np.where(np.arange(4000) == 7, 50.0, 1.0), np.exp(random.normal(size=4000) * 0.5)):
        rows = unit * norm[:, None]
        made = answer(nearest.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20))
        want = brute(np.arange(4000), rows, lambda i: i % 20 == 0, 20)
        assert made.keys() == want.keys() and all(len(v) == 20 for v in made.values())
        assert recall(made, want) >= 0.93, recall(made, want)
