"""Boosted trees: held-out accuracy, traversal against a plain walk, odd inputs."""

from __future__ import annotations

import numpy as np

from evidara.llm import quality, queries

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    made = queries.op6_quality_classifier(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    rows = made.where("held_out").join(labels, "doc_id").collect()
    assert made.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(rows) > 1000 and right > 0.85, right


def test_flattened_walk_equals_plain_walk():
    random = np.random.default_rng(3)
    rows = random.random((600, 4))
    label = ((rows[:, 0] > 0.4) ^ (rows[:, 2] > 0.7)).astype(float)
    forest = quality.grow(rows, label)
    assert ((forest.score(rows) > 0.5) == label).mean() > 0.97
    for row, margin in list(zip(rows, forest.margin(rows), strict=True))[:50]:
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + bool(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert abs(total - margin) < 1e-9


def test_odd_inputs(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", "x"), (1, "good words here", "x"), (2, None, "x"), (3, "", "y"), (None, "z " * 200_000, "y")],
        "doc_id long, text string, quality string",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    forest = quality.fit(docs, labels)
    made = quality.scored(docs, forest).collect()
    assert len(made) == 5 and all(r._quality_score > 0.99 for r in made)
    none = quality.scored(docs, quality.fit(docs, labels.limit(0))).collect()
    assert {r._quality_score for r in none} == {0.5}
    assert quality.scored(docs.limit(0), forest).collect() == []


def test_labels_do_not_touch_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    keep = lambda doc_id: ~quality.held_out(doc_id)
    a, b = quality.fit(docs, labels, keep), quality.fit(docs, turned, keep)
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.feature, b.feature)
