"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into numbers (shares of character classes, word and line
repetition, lengths).  The trees are grown by histograms over quantile bins on at most
``SAMPLE`` labelled rows (chosen by a hash of the id, so the same rows at any layout) and are
flattened into arrays; scoring walks all trees for a batch of rows at once in numpy.

Defined results: a null or empty text has all statistics zero and gets a score like any other;
with no labelled row, or labels of one class only, every score is that class's share (0.5 for
none).  Repeated label rows of a document count once (the larger label).  Labels, language,
source and id are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.base import bucket_of, numbered

SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST = 48, 80, 4, 0.15, 30.0

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_STOPS = b".,;:"
_MARKS = b"!?#$%&*|=+<>/\\@^~_{}[]()\"'"
_REPEATED = re.compile(r"([^\w\s])\1")

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "longest_word", "upper", "lower", "digit", "high", "stops",
    "marks", "bang", "pipe", "percent", "hash", "distinct_words", "distinct_pairs", "top_word", "distinct_lines",
    "line_words", "ending_marks", "doubled_marks", "upper_words", "squeeze", "word_spread",
)


def statistics(text: str) -> list[float]:
    if not text or text.isspace():
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "replace")
    size = len(data)
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    share = lambda chars: (size - len(data.translate(None, chars))) / size
    count, n = Counter(words), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(np.log1p(len(lines))), float(lengths.mean()),
        float(np.log1p(lengths.max())), share(_UPPER), share(_LOWER), share(_DIGIT), share(_HIGH), share(_STOPS),
        share(_MARKS), data.count(b"!") / n, data.count(b"|") / n, data.count(b"%") / n, data.count(b"#") / n,
        len(count) / n, pairs / n, max(count.values()) / n, len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)), sum(not w[-1].isalnum() for w in words) / n, len(_REPEATED.findall(text)) / n,
        sum(map(str.isupper, words)) / n, len(zlib.compress(data, 1)) / size, float(lengths.std()),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth as arrays: per tree 2^depth - 1 splits and 2^depth leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        if not len(rows) or not len(self.feature):
            return total
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for tree in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            while at[0] < inner:
                at = 2 * at + 1 + (rows[every, self.feature[tree, at]] > self.threshold[tree, at])
            total += self.leaf[tree, at - inner]
        return total

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -500, 500)))


def grow(rows: np.ndarray, label: np.ndarray) -> Forest:
    """Boost trees on the logistic loss; split gains come from per-bin sums of gradients."""
    empty = Forest(0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    if not len(label):
        return empty
    rate = label.mean()
    if rate in (0.0, 1.0):
        return Forest(500.0 if rate else -500.0, empty.feature, empty.threshold, empty.leaf)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T, strict=True)], axis=1)
    inner, features = 2**DEPTH - 1, rows.shape[1]
    forest_f = np.zeros((TREES, inner), np.int64)
    forest_t = np.full((TREES, inner), np.inf)
    forest_l = np.zeros((TREES, inner + 1))
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(len(label), base)
    for tree in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = chance - label, chance * (1 - chance)
        at = np.zeros(len(label), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f in range(features):
                key = (at - first) * BINS + binned[:, f]
                g = np.bincount(key, slope, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                h = np.bincount(key, bend, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(h < LEAST / 4) | (all_h - h < LEAST / 4)] = 0
                gain = gain[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                top = gain[np.arange(nodes), cut]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    forest_f[tree, first + node] = f
                    forest_t[tree, first + node] = edges[f][cut[node]]
            at = 2 * at + 1 + (rows[np.arange(len(at)), forest_f[tree, at]] > forest_t[tree, at])
        g = np.bincount(at - inner, slope, inner + 1)
        h = np.bincount(at - inner, bend, inner + 1)
        forest_l[tree] = -RATE * g / (h + 1)
        margin += forest_l[tree, at - inner]
    return Forest(base, forest_f, forest_t, forest_l)


def fit(docs: DataFrame, labels: DataFrame, train: Callable | None = None, sample: int = SAMPLE) -> Forest:
    """Learn from at most ``sample`` labelled documents; ``train`` maps the id column to a filter."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if train is not None:
        known = known.where(train(F.col("doc_id")))
    # The hint is bounded by ``sample`` rows of two numbers.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "quality", "x"]
            )

    table = rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(
        run, "doc_id long, quality int, x array<double>"
    ).toArrow()
    if not table.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    x = np.array(table.column("x").to_pylist(), float)[order]
    return grow(x, table.column("quality").to_numpy()[order].astype(float))


def _add_score(forest: Forest, schema_names: list[str], place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(text or "") for text in batch.column(place).to_pylist()]
            x = np.array(made, float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], names=schema_names)

    return run


def scored(docs: DataFrame, forest: Forest, column: str = "_quality_score") -> DataFrame:
    """``docs`` with the score of each whole text added as ``column``."""
    names = [*docs.columns, column]
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return numbered(docs).mapInArrow(_add_score(forest, names, docs.columns.index("text")), schema)


def held_out(doc_id) -> object:
    """Rows whose labels are never learned from."""
    return bucket_of(doc_id, 3) == 1
