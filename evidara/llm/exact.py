"""Exact top-k by inner product with pivot tables.

A table holds the distance of every vector to some pivots.  By the triangle inequality the
largest difference |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), hence an
upper bound of the inner product: (|q|^2 + |x|^2 - bound^2) / 2.  Within a block of candidates
a query looks at them in the order of that bound and stops where no later one can enter its k
best.  Each query carries a floor from the start: its k-th best score in a bounded sample.

The stated queries meet all rows block by block: (candidate block, query block) is the key of a
co-group, both blocks bounded, and only k rows a query leave a block.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no
part; a shorter vector counts as filled up with zeros; of repeated ids the smallest vector
counts; equal scores go to the smaller id; with fewer candidates than k all are returned; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.base import sized

PIVOTS, SAMPLE = 24, 256
BLOCK, QUERY_BLOCK = 8192, 2048
STEP, ROWS = 512, 256


def finite(vector: Column) -> Column:
    """The vector has no null and no non-finite component."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, embedding -> vec_id, v with integer components floor(scale * x)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & finite(F.col("embedding"))
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """A list column as rows of ``width``; shorter lists are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind, copy=False)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each pivot is the sample row farthest from those before it."""
    if not len(sample):
        return sample[:0]
    rows = sample.astype(float)
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    r, p = rows.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((r**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * r @ p.T, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(
    query: np.ndarray, query_ids: np.ndarray, query_table: np.ndarray, floor: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, table: np.ndarray, k: int,
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, ids, scores) of the k best of the block that reach the query's floor."""
    out = []
    norm = (rows.astype(float) ** 2).sum(1)
    # Sums stay exact in doubles for all but huge components; those go through integers.
    reach = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * rows.shape[1]
    x = rows.astype(float) if reach < 2**52 else rows
    for low in range(0, len(query), ROWS):
        part = slice(low, min(low + ROWS, len(query)))
        apart = np.zeros((part.stop - low, len(rows)))
        for pivot in range(table.shape[1]):
            np.maximum(apart, np.abs(query_table[part, pivot, None] - table[None, :, pivot]), out=apart)
        own = (query[part].astype(float) ** 2).sum(1)[:, None] + norm[None]
        bound = (own - apart**2) / 2 + 1e-7 * (own + 1)
        order = np.argsort(-bound, axis=1)
        for i in range(part.stop - low):
            at, least = low + i, floor[low + i]
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
            vector = query[at].astype(x.dtype)
            for step in range(0, len(rows), STEP):
                chosen = order[i, step : step + STEP]
                if bound[i, chosen[0]] < least:
                    break
                score = (x[chosen] @ vector).astype(np.int64)
                fit = (score >= least) & (ids[chosen] != query_ids[at])
                best_ids = np.concatenate([best_ids, ids[chosen[fit]]])
                best = np.concatenate([best, score[fit]])
                top = _best(best, best_ids, k)
                best_ids, best = best_ids[top], best[top]
                if len(best) == k:
                    least = max(least, best[-1])
            if len(best):
                out.append((at, best_ids, best))
    return out


def top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """vec_id, v -> query_id, rank, vec_id, score for the rows that ``queries`` (a filter) picks."""
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    # A bounded sample, the same at any layout: for the pivots and for the floors.
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids = sample.column("vec_id").to_numpy()
    sample_rows = matrix(sample.column("v"), width)
    pivots = choose_pivots(sample_rows)

    def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1), width)
            table = distances(rows, pivots)
            made = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), table.shape[1]) if table.shape[1] else None
            made = made.cast(pa.list_(pa.float64())) if made is not None else pa.array([[]] * len(rows), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["vec_id", "v", "d"])

    def with_floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in annotate(batches):
            rows, ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
            score = rows @ sample_rows.T
            score[ids[:, None] == sample_ids[None]] = np.iinfo(np.int64).min
            score = np.sort(score, axis=1)
            floor = score[:, -k] if score.shape[1] >= k else np.full(len(rows), np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], ["vec_id", "v", "d", "floor"])

    counts = vectors.agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).first()
    blocks, query_blocks = sized(counts["n"], BLOCK), sized(counts["q"], QUERY_BLOCK)
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = vectors.mapInArrow(annotate, "vec_id long, v array<long>, d array<double>")
    stored = stored.withColumn("block", part(blocks, 1)).withColumn("query_block", every(query_blocks))
    asked = vectors.where(queries).mapInArrow(with_floor, "vec_id long, v array<long>, d array<double>, floor long")
    asked = asked.withColumn("query_block", part(query_blocks, 2)).withColumn("block", every(blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            found = search_block(
                matrix(left.column("v"), width), left.column("vec_id").to_numpy(),
                matrix(left.column("d"), len(pivots), float), left.column("floor").to_numpy(),
                matrix(right.column("v"), width), ids, matrix(right.column("d"), len(pivots), float), k,
            )
        query_ids = left.column("vec_id").to_numpy()
        empty = [np.zeros(0, np.int64)]
        return pa.table(
            {
                "query_id": np.concatenate(empty + [np.full(len(i), query_ids[at]) for at, i, _ in found]),
                "vec_id": np.concatenate(empty + [i for _, i, _ in found]),
                "score": np.concatenate(empty + [s for _, _, s in found]),
            }
        )

    keys = ("block", "query_block")
    met = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
