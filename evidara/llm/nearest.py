"""Approximate nearest neighbours by multiprobe p-stable hashing, for the largest inner product.

A search for the largest inner product is a search for the nearest point once every vector gets
one more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query is scaled to norm M.
Vectors are hashed in ranges of norms (a factor of ``RANGE`` each) with an M of their own, scaled to
M = 1; so a query has the same buckets in all ranges, and few long vectors do not crowd the others.
``TABLES`` tables of ``HASHES`` functions floor((a.x + b) / w) with Gaussian ``a`` hold every
vector once each.  A query visits ``PROBES`` buckets a table: its own, then those with some
functions moved by one cell, in the order of estimated success (the sum of squared distances to
the cell walls crossed).  Candidates of all tables are merged and ranked by their exact score.
A query that meets fewer than k vectors in its buckets, though there are more, is held against all.

A bucket of more than ``BUCKET`` vectors is cut into parts by a hash of the id, and all parts
are searched, so a third of all rows in one bucket are many tasks.  Buckets travel in cells of
bounded size; queries meet a cell only if they probe a bucket in it, in bounded groups.

On vectors without structure nearness says little and the 0.9 recall asked for costs a large
share of the table (README has the figures); tables, functions and probes are parameters.

Defined results: rows with a null id, and vectors that are null, zero, or hold a null or
non-finite component take no part; a shorter vector counts as filled up with zeros; of repeated
ids the smallest vector counts; equal scores go to the smaller id; only a table of fewer than
k + 1 vectors gives fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.base import settle, sized
from evidara.llm.exact import finite, matrix

TABLES, HASHES, PROBES, WIDTH, SEED = 3, 4, 40, 1.5, 7
RANGE = 2**0.5
BUCKET, CELL, QUERY_BLOCK = 4096, 16_384, 2048


@dataclass(frozen=True)
class Hashing:
    """The functions of all tables; ``reach`` is the largest norm of all ranges."""

    a: np.ndarray  # tables x dimensions + 1 x functions
    b: np.ndarray  # tables x functions, in units of M
    w: float
    reach: float
    mix: np.ndarray  # odd multipliers that make one number of a bucket's cells

    @staticmethod
    def make(width: int, reach: float, tables: int, hashes: int, cell: float) -> Hashing:
        random = np.random.default_rng(SEED)
        a = random.normal(size=(tables, width + 1, hashes))
        mix = random.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return Hashing(a, random.random((tables, hashes)) * cell, cell, reach, mix)

    def project(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """Places in units of a cell: tables x rows x functions."""
        norm = np.sqrt((rows**2).sum(1))
        if query:
            rows, last = rows / norm[:, None], np.zeros(len(rows))
        else:
            most = self.reach * RANGE ** -np.floor(np.log(self.reach / norm) / np.log(RANGE))
            rows, last = rows / most[:, None], np.sqrt(np.maximum(1 - (norm / most) ** 2, 0))
        full = np.concatenate([rows, last[:, None]], axis=1)
        return (np.einsum("nd,tdh->tnh", full, self.a) + self.b[:, None]) / self.w

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a bucket (last axis)."""
        with np.errstate(over="ignore"):
            mixed = ((cells.astype(np.int64).view(np.uint64) + np.uint64(1 << 20)) * self.mix).sum(-1, dtype=np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return mixed.view(np.int64)


def perturbations(place: np.ndarray, probes: int) -> list[tuple[int, ...]]:
    """Moves of the functions (-1, 0, 1 each) in the order of estimated success.

    ``place`` is the position inside the cell, 0 to 1, of each function.  A heap makes the next
    set from the best one by replacing or adding a wall, so no set is scored in vain.
    """
    walls = sorted([(p * p, j, -1) for j, p in enumerate(place)] + [((1 - p) ** 2, j, 1) for j, p in enumerate(place)])
    out = [(0,) * len(place)]
    heap = [(walls[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if len({walls[i][1] for i in chosen}) == len(chosen):
            move = [0] * len(place)
            for i in chosen:
                move[walls[i][1]] = walls[i][2]
            out.append(tuple(move))
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (cost - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + walls[last + 1][0], (*chosen, last + 1)))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding -> vec_id, x (doubles) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    )
    return rows.groupBy("vec_id").agg(F.min(F.transform("embedding", lambda x: x.cast("double"))).alias("x"))


def search_cell(
    query: np.ndarray, query_ids: np.ndarray, probed: list[np.ndarray],
    rows: np.ndarray, ids: np.ndarray, buckets: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids and scores: up to k for each query among the rows of its buckets."""
    order = np.lexsort((ids, buckets))
    rows, ids, buckets = rows[order], ids[order], buckets[order]
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    stops = np.concatenate((starts[1:], [len(buckets)]))
    asks = np.repeat(np.arange(len(query)), [len(p) for p in probed])
    wanted = np.concatenate(probed) if len(probed) else np.zeros(0, np.int64)
    by = np.argsort(wanted, kind="stable")
    wanted, asks = wanted[by], asks[by]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low, high in zip(starts, stops, strict=True):
        left, right = np.searchsorted(wanted, [buckets[low], buckets[low] + 1]) if buckets[low] < 2**63 - 1 else (np.searchsorted(wanted, buckets[low]), len(wanted))
        own = asks[left:right]
        if not len(own):
            continue
        block, block_ids = rows[low:high], ids[low:high]
        # Of equal vectors only the first k + 1 ids can be in an answer.
        _, same = np.unique(block, axis=0, return_inverse=True)
        turn = np.argsort(same.ravel(), kind="stable")
        run = same.ravel()[turn]
        nth = np.arange(len(run)) - np.searchsorted(run, run)
        stay = np.sort(turn[nth <= k])
        block, block_ids = block[stay], block_ids[stay]
        for part in np.array_split(own, -(-len(own) // 256)):
            score = query[part] @ block.T
            score[query_ids[part][:, None] == block_ids[None]] = -np.inf
            if score.shape[1] > k:
                least = np.partition(score, -k, axis=1)[:, -k]
            else:
                least = np.full(len(part), -np.inf)
            # Ties within rounding come along; the exact sum below decides.
            slack = 1e-12 * (np.abs(query[part]).sum(1) * np.abs(block).max())
            q, r = np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))
            exact = (query[part[q]] * block[r]).sum(1)
            found.append((part[q], block_ids[r], exact))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return query_ids[q[keep]], i[keep], s[keep]


def top_k(
    vectors: DataFrame, queries: Column, k: int,
    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, cell: float = WIDTH,
) -> DataFrame:
    """vec_id, x -> query_id, rank, vec_id, score for the rows that ``queries`` (a filter) picks."""
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    facts = vectors.agg(F.max(F.size("x")), F.max(norm), F.count("*"), F.count_if(queries)).first()
    width, reach, total, asked_for = facts[0] or 1, facts[1] or 1.0, facts[2], facts[3]
    hashing = Hashing.make(width, reach, tables, hashes, cell)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1), width, float)
            places = np.floor(hashing.project(rows, False))
            for table in range(tables):
                made = [pa.array(np.full(len(rows), table, np.int32)), pa.array(hashing.bucket(places[table]))]
                yield pa.RecordBatch.from_arrays([*made, *batch.columns], ["t", "bucket", "vec_id", "x"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = hashing.project(matrix(batch.column(1), width, float), True)
            cells = np.floor(places)
            for table in range(tables):
                lists = [
                    hashing.bucket(home + np.array(perturbations(place - home, probes), float))
                    for home, place in zip(cells[table], places[table], strict=True)
                ]
                made = [batch.column(0), pa.array(np.full(len(lists), table, np.int32)), pa.array([list(x) for x in lists], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, ["query_id", "t", "buckets"])

    stored = vectors.mapInArrow(index, "t int, bucket long, vec_id long, x array<double>")
    sizes = settle(stored.groupBy("t", "bucket").agg(F.count("*").alias("n")))
    cells, query_blocks = sized(total, CELL), sized(asked_for, QUERY_BLOCK)
    # Small buckets share cells; a large one has cells of its own, one for each part.
    parts = F.when(F.col("n") > BUCKET, F.ceil(F.col("n") / BUCKET).cast("int")).otherwise(1)
    sizes = sizes.select("t", "bucket", parts.alias("parts"))
    shared = F.pmod(F.xxhash64("bucket"), F.lit(cells))
    owned = lambda part: -1 - F.abs(F.shiftrightunsigned(F.xxhash64("bucket", part), 2))
    large = sizes.where("parts > 1")
    placed = stored.join(large, ["t", "bucket"], "left")
    own_part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    placed = placed.withColumn("cell", F.when(F.col("parts") > 1, owned(own_part)).otherwise(shared))
    placed = placed.select("t", "cell", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"), "bucket", "vec_id", "x")

    asked = vectors.where(queries)
    probed = asked.mapInArrow(probe, "query_id long, t int, buckets array<long>")
    wanted = probed.select("query_id", "t", F.explode("buckets").alias("bucket")).join(sizes, ["t", "bucket"])
    wanted = wanted.select("query_id", "t", "bucket", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = wanted.withColumn("cell", F.when(F.col("parts") > 1, owned(F.col("part"))).otherwise(shared))
    # At most ``probes`` buckets a query and table.
    wanted = wanted.groupBy("query_id", "t", "cell").agg(F.collect_set("bucket").alias("buckets"))
    wanted = wanted.join(asked.select(F.col("vec_id").alias("query_id"), "x"), "query_id")
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            found = search_cell(
                matrix(left.column("x"), width, float), left.column("query_id").to_numpy(),
                [np.array(x, np.int64) for x in left.column("buckets").to_pylist()],
                matrix(right.column("x"), width, float), right.column("vec_id").to_numpy(), right.column("bucket").to_numpy(), k,
            )
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ("t", "cell", "block")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        rows = merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return rows.select("query_id", "rank", "vec_id", "score")

    probed_best = settle(ranked(met(wanted, placed)))
    full = probed_best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    short = asked.select(F.col("vec_id").alias("query_id"), "x").join(full, "query_id", "left_anti")
    short_count = short.count()
    if not short_count:
        return probed_best
    # All rows, dealt into blocks, against the blocks of these queries.
    short_blocks = sized(short_count, QUERY_BLOCK)
    one = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket")]
    block = F.pmod(F.xxhash64("query_id"), F.lit(short_blocks)).cast("int").alias("block")
    cell = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    left = short.select("query_id", "x", one[0], block, F.array(one[1]).alias("buckets"), cell)
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int").alias("cell")
    # Columns of their own: both sides come from one table.
    both = [F.col(c).alias(c) for c in ("vec_id", "x")]
    right = vectors.select(*one, dealt, *both, F.explode(F.sequence(F.lit(0), F.lit(short_blocks - 1))).alias("block"))
    filled = ranked(met(left, right))
    return probed_best.join(short.select("query_id"), "query_id", "left_anti").select(*filled.columns).unionByName(filled)
