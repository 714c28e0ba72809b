"""A stored inverted index over retrieval chunks, and exact top-k search in it.

Chunks are read once, in blocks of about ``BLOCK_TOKENS`` tokens in the order of the scan, without a
shuffle.  A block is a row for each bucket of its terms and one row, without a bucket, for its chunks.  A bucket
holds, compressed, for each of its terms the positions in the block's tokens, in how many chunks it occurs and its greatest
frequency in a chunk.  Chunks that come later are further blocks of a new generation; weights follow from the sums over all blocks, so searching after an addition
equals searching a rebuilt index.

A search opens the buckets of its terms and takes what a bitmap of fixed size lets pass (all of its terms, and few others, which match
nothing).  It meets blocks and queries in bounded groups.  Inside a block the terms of a query are taken by
falling bound (the score the term can add, from its greatest frequency).  Once what is left to be added cannot lift an unseen chunk to
the k-th score, the remaining, common terms are looked up for the chunks seen so far only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evidara.functions import text as X
from evidara.functions import vocab as V
from evidara.functions.ordering import top_rows
from evidara.session import settle

BLOCK_TOKENS = 500_000
BUCKETS = 16
BITS = 23
QUERY_BLOCK = 1_000
CHUNK = ("chunk_id", "document", "page", "chunk_index")
# Scores are compared after rounding to six digits; bounds keep clear of that.
MARGIN = 1e-5


class Numbers(dict):
    """Term -> its number, in order of appearance."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


POSTINGS = ["term", "df", "max_tf", "positions"]
OPENED = "block string, term string, df long, max_tf int, positions array<int>"


def _packed(rows: pa.RecordBatch) -> bytes:
    """Rows of a bucket as one compressed value."""
    out = pa.BufferOutputStream()
    # Written from a table, so that a slice takes its own rows along only.
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows.take(pa.array(range(rows.num_rows))))
    return out.getvalue().to_pybytes()


def opened(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """block, term, df, max_tf, positions: the postings of the terms of ``vocabulary`` (and of few others)."""
    hashed = F.crc32(F.col("term").cast("binary"))
    place = hashed.bitwiseAND(F.lit((1 << BITS) - 1)).alias("p")
    rows = vocabulary.select(place, (hashed % BUCKETS).cast("int").alias("bucket"))
    made = rows.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bitmap = np.zeros((1 << BITS) // 8 + 8192, np.uint8)
    for row in made.collect():  # at most 2 ** BITS / 32768 + 1 pieces
        bitmap[row["b"] * 4096 : (row["b"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
    given = bitmap.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(given, np.uint8), bitorder="little")
        # Place 0 is the first bit, place p > 0 is bit p - 1 of what follows the first 32768.
        flags = bytes(np.concatenate([bits[:1], bits[32768 : 32768 + (1 << BITS)]]))
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()
                fit = [bool(flags[zlib.crc32(t.encode()) & ((1 << BITS) - 1)]) for t in own.column("term").to_pylist()]
                for part in own.filter(pa.array(fit, pa.bool_())).combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), *part.columns], ["block", *POSTINGS])

    return index.where(F.col("bucket").isin(buckets)).select("block", "terms").mapInArrow(run, OPENED)


def _schema(chunks: DataFrame, columns: Sequence[str]) -> T.StructType:
    own = T.StructType([T.StructField(c, chunks.schema[c].dataType) for c in columns])
    return T.StructType(
        [
            T.StructField("generation", T.IntegerType()), T.StructField("block", T.StringType()), T.StructField("bucket", T.IntegerType()),
            T.StructField("max_tf", T.IntegerType()), T.StructField("terms", T.BinaryType()),
            T.StructField("chunks", T.ArrayType(own)), T.StructField("starts", T.ArrayType(T.IntegerType())),
        ]
    )


def build(chunks: DataFrame, columns: Sequence[str] = CHUNK, text: str = "text", generation: int = 0) -> DataFrame:
    """Chunk columns and text -> the rows of the index.  A null text has no terms; equal rows are chunks of their own."""
    columns = list(columns)
    schema = _schema(chunks, columns)
    arrow = to_arrow_schema(schema)

    def block(name: str, rows: list[pa.RecordBatch], numbers: Numbers, codes: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        infos = pa.concat_arrays([pa.StructArray.from_arrays(r.columns[:-1], fields=list(arrow.field("chunks").type.value_type)) for r in rows])
        size = np.array(sizes, np.int64)
        # One place between neighbouring chunks is left free, so pairs of words never reach across.
        starts = np.cumsum(size + 1) - size - 1
        terms = list(numbers)
        bucket = np.array([zlib.crc32(t.encode()) % BUCKETS for t in terms], np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(terms), np.int64)
        rank[by_bucket] = np.arange(len(terms))
        code = rank[np.array(codes, np.int64)]
        chunk = np.repeat(np.arange(len(size)), size)
        order = np.argsort(code, kind="stable")
        position = (np.arange(len(code)) + chunk)[order].astype(np.int32)
        code, chunk = code[order], chunk[order]
        heads = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])][: len(code)])
        tf = np.diff(np.append(heads, len(code)))
        df = np.bincount(code[heads], minlength=len(terms))
        most = np.maximum.reduceat(tf, np.cumsum(df) - df).astype(np.int32) if len(terms) else tf
        ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(position))
        held = pa.RecordBatch.from_arrays([pa.array([terms[i] for i in by_bucket], pa.string()), pa.array(df, pa.int64()), pa.array(most, pa.int32()), lists], POSTINGS)
        borders = np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1))
        used = [n for n in range(BUCKETS) if borders[n] < borders[n + 1]]
        parts = [_packed(held.slice(borders[n], borders[n + 1] - borders[n])) for n in used]
        tops = [int(most[borders[n] : borders[n + 1]].max()) for n in used]
        n = len(used)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([generation] * (n + 1), pa.int32()), pa.array([name] * (n + 1), pa.string()), pa.array([*used, None], pa.int32()),
                pa.array([*tops, None], pa.int32()), pa.array([*parts, None], pa.binary()),
                pa.concat_arrays([pa.nulls(n, arrow.field("chunks").type), pa.ListArray.from_arrays(pa.array([0, len(infos)], pa.int32()), infos, type=arrow.field("chunks").type)]),
                pa.array([None] * n + [starts.astype(np.int32)], arrow.field("starts").type),
            ],
            schema=arrow,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, task, number = re.compile(V.TOKEN).findall, TaskContext.get().partitionId(), 0
        rows, numbers, codes, sizes = [], Numbers(), [], []
        for batch in batches:
            low = 0
            for at, lower in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = find(lower or "")
                codes.extend([numbers[t] for t in own])
                sizes.append(len(own))
                if len(codes) + len(sizes) >= BLOCK_TOKENS:
                    rows.append(batch.slice(low, at + 1 - low))
                    yield from block(f"{generation}-{task}-{number}", rows, numbers, codes, sizes)
                    number, low, rows, numbers, codes, sizes = number + 1, at + 1, [], Numbers(), [], []
            if low < batch.num_rows:
                rows.append(batch.slice(low))
        if sizes:
            yield from block(f"{generation}-{task}-{number}", rows, numbers, codes, sizes)

    return chunks.select(*columns, F.lower(text).alias("_lower")).mapInArrow(run, schema)


def create(chunks: DataFrame, path: str, columns: Sequence[str] = CHUNK) -> None:
    """Write the index of ``chunks`` to a new folder."""
    build(chunks, columns).write.parquet(path)


def add(chunks: DataFrame, path: str, columns: Sequence[str] = CHUNK) -> None:
    """Index further chunks as a new generation beside the stored ones."""
    spark = chunks.sparkSession
    last = spark.read.parquet(path).where("bucket IS NULL").agg(F.max("generation")).first()[0]
    build(chunks, columns, generation=0 if last is None else last + 1).write.mode("append").parquet(path)


def inverse_document_frequencies(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, df, idf) over all blocks for the terms of ``vocabulary`` that occur."""
    total = index.where("bucket IS NULL").agg(F.coalesce(F.sum(F.size("chunks")), F.lit(0))).scalar()
    wanted = vocabulary.select("term").distinct()
    summed = opened(index, wanted).groupBy("term").agg(F.sum("df").alias("df")).join(wanted, "term", "left_semi")
    return summed.select("term", "df", (F.log((total + 1) / (F.col("df") + 1)) + 1).alias("idf"))


class Block:
    """The rows of one block, ready to be searched."""

    def __init__(self, table: pa.Table, columns: Sequence[str]) -> None:
        names = table.column("term").to_pylist()
        self.positions, self.most, self.found = {}, {}, {}
        for row, (name, most) in enumerate(zip(names, table.column("max_tf").to_pylist(), strict=True)):
            if name is None:
                self.rows = table.column("chunks")[row].as_py()
                self.starts = table.column("starts")[row].values.to_numpy()
            else:
                self.positions[name] = table.column("positions")[row].values.to_numpy()
                self.most[name] = most
        self.columns = list(columns)
        documents = [r[self.columns[1]] for r in self.rows]
        self.names = sorted({d for d in documents if d is not None})
        place = {d: n for n, d in enumerate(self.names)}
        self.document = np.array([place.get(d, -1) for d in documents], np.int64)
        self.words = [set(re.findall(V.TOKEN, d.lower())) for d in self.names]

    def term(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that hold the term, and how often."""
        if name not in self.found:
            chunk = np.searchsorted(self.starts, self.positions[name], side="right") - 1
            heads = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            self.found[name] = chunk[heads], np.diff(np.append(heads, len(chunk)))
        return self.found[name]

    def pair(self, left: str, right: str) -> np.ndarray:
        """Chunks in which the second term follows the first."""
        if (left, right) in self.found:
            return self.found[left, right]
        after, other = self.positions[left] + 1, self.positions[right]
        at = np.minimum(np.searchsorted(other, after), len(other) - 1)
        chunk = np.searchsorted(self.starts, self.positions[left][other[at] == after], side="right") - 1
        found = self.found[left, right] = chunk[np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)]]
        return found

    def search(self, words: dict[str, tuple[float, float, float]], pairs: list[tuple[str, str, float]], k: int) -> list[tuple[int, float]]:
        """(chunk, score) of the k best; words: term -> (weight, idf, what an identifier adds)."""
        named = np.array([sum(V.FILENAME_WEIGHT * w * idf for t, (w, idf, _) in words.items() if t in own) for own in self.words] + [0.0])
        scores = named[self.document]
        seen = scores > 0
        held = {t: w * ((1 + math.log(self.most[t])) * idf + more) for t, (w, idf, more) in words.items() if t in self.positions}
        order = sorted(held, key=lambda t: (-held[t], t))
        together = [(a, b, V.BIGRAM_WEIGHT * n) for a, b, n in pairs if a in held and b in held]
        left, rest = sum(held.values()), set(order)
        open_ = True  # can an unseen chunk still come in?
        for t in order:
            if open_ and left < scores.max(initial=0.0):
                bound = left + sum(n for a, b, n in together if a in rest and b in rest)
                # Fewer than k scores above the bound: an unseen chunk may still come in.
                open_ = np.count_nonzero(scores > bound + MARGIN) < k
            weight, idf, more = words[t]
            chunk, tf = self.term(t)
            if not open_:
                fit = seen[chunk]
                chunk, tf = chunk[fit], tf[fit]
            scores[chunk] += weight * ((1 + np.log(tf)) * idf + more)
            seen[chunk] = True
            left -= held[t]
            rest.discard(t)
        for a, b, n in together:
            chunk = self.pair(a, b)
            scores[chunk[seen[chunk]]] += n
        at = np.flatnonzero(seen)
        rounded = np.round(scores[at], 6)
        if len(at) > k:
            fit = rounded >= np.partition(rounded, len(at) - k)[len(at) - k]
            at, rounded = at[fit], rounded[fit]
        ranked = sorted(zip(at.tolist(), rounded.tolist(), strict=True), key=lambda p: (-p[1], *(_key(self.rows[p[0]][c]) for c in self.columns[1:])))
        return [p for p in ranked[:k] if p[1] > 0]


def _key(value) -> tuple:
    return (value is not None, value if value is not None else 0)


def top_k(index: DataFrame, queries: DataFrame, k: int, query_key: str = "query_id") -> DataFrame:
    """(query, chunk columns, score, rank): the k best chunks; ties by the chunk columns after the first."""
    chunk = index.schema["chunks"].dataType.elementType
    columns = chunk.names
    asked = queries.select(query_key, X.query_terms("query").alias("_terms")).where(F.size("_terms") > 0)
    # The numbers of the queries are fixed before they are used twice.
    asked = settle(asked.withColumn("_query", F.monotonically_increasing_id()))
    words = asked.select("_query", F.explode("_terms").alias("term")).groupBy("_query", "term").agg(F.count("*").alias("weight"))
    vocabulary = words.select("term").distinct()
    held = settle(opened(index, vocabulary))
    blocks = index.where("bucket IS NULL")
    counted = blocks.agg(F.count("*").alias("blocks"), F.sum(F.size("chunks")).alias("n")).first()
    # More slots than blocks, so that few of them share one.
    slots, total = max(1, 4 * counted["blocks"]), counted["n"] or 0
    frequencies = held.groupBy("term").agg((F.log(F.lit(total + 1.0) / (F.sum("df") + 1)) + 1).alias("idf"))
    more = F.when(X.is_identifier_term("term"), V.IDENTIFIER_WEIGHT).otherwise(0.0)
    weighed = words.join(frequencies, "term", "left").groupBy("_query").agg(
        F.collect_list(F.struct("term", F.col("weight").cast("double").alias("w"), F.coalesce("idf", F.lit(1.0)).alias("idf"), more.alias("more"))).alias("words")
    )
    full = asked.join(weighed, "_query").select(F.col(query_key).alias("_key"), "_terms", "words")
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = full.withColumn("_group", F.pmod(F.hash("_key", "_terms"), F.lit(groups))).withColumn("_slot", every(slots))
    right = held.drop("df").unionByName(blocks.select("block", "chunks", "starts"), allowMissingColumns=True)
    right = right.withColumn("_in", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).withColumn("_of", every(groups))
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), *chunk.fields, T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if some.num_rows and rows.num_rows:
            asked = []
            for key, terms, own in zip(some.column("_key").to_pylist(), some.column("_terms").to_pylist(), some.column("words").to_pylist(), strict=True):
                pairs: dict[tuple[str, str], float] = {}
                for pair in zip(terms, terms[1:]):
                    pairs[pair] = pairs.get(pair, 0.0) + 1.0
                asked.append((key, {w["term"]: (w["w"], w["idf"], w["more"]) for w in own}, [(*p, n) for p, n in pairs.items()]))
            for name in rows.column("block").unique():
                block = Block(rows.filter(pc.equal(rows.column("block"), name)), columns)
                for key, words, pairs in asked:
                    out += [(key, *block.rows[at].values(), score) for at, score in block.search(words, pairs, k)]
        parts = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
        return pa.Table.from_arrays([pa.array(list(p), f.type) for p, f in zip(parts, arrow, strict=True)], schema=arrow)

    met = left.groupBy("_slot", "_group").cogroup(right.groupBy("_in", "_of")).applyInArrow(run, schema)
    return top_rows(met, [query_key], [F.desc("score"), *[F.col(c) for c in columns[1:]]], k)
