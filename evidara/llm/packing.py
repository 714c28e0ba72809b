"""Best-fit decreasing packing of token sequences into windows of fixed size.

Overlong documents are first cut into full windows.  What is packed depends on lengths only, and
there are at most ``WINDOW`` different ones, so the packing is decided on the histogram of
lengths: the decreasing lengths are placed class by class with a segment tree over the remaining
capacity that finds the tightest open window.  The decision is a list of runs ("pieces number i
to j of this length go to these windows at this offset"), at most a few thousand whatever the
number of documents.  Each piece then finds its run by its own number within its length, which
comes from counts per (length, bucket) and a position inside a bounded bucket.

Defined results: a null or empty text is one piece (the end id); repeated rows are packed each
on their own; a null doc_id stays null; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from string import punctuation

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.base import settle, sized

WINDOW = 4096
END = 2
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Words that a worker keeps with their ids, some 200 bytes each.
KEPT_WORDS = 500_000
# Rows of a bucket within which pieces are numbered.
BUCKET_ROWS = 50_000
# str.split also splits at these four, which are no white space to the tokenizer.
_CONTROL = re.compile("[\x1c-\x1f]")
_BLANK = re.compile("[^\\S\x1c-\x1f]+")


class Encoder(dict):
    """Ids of whole texts as little-endian bytes; the items are the words seen so far.

    The tokenizer drops white space and never joins across it, so a text is encoded word by
    word.  A worker keeps its words from task to task; once ``KEPT_WORDS`` are kept, words
    beyond them are encoded each time.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and "<|" not in word
        low = word.lower() if plain else word
        stem = low.rstrip(punctuation) if plain else low
        if stem != low and stem and stem[-1].isalnum():
            ids = self[stem] + self[low[len(stem) :]]  # marks are cut off from letters and digits
        elif low != word:
            ids = self[low]
        else:
            made = self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0]
            ids = np.array(made.ids, "<u4").tobytes()
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        words = _BLANK.split(text) if _CONTROL.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


@cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, text -> the document's pieces: all full windows and the rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + last
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


# ------------------------------------------------------------------------------ the decision


class Capacities:
    """Segment tree over remaining capacities 0..size: does a range hold an open window?"""

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.some = bytearray(2 * self.width)

    def set(self, capacity: int, value: bool) -> None:
        at = self.width + capacity
        self.some[at] = value
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def tightest(self, need: int) -> int:
        """Smallest capacity of at least ``need`` with an open window, or -1."""
        at = self.width + need
        while not self.some[at]:
            while at & 1:  # a right child, or the root: climb
                at //= 2
            if at == 0:
                return -1
            at += 1
        while at < self.width:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.width


def decide(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Runs of a best-fit decreasing packing, as rows
    (length, first number, pieces, first window, pieces per window, offset).

    Windows with equal fill are kept as intervals, so equal pieces are placed together; the
    windows filled are those that piece-by-piece best fit would choose.
    """
    tree = Capacities(window)
    opened: list[list[tuple[int, int]]] = [[] for _ in range(window + 1)]  # by capacity: [low, high)
    runs: list[tuple[int, ...]] = []
    windows = 0
    for length in sorted(histogram, reverse=True):
        number, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:  # new windows; a partly filled last one stays open
                each = window // length
                full, rest = divmod(left, each)
                for count, per in ((full, each), (1, rest)):
                    if count and per:
                        runs.append((length, number, count * per, windows, per, 0))
                        number += count * per
                        _open(tree, opened, window - per * length, (windows, windows + count))
                        windows += count
                left = 0
                continue
            low, high = opened[capacity].pop()
            each = capacity // length
            full = min(high - low, left // each)
            used = low + full
            if full:
                runs.append((length, number, full * each, low, each, window - capacity))
                number, left = number + full * each, left - full * each
                _open(tree, opened, capacity - each * length, (low, used))
            if left and used < high:  # fewer pieces than one window takes
                runs.append((length, number, left, used, left, window - capacity))
                _open(tree, opened, capacity - left * length, (used, used + 1))
                used, left = used + 1, 0
            if used < high:
                opened[capacity].append((used, high))
            tree.set(capacity, bool(opened[capacity]))
    return np.array(runs, np.int64).reshape(-1, 6)


def _open(tree: Capacities, opened: list, capacity: int, interval: tuple[int, int]) -> None:
    last = opened[capacity][-1] if opened[capacity] else None
    if last and last[1] == interval[0]:
        opened[capacity][-1] = (last[0], interval[1])
    else:
        opened[capacity].append(interval)
    tree.set(capacity, True)


# -------------------------------------------------------------------------- placing the pieces


def packed(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with their sequence_id and offset.  ``cut`` is what ``pieces`` returns."""
    cut = settle(cut)
    # At most ``window`` rows reach the driver, whatever the input.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = decide(histogram, window)
    buckets = sized(sum(histogram.values()), BUCKET_ROWS)
    row = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # Equal rows share a bucket; they are told apart by the number inside it.
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64(*row), F.lit(buckets)))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = dealt.withColumn("_row", F.row_number().over(inside) - 1).join(firsts, ["length", "_bucket"])
    numbered = numbered.select(*row, (F.col("_row") + F.col("_first")).cast("long").alias("_number"))
    at = runs[np.lexsort((runs[:, 1], runs[:, 0]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # First run of each length, then the run by number within the length.
        begin = np.searchsorted(at[:, 0], np.arange(window + 2))
        for batch in batches:
            length = batch.column(2).to_numpy()
            number = batch.column(5).to_numpy()
            found = np.zeros(len(length), np.int64)
            for one in np.unique(length):
                own = length == one
                low, high = begin[one], begin[one + 1]
                found[own] = low + np.searchsorted(at[low:high, 1], number[own], side="right") - 1
            place = number - at[found, 1]
            sequence = at[found, 3] + place // at[found, 4]
            offset = at[found, 5] + place % at[found, 4] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*row, "sequence_id", "offset"]
            )

    return numbered.mapInArrow(run, ", ".join(f"{n} long" for n in [*row, "sequence_id", "offset"]))
