"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers see a blank and the text.  Byte offsets at which a token of each ends are cuts; between
neighbouring cuts lie the groups.  They are found by divide and conquer: from the middle of an interval
outwards, a bisection looks for the next end that both share; the interval is parted there and both
halves go on, and an interval without a shared end is a group.

Neither tokenizer joins across the place before a blank that follows a letter, digit or ASCII mark, so
such places are cuts from the start (a vocabulary for which this does not hold is refused).  Each distinct
stretch between them is encoded and aligned once per block of documents, and a worker keeps some.

A pair's count is the number of documents that hold it linked.  A block lists its distinct pairs once with the
documents that hold them; these lists are summed over the corpus, and the counts go back to the blocks that named the pair, so
what is shuffled is a row per block and distinct pair, whatever the length of the texts.

Defined results: a null or empty text, and one that a tokenizer does not give back byte for byte (such as one with
U+2581), has no tokens: zeros and an empty digest; strings of special tokens are ordinary text; very long
texts count whole; repeated rows are documents of their own; ties for the highest count are all best;
other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.base import settle

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Characters of a block of documents.
BLOCK = 8 << 20
# Stretches that a worker keeps from block to block, some 500 bytes each.
KEPT = 120_000
ROWS = 256
# Stretches that are encoded together; links of a group that are written out one by one.
BATCH, WIDE = 8192, 4096
# Open intervals that are no longer probed together.
FEW = 64
_CUT = re.compile(r"(?<=[\w!-~])(?= )")
_PLAIN = re.compile(r" +[^ ]*")
# A character before a blank that does not make a cut.
_ODD = re.compile(r"[^\w!-~ ] ")
MARK = "▁"


def stretches(text: str) -> list[str]:
    """A text that begins with a blank, parted at the cuts that both tokenizers respect."""
    return _CUT.split(text) if _ODD.search(text) else _PLAIN.findall(text)


def align(a: list[int], b: list[int], starts: list[tuple[int, int, int, int]] | None = None) -> list[tuple[int, int, int, int]]:
    """Two rising lists of ends with the same last one -> groups (from, to) of each list, in order.

    ``starts`` are intervals whose last ends are shared, in order; without them all is one interval.
    """
    groups, todo = [], (starts or [(0, len(a), 0, len(b))])[::-1]
    while todo:
        i, i_end, j, j_end = interval = todo.pop()
        if i_end - i == 1 or j_end - j == 1:
            groups.append(interval)
            continue
        low = high = (i + i_end - 1) // 2
        while True:
            if low >= i:
                other = bisect_left(b, a[low], j, j_end - 1)
                if other < j_end - 1 and b[other] == a[low]:
                    todo.append((low + 1, i_end, other + 1, j_end))
                    todo.append((i, low + 1, j, other + 1))
                    break
            high += 1
            if high < i_end - 1:
                other = bisect_left(b, a[high], j, j_end - 1)
                if other < j_end - 1 and b[other] == a[high]:
                    todo.append((high + 1, i_end, other + 1, j_end))
                    todo.append((i, high + 1, j, other + 1))
                    break
            low -= 1
            if low < i and high >= i_end - 1:
                groups.append(interval)
                break
    return groups


def align_all(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``align`` for many intervals at once, (from, to, from, to) in rows: each round probes one end of every open interval.

    The last few open ones are done one by one, so an interval without a shared end costs no round for each of its ends.
    """
    todo, probe, done = starts, np.zeros(len(starts), np.int64), []
    while len(todo):
        if len(todo) < FEW:
            for i, i_end, j, j_end in todo.tolist():
                found = np.array(align(a[i:i_end].tolist(), b[j:j_end].tolist()), np.int64)
                done.append(found + np.array([i, i, j, j]))
            break
        i, i_end, j, j_end = todo.T
        middle = (i + i_end - 1) // 2
        at = middle + np.where(probe % 2 == 1, (probe + 1) // 2, -(probe // 2))
        inside = (at >= i) & (at < i_end - 1)
        whole = (i_end - i == 1) | (j_end - j == 1) | (probe > 2 * np.maximum(middle - i, i_end - 1 - middle))
        done.append(todo[whole])
        other = np.searchsorted(b, a[np.where(inside, at, i_end - 1)])
        hit = inside & ~whole & (b[other] == a[at * inside])
        on = ~whole & ~hit
        left = np.stack([i, at + 1, j, other + 1], 1)[hit]
        right = np.stack([at + 1, i_end, other + 1, j_end], 1)[hit]
        todo = np.concatenate([todo[on], left, right])
        probe = np.concatenate([probe[on] + 1, np.zeros(2 * len(left), np.int64)])
    groups = np.concatenate(done) if done else np.zeros((0, 4), np.int64)
    return groups[np.argsort(groups[:, 0])]


def byte_of_sign() -> dict[str, int]:
    """The signs by which byte-level vocabularies write bytes: printable ones as such, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(rest)}


def _sums(ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring ends."""
    return np.diff(np.r_[0, np.cumsum(values)][ends])


class Coders:
    """Both tokenizers, with the bytes of their ids."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        signs = byte_of_sign()
        with open(byte_level) as file:
            model = json.load(file)["model"]
        own = {i: bytes(signs[c] for c in entry) for entry, i in model["vocab"].items() if all(c in signs for c in entry)}
        special = self.a.get_added_tokens_decoder()
        self.a_bytes = [own.get(i, b"") for i in range(self.a.get_vocab_size())]
        # Where ids follow the merges, ASCII text has the same ids from the library of rank files, which is faster.
        self.fast = None
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if all(model["vocab"].get(m) == 256 + n for n, m in enumerate(merges)):
            ranks = {own[i]: i for i in own if i not in special}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a piece joins a word and the blank after it")
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)
        ]
        self.blank = self.b.piece_to_id(MARK)
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes)]
        # Ids as text with what follows them: inside a group, and at the end of its side.
        named = lambda n, sign: np.array([b"%d%s" % (i, sign) for i in range(n)], object)
        self.inner = [named(len(own), b",") for own in (self.a_bytes, self.b_bytes)]
        self.last = [named(len(self.a_bytes), b"|"), named(len(self.b_bytes), b";")]

    def encode(self, given: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for strings that begin with a blank."""
        plain = [self.fast is not None and x.isascii() for x in given]
        slow = iter(self.a.encode_batch_fast([x for x, p in zip(given, plain, strict=True) if not p], add_special_tokens=False))
        a = [self.fast.encode_ordinary(x) if p else next(slow).ids for x, p in zip(given, plain, strict=True)]
        b = self.b.encode([x[1:] for x in given], num_threads=1)  # it adds the first blank itself, but not to nothing
        return [(x, y if s != " " else [self.blank]) for x, y, s in zip(a, b, given, strict=True)]

    def all_give(self, given: list[str], coded: list[tuple[list[int], list[int]]]) -> list[bool]:
        """``gives`` for each; where all do, as nearly always, their bytes are joined and compared once."""
        raw = [text.encode() for text in given]
        whole, lengths = b"".join(raw), np.array([len(x) for x in raw])
        for n, own in enumerate((self.a_bytes, self.b_bytes)):
            ids = list(chain.from_iterable([x[n] for x in coded]))
            ends = np.r_[0, np.cumsum([len(x[n]) for x in coded])]
            if b"".join([own[i] for i in ids]) != whole or (_sums(ends, self.sizes[n][ids]) != lengths).any():
                return [self.gives(s, *x) for s, x in zip(given, coded, strict=True)]
        return [True] * len(given)

    def gives(self, text: str, a: list[int], b: list[int]) -> bool:
        """Do the ids of both give the bytes of the text?"""
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])


@cache
def coders(byte_level: str, pieces: str) -> Coders:
    return Coders(byte_level, pieces)


class Stretch:
    """What a stretch adds to its document: sizes, the groups as text, pairs and how often they are linked."""

    __slots__ = ("pairs", "sizes", "text", "times")

    def __init__(self, sizes: tuple[int, int, int, int], text: bytes, pairs: bytes, times: bytes) -> None:
        self.sizes, self.text, self.pairs, self.times = sizes, text, pairs, times


def _expand(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... for as many as counts[0], and so on."""
    ahead = np.cumsum(counts) - counts
    return np.repeat(firsts - ahead, counts) + np.arange(counts.sum())


def _pairs(groups: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, pair, times) of the links of groups, each (number, pair) once, in order."""
    i, i_end, j, j_end = groups.T
    links = (i_end - i) * (j_end - j)
    small = links <= WIDE
    at = _expand(np.zeros(small.sum(), np.int64), links[small])
    width = np.repeat((j_end - j)[small], links[small])
    left, right = np.repeat(i[small], links[small]) + at // width, np.repeat(j[small], links[small]) + at % width
    keys, pairs, times = [np.repeat(of[small], links[small])], [a[left] << 32 | b[right]], [np.ones(len(at), np.int64)]
    for g in np.flatnonzero(~small):  # long groups: distinct ids of each side with how often
        (x, n), (y, m) = (np.unique(side, return_counts=True) for side in (a[i[g] : i_end[g]], b[j[g] : j_end[g]]))
        pairs.append((x[:, None] << 32 | y[None]).ravel())
        times.append((n[:, None] * m[None]).ravel())
        keys.append(np.full(len(x) * len(y), of[g]))
    key, pair, count = (np.concatenate(x) for x in (keys, pairs, times))
    order = np.lexsort((pair, key))
    key, pair, count = key[order], pair[order], count[order]
    heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])][: len(key)])
    return key[heads], pair[heads], np.add.reduceat(count, heads)


def aligned_stretches(both: Coders, given: list[str]) -> list[Stretch | None]:
    """Each stretch encoded and aligned; nothing where a tokenizer does not give its bytes back."""
    coded = both.encode(given)
    good = both.all_give(given, coded)
    kept = [ids for ids, fine in zip(coded, good, strict=True) if fine]
    if not kept:
        return [None] * len(given)
    flat = [np.fromiter(chain.from_iterable(ids[n] for ids in kept), np.int64) for n in (0, 1)]
    counts = [np.array([len(ids[n]) for ids in kept]) for n in (0, 1)]
    upto = [np.cumsum(c) for c in counts]
    # Neighbouring stretches follow each other in one string of bytes, so ends rise through all of them.
    ends = [np.cumsum(size[ids]) for size, ids in zip(both.sizes, flat, strict=True)]
    starts = np.stack([upto[0] - counts[0], upto[0], upto[1] - counts[1], upto[1]], 1)
    groups = align_all(*ends, starts)
    of = np.searchsorted(upto[0], groups[:, 0], side="right")
    # The text of the groups: ids of the first side, then of the second, group after group.
    text = np.empty(len(flat[0]) + len(flat[1]), object)
    sides = groups[:, :2], groups[:, 2:]
    for n, (side, ahead) in enumerate(zip(sides, (groups[:, 2], groups[:, 1]), strict=True)):
        place = np.arange(len(flat[n])) + np.repeat(ahead, side[:, 1] - side[:, 0])
        text[place] = both.inner[n][flat[n]]
        final = side[:, 1] - 1
        text[place[final]] = both.last[n][flat[n][final]]
    text = text.tolist()
    key, pairs, times = _pairs(groups, of, *flat)
    borders = np.searchsorted(key, np.arange(len(kept) + 1)).tolist()
    n_groups = np.bincount(of, minlength=len(kept))
    n_links = np.bincount(of, (groups[:, 1] - groups[:, 0]) * (groups[:, 3] - groups[:, 2]), len(kept)).astype(np.int64)
    sizes = zip(counts[0].tolist(), counts[1].tolist(), n_groups.tolist(), n_links.tolist(), strict=True)
    made = []
    for row, ((i, i_end, j, j_end), own) in enumerate(zip(starts.tolist(), sizes, strict=True)):
        part = slice(borders[row], borders[row + 1])
        made.append(Stretch(own, b"".join(text[i + j : i_end + j_end])[:-1], pairs[part].tobytes(), times[part].tobytes()))
    rest = iter(made)
    return [next(rest) if fine else None for fine in good]


class Numbers(dict):
    """Stretch -> its number in the block, in order of appearance."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def _known(both: Coders, kept: dict[str, Stretch | None], wanted: list[str]) -> list[Stretch | None]:
    fresh = [s for s in wanted if s not in kept]
    made = {}
    for low in range(0, len(fresh), BATCH):
        part = fresh[low : low + BATCH]
        made.update(zip(part, aligned_stretches(both, part), strict=True))
    found = [made[s] if s in made else kept[s] for s in wanted]
    for s, stretch in made.items():
        if len(kept) >= KEPT:
            break
        if len(s) < 64:
            kept[s] = stretch
    return found


COLUMNS = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "pairs", "holders"]
LINKED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "codes binary, times binary, pairs array<long>, holders array<int>"
)


def _block(both: Coders, kept: dict, number: int, ids: list, numbers: Numbers, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The documents of a block, given as numbers of stretches, and the block's list of pairs."""
    found = _known(both, kept, list(numbers))
    bad = np.array([s is None for s in found], bool)
    names = list(numbers)
    for doc, codes in enumerate(held):
        if bad[codes].any():  # a stretch fails; so does the text, unless the whole is given back after all
            text = "".join([names[c] for c in codes])
            whole = aligned_stretches(both, [text])[0]
            held[doc] = np.array([len(found)] if whole else [], np.int32)
            found += [whole] if whole else []
    good = [s for s in found if s is not None]
    place = np.cumsum([s is not None for s in found]) - 1
    ends = np.r_[0, np.cumsum([len(c) for c in held])]
    codes = place[np.concatenate([np.zeros(0, np.int32), *held])].astype(np.int64)
    sizes = np.array([s.sizes for s in good], np.int64).reshape(-1, 4)
    totals = [_sums(ends, sizes[codes, k]) for k in range(4)]
    # Pairs of the block, and those of each stretch as numbers among them.
    each = np.array([len(s.pairs) // 8 for s in good], np.int64)
    pairs, own = np.unique(np.frombuffer(b"".join([s.pairs for s in good]), np.int64), return_inverse=True)
    times = np.frombuffer(b"".join([s.times for s in good]), np.int64)
    # (document, stretch) once with how often, then (document, pair) once with how often.
    many = max(1, len(good))
    keys, often = np.unique(np.repeat(np.arange(len(held)), np.diff(ends)) * many + codes, return_counts=True)
    doc, stretch = keys // many, keys % many
    at = _expand((np.cumsum(each) - each)[stretch], each[stretch])
    keys = np.repeat(doc, each[stretch]) * max(1, len(pairs)) + own[at]
    order = np.argsort(keys, kind="stable")
    keys, linked = keys[order], (np.repeat(often, each[stretch]) * times[at])[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    linked = np.add.reduceat(linked, heads) if len(heads) else linked
    doc, code = keys[heads] // max(1, len(pairs)), (keys[heads] % max(1, len(pairs))).astype(np.int32)
    borders = np.searchsorted(doc, np.arange(len(held) + 1))
    texts = [s.text for s in good]
    for low in range(0, len(held), ROWS):
        rows = range(low, min(low + ROWS, len(held)))
        shas = [
            hashlib.sha256(b";".join([texts[c] for c in codes[ends[r] : ends[r + 1]].tolist()])).hexdigest() if ends[r] < ends[r + 1] else ""
            for r in rows
        ]
        part = lambda values, kind: [values[borders[r] : borders[r + 1]].astype(kind).tobytes() for r in rows]  # noqa: B023, E731
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number] * n, pa.int64()), pa.array([ids[r] for r in rows], pa.int64()), *[pa.array(t[low : low + n]) for t in totals],
                pa.array(shas, pa.string()), pa.array(part(code, np.int32), pa.binary()), pa.array(part(linked, np.int64), pa.binary()),
                pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())),
            ],
            COLUMNS,
        )
    holders = np.bincount(code, minlength=len(pairs)).astype(np.int32)
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
    empty = [pa.nulls(1, kind) for kind in kinds[1:]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), *empty, pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int32()))], COLUMNS
    )


def linked(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, text -> a row for each document, its links by numbers of the block's pairs, and one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks make millions of small objects without a cycle; looking for cycles took a fifth of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            yield from made(batches)
        finally:
            if collects:
                gc.enable()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coders(byte_level, pieces)
        kept: dict[str, Stretch | None] = both.__dict__.setdefault("kept", {})
        number = TaskContext.get().partitionId() << 32
        ids, numbers, held, size = [], Numbers(), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                usable = bool(text) and MARK not in text
                ids.append(doc_id)
                held.append(np.array([numbers[s] for s in stretches(" " + text)] if usable else [], np.int32))
                size += len(text or "")
                if size >= BLOCK:
                    yield from _block(both, kept, number, ids, numbers, held)
                    number, ids, numbers, held, size = number + 1, [], Numbers(), [], 0
        if ids:
            yield from _block(both, kept, number, ids, numbers, held)

    return docs.mapInArrow(run, LINKED)


def counts(listed: DataFrame) -> DataFrame:
    """block, place, pair, holders -> pair, count and whether the count is the highest of the first id."""
    total = listed.groupBy("pair").agg(F.sum("holders").alias("count"))
    # An id has at most as many pairs as the other vocabulary has entries.
    own = Window.partitionBy(F.shiftright("pair", 32))
    return total.select("pair", "count", (F.col("count") == F.max("count").over(own)).alias("best"))


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, text -> doc_id, groups: the ids of both tokenizers in each group, in order."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coders(byte_level, pieces)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = []
                if text:
                    a, b = both.encode([" " + text])[0]
                    if both.gives(" " + text, a, b):
                        ends = [np.cumsum(size[ids]).tolist() for size, ids in zip(both.sizes, (a, b), strict=True)]
                        found = [{"a": a[i:k], "b": b[j:l]} for i, k, j, l in align(*ends)]
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "groups"])

    return docs.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def scored(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, text -> sizes and digest of the alignment, and its links weighed by the counts of their pairs."""
    held = settle(linked(docs, byte_level, pieces))
    listed = held.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "own"))
    listed = listed.select("block", "place", F.col("own.pairs").alias("pair"), F.col("own.holders").alias("holders"))
    known = listed.select("block", "place", "pair").join(counts(listed), "pair").select(F.col("block").alias("of"), "place", "count", "best")
    texts = held.where("pairs IS NULL").drop("pairs", "holders")

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        place = known.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist(), strict=True):
            code, often = np.frombuffer(codes, np.int32), np.frombuffer(times, np.int64)
            n_best.append(int(often[best[code]].sum()))
            count_sum.append(int((often * count[code]).sum()))
        kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, values in (("n_best", n_best), ("count_sum", count_sum)):
            kept = kept.append_column(name, pa.array(values, pa.int64()))
        return kept.append_column("groups_sha256", docs.column("groups_sha256"))

    return texts.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, SUMS)
