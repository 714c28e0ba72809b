"""Byte-level BPE by higher-order functions: ranked merges are folded over each distinct unit of words.

A text is cut into words by the pattern, and words into units where two bytes meet that stand side by side in
no entry of the vocabulary: no merge crosses such a place.  Documents are taken in blocks of about ``BLOCK``
bytes, which keep the units of their documents as numbers, and bring each distinct unit the task has not
numbered yet.  For each of these a fold merges the pair of lowest rank (the leftmost on ties) until no pair
has a rank; the documents of the block then take the ids of their units.  Nothing is shuffled.  The
ranks are literals: rows of pairs laid into one array, and a hashed array from whole units to their id.  A
block is bounded (or one batch of texts) and so is the number of units a task keeps, so the work grows with
the text; the work of a single unit without a break grows with the square of its length.

Decoding looks up the bytes of each id and concatenates them.

Defined results: a null text is empty and has no ids; no special tokens exist, their strings are
ordinary text; repeated rows give repeated rows; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Java's \s is ASCII unless told otherwise.
PATTERN = "(?U)" + public_tokenizers.PATTERN
# Bytes of text of a block.
BLOCK = 2 << 20
# Units that a task keeps; beyond them it numbers anew.
KEPT = 1 << 19
# Documents of one batch of results.
ROWS = 256
SLOTS = (150_001, 150_011)
# Bits of a part: 17 for a rank plus one (all set: none), 29 for a place, 17 for an id plus one.
NONE = (2**17 - 1) << 46
IDS = 2**17 - 1
PLACES = (2**29 - 1) << 17
# No state is as long.
LONGEST = 2**29
# What stands for a byte at both ends of a unit.
END = 256


@cache
def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The rank file as bytes -> rank; it is part of the installation, not of the input."""
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _cuckoo(places: list[tuple[int, int]], size: int) -> list[int]:
    """Entry in each slot (-1: none), so that every entry sits in one of its two places."""
    slots = [-1] * size
    for entry in range(len(places)):
        at = places[entry][0]
        for _ in range(10_000):
            entry, slots[at] = slots[at], entry
            if entry < 0:
                break
            one, two = places[entry]
            at = two if at == one else one
        else:
            raise ValueError("the hashed table is too full")
    return slots


def _laid(rows: dict[int, dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, row (-1: none) and value of each place: the value at (r, c) stands at offset[r] + c if that place is of r."""
    columns = IDS + 1
    room = columns + 4 * sum(map(len, rows.values()))
    owner, values = np.full(room, -1), np.zeros(room, np.int64)
    offsets = np.zeros(columns, np.int64)
    rng = np.random.default_rng(42)
    for row in sorted(rows, key=lambda r: (-len(rows[r]), r)):
        at = np.fromiter(rows[row], np.int64)
        offset = 0
        while (owner[at + offset] >= 0).any():
            offset = int(rng.integers(room - columns))
        offsets[row] = offset
        owner[at + offset] = row
        values[at + offset] = list(rows[row].values())
    return offsets, owner, values


@cache
def _starts(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: its id plus one.  By pair of bytes: their rank plus one in its bits; whether an entry holds them side by side."""
    known = ranks(vocabulary)
    first = np.array([*(known[bytes([b])] + 1 for b in range(256)), 0], np.int64)
    pairs = np.full((257, 257), NONE, np.int64)
    beside = np.zeros((256, 256), bool)
    for whole, rank in known.items():
        if len(whole) == 2:
            pairs[whole[0], whole[1]] = (rank + 1) << 46
        for left, right in zip(whole, whole[1:]):
            beside[left, right] = True
    return first, pairs, beside


@cache
def _tables(vocabulary: str) -> str:
    """All tables of a vocabulary as one JSON record; see ``SCHEMA``."""
    known = ranks(vocabulary)
    rows: dict[int, dict[int, int]] = {}
    for whole, rank in known.items():
        for cut in range(1, len(whole)):
            left, right = known.get(whole[:cut]), known.get(whole[cut:])
            if left is not None and right is not None:
                rows.setdefault(left + 1, {})[right + 1] = (rank + 1) << 46
    offsets, owner, values = _laid(rows)
    words = [(base64.b64encode(whole).decode(), rank) for whole, rank in known.items()]
    hashed = [xxhash.xxh64_intdigest(whole, 42) for whole in known]
    signed = [h - 2**64 if h >> 63 else h for h in hashed]
    word_slots = _cuckoo([(h % SLOTS[0], SLOTS[0] + h % SLOTS[1]) for h in signed], sum(SLOTS))
    pick = lambda entries, slots, i: [entries[e][i] if e >= 0 else None for e in slots]
    order = sorted(known, key=known.get)
    record = {
        "offsets": offsets.tolist(), "pair_lefts": owner.tolist(), "pair_ranks": values.tolist(),
        "word_keys": pick(words, word_slots, 0), "word_ranks": pick(words, word_slots, 1),
        "lengths": [1, *map(len, order)],
        "little": [rank.to_bytes(4, "little").hex() for rank in range(len(order))],
        "pieces": [b.hex() for b in order],
    }
    return json.dumps(record, separators=(",", ":"))


SCHEMA = (
    "offsets array<bigint>, pair_lefts array<bigint>, pair_ranks array<bigint>, word_keys array<binary>, "
    "word_ranks array<bigint>, lengths array<int>, little array<string>, pieces array<string>"
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once: a fold over nothing with ``body`` at its end.

    An element of a transformed array would do too, but asks for the type of ``body`` with each value.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def _whole(t: Column, unit: Column) -> Column:
    """The id of a unit that is an entry, in one of its two slots of a hashed literal (else -1)."""

    def of(hashed: Column) -> Column:
        one, two = F.pmod(hashed, F.lit(SLOTS[0])), F.pmod(hashed, F.lit(SLOTS[1])) + SLOTS[0]
        held = lambda slot: F.get(t["word_keys"], slot) == unit
        found = F.when(held(one), F.get(t["word_ranks"], one)).when(held(two), F.get(t["word_ranks"], two))
        return found.otherwise(F.lit(-1).cast("long"))

    return _let(F.xxhash64(unit), of)


def _rank(t: Column, left: Column, right: Column) -> Column:
    """Rank plus one of a pair of ids plus one, in its bits of a part."""

    def of(at: Column) -> Column:
        return F.when(F.get(t["pair_lefts"], at) == left, F.get(t["pair_ranks"], at)).otherwise(F.lit(NONE))

    return _let(F.get(t["offsets"], left) + right, of)


def _merged(t: Column, start: Column) -> Column:
    """The parts of a unit after the fold of ranked merges, with its ends; see ``_started`` for the first one.

    The state has one number for each byte and each end; all bytes of a part have the same one.  It holds, from
    above, the rank plus one of the part with the one to the right (which is what the pair merges to), the place of
    its first byte, and its id plus one (zero: the ends).  So the minimum is the leftmost pair of lowest rank, the
    part to its left stands one place before, and the part to its right where the length of an id ends: a step
    finds all it needs by place.
    """
    own = lambda x: x.bitwiseAND(F.lit(IDS))
    place = lambda x: F.shiftright(x.bitwiseAND(F.lit(PLACES)), 17).cast("int")
    end = lambda at, part: at + F.get(t["lengths"], own(part))

    def step(s: Column) -> Column:
        def merge(low: Column, at: Column, left: Column, after: Column) -> Column:
            fresh = F.shiftright(low, 46)
            before = _rank(t, own(left), fresh).bitwiseOR(left.bitwiseAND(F.lit(PLACES + IDS)))
            merged = _rank(t, fresh, own(F.get(s, after))).bitwiseOR(low.bitwiseAND(F.lit(PLACES))).bitwiseOR(fresh)
            parts = F.array(
                F.slice(s, F.lit(1), place(left)),
                F.array_repeat(before, at - place(left)),
                F.array_repeat(merged, after - at),
                F.slice(s, after + 1, F.lit(LONGEST)),
            )
            return F.flatten(parts)

        def around(low: Column, at: Column) -> Column:
            middle = end(at, low)
            after = end(middle, F.get(s, middle))
            return _let(F.get(s, at - 1), lambda left: _let(after, lambda a: merge(low, at, left, a)))

        return _let(F.array_min(s), lambda low: F.when(low >= NONE, s).otherwise(_let(place(low), lambda at: around(low, at))))

    # The bytes of a part are equal and those of two parts are not: what is left of the state is a number for each part.
    return F.array_distinct(F.aggregate(F.sequence(F.lit(4), F.size(start)), start, lambda s, _: step(s)))


def _unit(t: Column, unit: Column, start: Column) -> Column:
    """The last parts of a unit: numbers whose last bits are an id plus one (zero: an end)."""
    # A single byte is an entry, so a fold has at least two.
    return _let(_whole(t, unit), lambda w: F.when(w >= 0, F.array(w + 1)).otherwise(_merged(t, start)))


def packed(t: Column, ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t["little"], i)), ""))


def decode(t: Column, ids: Column) -> Column:
    """The bytes of the ids, concatenated."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t["pieces"], i)), ""))


def _with_tables(vocabulary: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of the record of tables, a constant that the optimizer folds to one literal."""
    return _let(F.from_json(F.lit(_tables(vocabulary)), SCHEMA), body)


def _started(units: list[bytes], vocabulary: str) -> pa.ListArray:
    """The state of each unit before the first merge; its bytes are not empty."""
    first, pairs, _ = _starts(vocabulary)
    ends = np.cumsum(np.array([len(u) + 2 for u in units], np.int64))
    sizes = np.diff(ends, prepend=0)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    codes = np.full(len(place), END)
    codes[(place > 0) & (place < np.repeat(sizes, sizes) - 1)] = np.frombuffer(b"".join(units), np.uint8)
    state = pairs[codes, np.append(codes[1:], END)] + (place << 17) + first[codes]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(state))


def _blocks(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, words -> one row for each block of documents: ids, sizes, numbers of units, new units and their states."""

    def block(held: list[pa.RecordBatch], numbers: dict[bytes, int]) -> pa.RecordBatch:
        beside = _starts(vocabulary)[2]
        lists = pa.concat_arrays([b.column(1) for b in held])
        words = lists.flatten().cast(pa.large_binary())
        places = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: places[-1]]
        apart = np.zeros(places[-1] + 1, bool)
        apart[places[0] + 1 : -1] = ~beside.ravel()[data[places[0] : -1] * np.uint16(256) + data[places[0] + 1 :]]
        apart[places] = True
        cuts = np.flatnonzero(apart)
        units = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), words.buffers()[2]])
        upto = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        sizes = np.diff(np.searchsorted(cuts, places[upto]))
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        before = len(numbers)
        known = np.array([numbers.setdefault(u, len(numbers)) for u in distinct], np.int32)
        fresh = [u for u, number in zip(distinct, known.tolist()) if number >= before]
        codes = known[coded.indices.to_numpy(zero_copy_only=False)]
        ids = pa.concat_arrays([b.column(0) for b in held])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [
                one(ids), pa.array([sizes.astype(np.int32).tobytes()]), pa.array([codes.tobytes()]), pa.array([before]),
                one(pa.array(fresh, pa.binary())), one(_started(fresh, vocabulary)),
            ],
            ["doc_ids", "sizes", "codes", "known", "units", "starts"],
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        numbers: dict[bytes, int] = {}
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK:
                yield block(held, numbers)
                held, size = [], 0
                if len(numbers) > KEPT:
                    numbers.clear()
        if held:
            yield block(held, numbers)

    return blocks


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block whose new units have their ids -> doc_id, ids of each of its documents."""
    values, lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            docs = batch.column(0)[row].values
            sizes = np.frombuffer(batch.column(1)[row].as_py(), np.int32)
            codes = np.frombuffer(batch.column(2)[row].as_py(), np.int32)
            if not batch.column(3)[row].as_py():
                values, lengths = values[:0], lengths[:0]
            folded = batch.column(4)[row].values
            state = folded.flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(folded.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64))
            parts = (state & IDS) > 0
            upto = np.append(0, np.cumsum(parts))
            values = np.concatenate([values, ((state[parts] & IDS) - 1).astype(np.int32)])
            lengths = np.concatenate([lengths, np.diff(upto[ends])])
            firsts = np.cumsum(lengths) - lengths
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            for low in range(0, len(docs), ROWS):
                high = min(low + ROWS, len(docs))
                own = codes[ends[low] : ends[high]]
                counts = lengths[own]
                upto = np.concatenate([[0], np.cumsum(counts)])
                ids = values[np.repeat(firsts[own] - upto[:-1], counts) + np.arange(upto[-1])]
                offsets = upto[ends[low : high + 1] - ends[low]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([docs[low:high], lists], ["doc_id", "ids"])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text -> doc_id, ids."""
    # A row is a block here: by number of rows alone, a batch would hold all blocks of a task.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK))
    found = F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0))
    words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(found)
    blocks = docs.select(F.col("doc_id").cast("long"), words.alias("words")).mapInArrow(
        _blocks(vocabulary),
        "doc_ids array<bigint>, sizes binary, codes binary, known bigint, units array<binary>, starts array<array<bigint>>",
    )
    folded = _with_tables(vocabulary, lambda t: F.zip_with("units", "starts", lambda u, s: _unit(t, u, s)))
    return blocks.select("doc_ids", "sizes", "codes", "known", folded.alias("states")).mapInArrow(
        _spread, "doc_id bigint, ids array<int>"
    )


def digests(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids -> doc_id, counts and hashes of the ids and of the text decoded from them."""

    def of(t: Column) -> Column:
        ids = F.col("ids")
        return F.struct(F.sha2(packed(t, ids), 256).alias("ids"), F.sha2(decode(t, ids), 256).alias("text"))

    made = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _with_tables(vocabulary, of).alias("d"))
    return made.select("doc_id", "n_tokens", F.col("d.ids").alias("ids_sha256"), F.col("d.text").alias("decoded_sha256"))
