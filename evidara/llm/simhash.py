"""SimHash near-duplicates by a binary trie that is joined with itself.

Fingerprints that differ in at most ``BUDGET`` of 64 bits are linked.  Only distinct
fingerprints are joined; copies meet in a map-side aggregate, not in the join.

The join walks pairs of trie nodes, adds up differing bits and drops a pair once the budget is
spent.  To run it on many machines the trie is built in several bit orders: 64 bits are cut
into ``BLOCKS`` blocks, and for each choice of blocks one order puts these blocks first.  A
pair within the budget leaves at least ``BLOCKS - BUDGET`` blocks untouched, so in some order
it agrees on all leading bits.  There the top of the trie needs no error budget and its subtrees
(one for each value of the leading bits) are joined apart from each other.  A subtree with more
than ``SUBTREE`` leaves is cut into parts of that size by a hash, and pairs of parts are joined
in tasks of their own.  A task reports a spanning forest of what it has linked, never all pairs.

Components come from these links by alternating large-star and small-star steps, each written
to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.base import settle, sized

BUDGET, BLOCKS, SHINGLE = 3, 5, 3
SUBTREE = 16_384
# Distinct fingerprints for one task of the join, in one bit order.
TASK_ROWS = 100_000
FRONTIER = 1 << 20
EDGES = 1 << 21
SEED = 42

_WIDTHS = [64 // BLOCKS + (i < 64 % BLOCKS) for i in range(BLOCKS)]
_STARTS = [sum(_WIDTHS[:i]) for i in range(BLOCKS)]
ORDERS = [(*lead, *[b for b in range(BLOCKS) if b not in lead]) for lead in combinations(range(BLOCKS), BLOCKS - BUDGET)]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text; a text without words has fingerprint zero.

    Words are separated by ASCII blanks; a bit is 1 if it is set in over half of all shingle
    hashes, repeats included.  Fewer words than a shingle has make one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    one = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    # Long texts are counted in pieces, so memory does not grow with 64 times the words.
    for low in range(0, n, 65536):
        part = [one(whole[a:b], SEED) for a, b in zip(starts[low : low + 65536].tolist(), last[low : low + 65536], strict=False)]
        bits = np.unpackbits(np.array(part[: n - low], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, column: str = "fp") -> DataFrame:
    """``docs`` with its ``text`` replaced by the fingerprint, a signed long named ``column``."""
    place = docs.columns.index("text")
    names = [column if c == "text" else c for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t or "") for t in batch.column(place).to_pylist()], np.uint64)
            columns = list(batch.columns)
            columns[place] = pa.array(made.view(np.int64))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


# --------------------------------------------------------------- the trie join of one task


def turned(values: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """The 64-bit values with their blocks in the given order, the first block on top."""
    out = np.zeros_like(values)
    for block in order:
        width, start = _WIDTHS[block], _STARTS[block]
        out = (out << np.uint64(width)) | ((values >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1))
    return out


class Forest:
    """Components of leaves as labels, kept by hooking to the smaller label."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.waiting = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.left.append(a)
        self.right.append(b)
        self.waiting += len(a)
        if self.waiting > EDGES:
            self.fold()

    def fold(self) -> np.ndarray:
        if self.left:
            a, b = np.concatenate(self.left), np.concatenate(self.right)
            self.left, self.right, self.waiting = [], [], 0
            while True:
                x, y = self.label[a], self.label[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = self.label[self.label]
                    if np.array_equal(up, self.label):
                        break
                    self.label = up
        return self.label


def trie_join(leaves: np.ndarray, pairs: np.ndarray, top: int, forest: Forest, budget: int = BUDGET) -> None:
    """Walk node pairs of tries whose leaves are runs of ``leaves`` (sorted within a run).

    ``pairs`` has rows (a_low, a_high, b_low, b_high): runs that agree on the leading ``top``
    bits; a run paired with itself is a self-join.  Links of leaf positions go to ``forest``.
    """
    stack = [(top, pairs, np.zeros(len(pairs), np.int64))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, nodes, spent = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half], spent[:half]), (depth, nodes[half:], spent[half:])]
            continue
        # Two single leaves, or the end of the bits: the whole distance is known at once.
        size_a, size_b = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        single = (size_a == 1) & (size_b == 1)
        a, b = nodes[single, 0], nodes[single, 2]
        near = (a != b) & (np.bitwise_count(leaves[a] ^ leaves[b]) <= budget)
        if near.any():
            forest.link(a[near], b[near])
        nodes, spent = nodes[~single], spent[~single]
        if not len(nodes) or depth == 64:
            continue
        if depth not in ones:
            bit = (leaves >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        count = ones[depth]
        al, ah, bl, bh = nodes.T
        am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
        same = al == bl
        out, cost = [], []
        for x0, x1, y0, y1, more, keep in (
            (al, am, bl, bm, 0, None),
            (am, ah, bm, bh, 0, None),
            (al, am, bm, bh, 1, None),
            (am, ah, bl, bm, 1, ~same),
        ):
            ok = (x1 > x0) & (y1 > y0) & (spent + more <= budget)
            if keep is not None:
                ok &= keep
            # A single leaf against itself has nothing to link.
            ok &= ~((x0 == y0) & (x1 - x0 == 1))
            out.append(np.stack([x0[ok], x1[ok], y0[ok], y1[ok]], axis=1))
            cost.append(spent[ok] + more)
        stack.append((depth + 1, np.concatenate(out), np.concatenate(cost)))
    forest.fold()


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (turn, lead, cell, side, fp) sorted by these; emits spanning links of each cell.

    Cells are complete in a task and small, so a few of them are gathered and walked at once.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def walk(table: pa.Table) -> Iterator[pa.RecordBatch]:
        turn, side = table.column("turn").to_numpy(), table.column("side").to_numpy()
        lead, cell = table.column("lead").to_numpy(), table.column("cell").to_numpy()
        fp = table.column("fp").to_numpy()
        for order in np.unique(turn):
            own = turn == order
            value = turned(fp[own].view(np.uint64), ORDERS[order])
            place = np.lexsort((value, side[own], cell[own], lead[own]))
            leaves, s, c, d = value[place], side[own][place], cell[own][place], lead[own][place]
            fresh = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1]))))
            stop = np.concatenate((fresh[1:], [len(leaves)]))
            # Side 0 alone: joined with itself.  Sides 1 and 2: joined with each other only.
            alone = s[fresh] == 0
            runs = np.stack([fresh[alone], stop[alone], fresh[alone], stop[alone]], axis=1)
            runs = runs[runs[:, 1] - runs[:, 0] > 1]
            first = np.flatnonzero((s[fresh[:-1]] == 1) & (s[fresh[1:]] == 2) & (d[fresh[:-1]] == d[fresh[1:]]) & (c[fresh[:-1]] == c[fresh[1:]]))
            two = np.stack([fresh[first], stop[first], fresh[first + 1], stop[first + 1]], axis=1)
            forest = Forest(len(leaves))
            trie_join(leaves, np.concatenate([runs, two]), sum(_WIDTHS[b] for b in ORDERS[order][: BLOCKS - BUDGET]), forest)
            linked = np.flatnonzero(forest.label != np.arange(len(leaves)))
            ids = fp[own][place]
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[forest.label[linked]])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 4 * SUBTREE:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(k).to_numpy() for k in ("turn", "lead", "cell")]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        if not len(cut):
            continue
        whole = int(cut[-1]) + 1
        yield from walk(table.slice(0, whole))
        held, rows = table.slice(whole).to_batches(), table.num_rows - whole
    if held:
        yield from walk(pa.Table.from_batches(held))


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` that are near each other."""

    def leading(order: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for block in order[: BLOCKS - BUDGET]:
            width, start = _WIDTHS[block], _STARTS[block]
            part = F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1))
            out = F.shiftleft(out, width).bitwiseOR(part)
        return out

    heads = F.array(*[F.struct(F.lit(i).alias("turn"), leading(o).alias("lead")) for i, o in enumerate(ORDERS)])
    turns = distinct.select("fp", F.explode(heads).alias("h")).select("fp", "h.turn", "h.lead")
    # Only subtrees with two leaves or more; the large ones are cut into parts.
    sizes = turns.groupBy("turn", "lead").agg(F.count("*").alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > SUBTREE).select("turn", "lead", F.ceil(F.col("n") / SUBTREE).cast("int").alias("parts"))
    busy = turns.join(sizes.select("turn", "lead", "n"), ["turn", "lead"])
    small = busy.where(F.col("n") <= SUBTREE).select("turn", "lead", F.lit(0).alias("cell"), F.lit(0).alias("side"), "fp")
    cut = busy.where(F.col("n") > SUBTREE).join(large, ["turn", "lead"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    split = cells.select(
        "turn",
        "lead",
        (low * F.col("parts") + high + 1).cast("int").alias("cell"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "fp",
    )
    parts = sized(rows * len(ORDERS), TASK_ROWS, 2)
    keys = ["turn", "lead", "cell"]
    dealt = small.unionByName(split).repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_task, "a long, b long").distinct()


# ------------------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root), root the smallest node reachable; nodes without edges are absent.

    Alternates large-star and small-star until nothing changes.  Minima are map-side aggregates,
    so a node with very many neighbours is no burden for one task.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settle(small.select("e.*").where("a > b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def roots(distinct: DataFrame) -> DataFrame:
    """Distinct ``fp`` (any other columns are kept) -> the same with ``root``, equal within a component."""
    found = components(links(distinct.select("fp"), distinct.count()))
    placed = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    return placed.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, fp, component_id (the smallest doc_id reachable).

    A null text is empty; texts without words have fingerprint zero and are linked like any
    other; repeated rows stay, each with the same component; a null doc_id is never a minimum
    unless the component has no other id; an empty table gives an empty result.
    """
    marked = settle(fingerprints(docs.select("doc_id", "text")))
    placed = roots(settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def heads(docs: DataFrame, text_hash: str = "text_hash") -> DataFrame:
    """doc_id, text -> (doc_id, xxhash64 of the text) of one row of each component.

    The row with the smallest doc_id, null ids last; of equal ids the smallest text hash.
    """
    marked = fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    placed = roots(settle(marked.groupBy("fp").agg(F.min(row).alias("head"))))
    chosen = placed.groupBy("root").agg(F.min("head").alias("head"))
    return chosen.select("head.doc_id", F.col("head.mark").alias(text_hash))


def hexadecimal(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
