"""Near copies by SimHash of five-word shingles, at a Jaccard similarity of 0.8 or more.

A fingerprint of ``BITS`` bits is a SimHash of the set of a text's shingles.  Two texts of Jaccard
similarity J differ in about arccos(2J / (1 + J)) / pi of their bits, 0.15 at 0.8; too many for a
join with an error budget on all of them.  So the join has several tables.  A table takes ``lead`` of the
bits, which a pair must share, and a trie over ``CHECK`` further bits, whose node pairs are walked
together under an error budget.  The number of leading bits follows the number of texts, so a cell
holds a few unrelated texts at any size, and the number of tables follows from it: a pair at
0.8 shares a cell in at least one with probability ``RECALL``.

A group of near copies fills its cells.  A walk there runs under rising budgets: what a budget links becomes
one component, and a pair of nodes wholly inside a component is dropped, so near texts are
linked first and a group costs little more than its texts.  A cell above ``CELL`` texts is cut into parts that meet pairwise.
Each task reports a spanning forest of nearest links.  The whole fingerprints
then tell most links: ``SURE`` standard errors below what 0.8 has, a link stays; ``MOST`` above, it goes; between,
the shingle sets of the two texts are compared exactly.

Defined results: a null text is empty; texts without words are near copies of each other and of no
other; fewer words than a shingle make one shingle; repeated rows are copies; rows with a null id are
treated like others, but a row with an id is preferred; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.base import settle, sized
from evidara.llm.simhash import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.95
BITS, CHECK = 2048, 64
MOST, SURE = 3.0, 4.0
WORDS = BITS // 64
SEED = 42
# Texts of a cell that are walked as one; texts of a task.
CELL, TASK_ROWS = 16_384, 200_000
# Rising budgets of a walk, as differing bits of ``CHECK``.
ROUNDS = (4, 8, 12, 17)
FRONTIER, EDGES = 1 << 19, 1 << 20
# Ends of unsure links (two longs each) that may be broadcast; above, they are joined by a shuffle.
BROADCAST_ROWS = 500_000

_STEP = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _bits(similarity: float, errors: float) -> int:
    share = differing(similarity)
    return int(BITS * share + errors * math.sqrt(BITS * share * (1 - share)))


def most_differing(similarity: float = SIMILARITY) -> int:
    """Differing bits of ``BITS`` up to which two texts may be near copies."""
    return _bits(similarity, MOST)


def sure_differing(similarity: float = SIMILARITY) -> int:
    """Differing bits of ``BITS`` up to which two texts are near copies without a further look."""
    return _bits(similarity, -SURE)


def layout(texts: int) -> tuple[int, int]:
    """Leading bits of a table and the number of tables, for so many distinct texts."""
    lead = max(16, math.ceil(math.log2(max(texts, 2))) - 2)
    miss = 1 - (1 - differing(SIMILARITY)) ** lead
    return lead, math.ceil(math.log(1 - RECALL) / math.log(miss))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the word shingles of the lower-cased (A-Z) text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    one = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((one(whole[a:b], SEED) for a, b in spans), np.uint64, n))


def fingerprint(text: str, shingle: int = SHINGLE) -> bytes:
    """A bit is 1 if it is set in over half of the hashes of the text's distinct shingles."""
    hashed = shingles(text, shingle)
    ones = np.zeros(BITS, np.int64)
    # At most 255 hashes at once, so a byte holds each count.
    for low in range(0, len(hashed), 255):
        # Each shingle hash is mixed into as many words as the fingerprint has.
        x = hashed[low : low + 255, None] + _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashed)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark -> doc_id, mark, wide (the fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = [fingerprint(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(wide, pa.binary())], ["doc_id", "mark", "wide"])

    return docs.select(F.col("doc_id").cast("long"), "text", "mark").mapInArrow(run, "doc_id long, mark long, wide binary")


# ------------------------------------------------------------------------ the walk of a task


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of a least spanning forest of the edges over the labels, which are merged in place."""
    chosen = [np.zeros(0, np.int64)]
    live = np.lexsort((b, a, cost))
    while len(live):
        x, y = label[a[live]], label[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        if not len(live):
            break
        # Each component takes its first edge; edges are in one strict order, so no cycle closes.
        place = np.arange(len(live))
        first = np.full(len(label), len(live))
        np.minimum.at(first, x, place)
        np.minimum.at(first, y, place)
        picked = np.unique(first[np.concatenate((x, y))])
        chosen.append(live[picked])
        x, y = x[picked], y[picked]
        root = np.arange(len(label))
        while True:
            p, q = root[x], root[y]
            apart = p != q
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart]))
            while not np.array_equal(root, root[root]):
                root = root[root]
        label[:] = root[label]
    return np.concatenate(chosen)


def walk(leaves: np.ndarray, pairs: np.ndarray, budgets: tuple[int, ...] = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions a, b) of a spanning forest of leaves that differ in at most the last budget's bits.

    ``pairs`` has rows (a_low, a_high, b_low, b_high): runs of ``leaves``, each sorted; a run paired with
    itself is joined with itself.
    """
    label = np.arange(len(leaves))
    run = np.zeros(len(leaves), np.int64)
    run[pairs[:, 0]] = 1
    run[pairs[:, 2]] = 1
    run = np.cumsum(run)
    own = pairs[(pairs[:, 0] == pairs[:, 2])]
    alone = np.isin(run, run[own[:, 0]])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ones: dict[int, np.ndarray] = {}

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        a, b = a[apart := label[a] != label[b]], b[apart]
        picked = _spanning(label, a, b, np.bitwise_count(leaves[a] ^ leaves[b]))
        left.append(a[picked])
        right.append(b[picked])

    for budget in budgets:
        # Neighbours in sorted order first: most of a group of near copies is linked by them.
        for gap in (1, 2, 3):
            a = np.flatnonzero((run[:-gap] == run[gap:]) & alone[gap:]) if len(leaves) > gap else np.zeros(0, np.int64)
            near = np.bitwise_count(leaves[a] ^ leaves[a + gap]) <= budget
            keep(a[near], a[near] + gap)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1]))) if len(label) else label
        stack = [(0, pairs, np.zeros(len(pairs), np.int64))]
        while stack:
            depth, nodes, spent = stack.pop()
            if len(nodes) > FRONTIER:
                half = len(nodes) // 2
                stack += [(depth, nodes[:half], spent[:half]), (depth, nodes[half:], spent[half:])]
                continue
            al, ah, bl, bh = nodes.T
            one = (label[al] == label[bl]) & (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl])
            nodes, spent = nodes[~one], spent[~one]
            single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
            a, b = nodes[single, 0], nodes[single, 2]
            near = np.bitwise_count(leaves[a] ^ leaves[b]) <= budget
            if near.any():
                found.append((a[near], b[near]))
                waiting += int(near.sum())
            nodes, spent = nodes[~single], spent[~single]
            if waiting > EDGES or (not stack and waiting and (not len(nodes) or depth == CHECK)):
                keep(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                found, waiting = [], 0
                changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
            if not len(nodes):
                continue
            if depth == CHECK:
                # Equal leaves: a chain through both runs.
                for low, high, other in nodes[:, :3].tolist():
                    keep(np.arange(low, high - 1), np.arange(low + 1, high))
                    keep(np.array([low]), np.array([other]))
                for low, high in nodes[:, 2:].tolist():
                    keep(np.arange(low, high - 1), np.arange(low + 1, high))
                continue
            if depth not in ones:
                bit = (leaves >> np.uint64(CHECK - 1 - depth)) & np.uint64(1)
                ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
            count = ones[depth]
            al, ah, bl, bh = nodes.T
            am, bm = ah - (count[ah] - count[al]), bh - (count[bh] - count[bl])
            same = al == bl
            out, cost = [], []
            for x0, x1, y0, y1, more in ((al, am, bl, bm, 0), (am, ah, bm, bh, 0), (al, am, bm, bh, 1), (am, ah, bl, bm, 1)):
                ok = (x1 > x0) & (y1 > y0) & (spent + more <= budget)
                ok &= ~((x0 == y0) & (x1 - x0 == 1))
                if x0 is am and y0 is bl:
                    ok &= ~same
                out.append(np.stack([x0[ok], x1[ok], y0[ok], y1[ok]], axis=1))
                cost.append(spent[ok] + more)
            stack.append((depth + 1, np.concatenate(out), np.concatenate(cost)))
    return np.concatenate(left), np.concatenate(right)


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (turn, lead, cell, side, fp, bits) sorted by the first four -> links (a, b).

    Cells are complete in a task and of bounded size; as many as make ``4 * CELL`` rows are walked at once.
    """

    def links(table: pa.Table) -> pa.RecordBatch:
        turn, lead, cell, side, fp, bits = (table.column(i).to_numpy() for i in range(6))
        value = bits.view(np.uint64)
        place = np.lexsort((value, side, cell, lead, turn))
        keys = [k[place] for k in (turn, lead, cell)]
        side, value, fp = side[place], value[place], fp[place]
        fresh = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        cells = np.concatenate(([0], np.cumsum(fresh)))
        start = np.flatnonzero(np.concatenate(([True], fresh | (side[1:] != side[:-1]))))
        stop = np.concatenate((start[1:], [len(value)]))
        alone = (side[start] == 0) & (stop - start > 1)
        runs = np.stack([start[alone], stop[alone], start[alone], stop[alone]], axis=1)
        # Sides 1 and 2 of a cell follow each other and meet each other only.
        two = np.flatnonzero((side[start[:-1]] == 1) & (side[start[1:]] == 2) & (cells[start[:-1]] == cells[start[1:]]))
        both = np.stack([start[two], stop[two], start[two + 1], stop[two + 1]], axis=1)
        a, b = walk(value, np.concatenate([runs, both]))
        a, b = fp[a], fp[b]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < 4 * CELL:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(i).to_numpy() for i in range(3)]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        if len(cut):
            whole = int(cut[-1]) + 1
            yield links(table.slice(0, whole))
            held, rows = table.slice(whole).to_batches(), table.num_rows - whole
    if rows:
        yield links(pa.Table.from_batches(held))


def _tables(lead: int, tables: int):
    """fp, wide -> a row (turn, lead, fp, bits) for each table.

    Tables take slices of seeded permutations of all bits, so no bit serves twice before all have served.
    """
    rng = np.random.default_rng(SEED)
    rounds = -(-lead * tables // BITS)
    places = np.concatenate([rng.permutation(BITS) for _ in range(rounds)])[: lead * tables].reshape(tables, lead)
    weight = 1 << np.arange(lead - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            bit = np.unpackbits(wide, axis=1)
            words = wide.view(">u8")
            for turn, own in enumerate(places):
                top = bit[:, own].astype(np.int64) @ weight
                check = words[:, turn % WORDS].astype(np.uint64).view(np.int64)
                turns = np.full(batch.num_rows, turn, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(turns), pa.array(top), batch.column(0), pa.array(check)], ["turn", "lead", "fp", "bits"])

    return run


def links(distinct: DataFrame, texts: int) -> DataFrame:
    """fp, wide (distinct) -> spanning links (a, b) of near copies."""
    lead, tables = layout(texts)
    rows = distinct.select("fp", "wide").mapInArrow(_tables(lead, tables), "turn int, lead long, fp long, bits long")
    sizes = rows.groupBy("turn", "lead").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = sizes.select("turn", "lead", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    placed = rows.join(large, ["turn", "lead"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.withColumn("other", F.explode(others))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    cells = placed.select(
        "turn", "lead",
        F.when(F.col("parts").isNull(), 0).otherwise(low * F.col("parts") + high).cast("long").alias("cell"),
        F.when(F.col("parts").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
        "fp", "bits",
    )
    keys = ["turn", "lead", "cell"]
    dealt = cells.repartition(sized(texts * tables, TASK_ROWS, 2), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_task, "a long, b long").distinct()


def _with_both(found: DataFrame, distinct: DataFrame, column: str) -> DataFrame:
    """Links (a, b) with the column of both ends as ``one`` and ``two``; ends without it go."""
    first = found.join(distinct.select(F.col("fp").alias("a"), F.col(column).alias("one")), "a")
    return first.join(distinct.select(F.col("fp").alias("b"), F.col(column).alias("two")), "b").select("a", "b", "one", "two")


def measured(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links that the whole fingerprints allow, with ``sure``: they alone show a similarity above the least."""
    least, most = sure_differing(), most_differing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, WORDS) for i in (2, 3))
            bits = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
            near = pa.array(bits <= most)
            columns = [batch.column(0), batch.column(1), pa.array(bits <= least)]
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in columns], ["a", "b", "sure"])

    return _with_both(found, distinct, "wide").mapInArrow(run, "a long, b long, sure boolean")


def similar(pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b, one, two: texts) whose shingle sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for row in range(batch.num_rows):
                one, two = (shingles(batch.column(i)[row].as_py()) for i in (2, 3))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                near[row] = shared >= least * (len(one) + len(two) - shared)
            kept = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links (a, b) of near copies among ``distinct`` (fp, wide, mark: the hash of one such text of ``docs``)."""
    found = settle(measured(links(distinct, distinct.count()), distinct))
    unsure = found.where("not sure").select("a", "b")
    ends = settle(unsure.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(distinct.select("fp", "mark"), "fp"))
    wanted = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends
    held = docs.select(F.xxhash64("text").alias("mark"), "text").join(wanted, "mark")
    held = settle(held.groupBy("fp").agg(F.min("text").alias("text")))
    exact = similar(_with_both(unsure, held, "text"))
    return found.where("sure").select("a", "b").unionByName(exact)


def heads(docs: DataFrame, text_hash: str = "text_hash") -> DataFrame:
    """doc_id, text -> (doc_id, xxhash64 of the text) of one row of each group of near copies.

    The row with the smallest doc_id, null ids last; of equal ids the smallest text hash.
    """
    marked = fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    distinct = marked.groupBy("wide").agg(F.min(row).alias("head"))
    distinct = settle(distinct.select(F.xxhash64("wide").alias("fp"), "wide", "head", F.col("head.mark").alias("mark")))
    found = components(near_links(docs, distinct)).withColumnRenamed("node", "fp")
    placed = distinct.select("fp", "head").join(found, "fp", "left")
    chosen = placed.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("head").alias("head"))
    return chosen.select("head.doc_id", F.col("head.mark").alias(text_hash))
