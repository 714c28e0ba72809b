"""Ranked lexical search over a length-stratified index.

A document's normaliser m follows from its length; documents of equal m form a stratum.  Strata are
dealt to blocks of bounded postings: neighbouring strata share a band, and a band with more postings than a block holds
is spread over several by a hash.  In a block a term's postings lie by
stratum and, inside, by tf, so an impact is computed once per (stratum, tf) and stored with its group.

A search meets every block with every block of items.  For an item, each stratum has a bound, the
weighted sum of the terms' greatest impacts there; strata are visited in the order of their bounds until
the next one is below the k-th score, so the answer is exact.  At most k rows per item leave a block.

The terms of the items thin the index while it is built: a bitmap of ``BITS`` hashed places (a fixed
size whatever the number of items) lets every term of an item pass and few others, which match nothing.

Defined results: a null, empty or term-free text is no document and no item; an item without a
matching document has no row; very long texts count whole; equal scores go by doc_id, a null id last;
repeated documents are ranked each on their own, repeated rows of an item (equal id and text) count
once, different texts of one id are separate items; other columns are ignored; empty tables give no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.base import settle, sized

# Letters and digits of ASCII in lower case, and all bytes beyond; the others separate terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BITS = 1 << 23
# Postings and documents of a block; terms of a block of items.
BLOCK = 2_000_000
ITEM_BLOCK = 200_000
# Documents that the first visit of a block reads at least.
FIRST = 512
LENGTH, SATURATION, SCALE = 75, 8, 1_000_000_000


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def places(items: DataFrame) -> bytes:
    """The bitmap of the items' terms, BITS / 8 bytes."""
    place = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(BITS - 1))
    made = items.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b"))
    flags = np.zeros(BITS // 8 + 8192, np.uint8)
    for row in made.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect():
        # Bucket b > 0 holds the places from 1 + (b - 1) * 32768 on, bucket 0 place 0.
        at = row["b"] * 4096
        flags[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return flags.tobytes()


def counted(docs: DataFrame, wanted: bytes | None = None) -> DataFrame:
    """doc_id, text -> doc_id, n, its terms (joined by blanks) and their tf.  Documents without terms go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little") if wanted else None
        flags = None
        if bits is not None:
            # Place p > 0 is bit p - 1 of the buckets from 1 on.
            flags = bytes(np.concatenate([bits[:1], bits[32768 : 32768 + BITS]]))
        for batch in batches:
            ids, sizes, kept, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms(text or "")
                if not own:
                    continue
                found = Counter(own)
                if flags is not None:
                    found = {t: c for t, c in found.items() if flags[crc32(t) & (BITS - 1)]}
                ids.append(doc_id)
                sizes.append(len(own))
                kept.append(b" ".join(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(tfs, pa.list_(pa.int32()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tfs array<int>")


def build(table: pa.Table) -> pa.Table:
    """The documents of a block -> a row for each term, and one (null term) for the block itself.

    The block's row: ids in the order of (m, id), first position of each stratum.  A term's row: stratum,
    impact and end of each group of equal tf, then the positions of its documents, group after group.
    """
    table = table.sort_by([("m", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    m = table.column("m").to_numpy()
    strata, firsts = np.unique(m, return_index=True)
    stratum_of = np.searchsorted(strata, m)
    words = [bytes(x.as_py()).split() for x in table.column("terms")]
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    term = flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(m)), [len(own) for own in words])
    tf = table.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((doc, tf, stratum_of[doc], term))
    term, doc, tf = term[order], doc[order].astype(np.int32), tf[order]
    stratum = stratum_of[doc].astype(np.int32)
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])][: len(term)])
    impact = SCALE * tf[starts] // (1000 * tf[starts] + SATURATION * strata[stratum[starts]])
    ends = np.append(starts, len(term))[1:]
    heads = np.flatnonzero(np.r_[True, term[starts][1:] != term[starts][:-1]][: len(starts)])
    tails = np.append(heads, len(starts))[1:]
    lists = {name: [None] for name in ("strata", "impacts", "ends", "docs")}
    for head, tail in zip(heads, tails, strict=True):
        low = starts[head]
        lists["strata"].append(stratum[starts[head:tail]])
        lists["impacts"].append(impact[head:tail])
        lists["ends"].append((ends[head:tail] - low).astype(np.int32))
        lists["docs"].append(doc[low : ends[tail - 1]])
    names = flat.dictionary.take(pa.array(term[starts[heads]])).cast(pa.string()).to_pylist() if len(heads) else []
    rows = 1 + len(names)
    one = pa.array([table.column("block")[0].as_py()] * rows, pa.int32())
    return pa.table(
        {
            "block": one,
            "term": pa.array([None, *names], pa.string()),
            "strata": pa.array(lists["strata"], pa.list_(pa.int32())),
            "impacts": pa.array(lists["impacts"], pa.list_(pa.int64())),
            "ends": pa.array(lists["ends"], pa.list_(pa.int32())),
            "docs": pa.array(lists["docs"], pa.list_(pa.int32())),
            "doc_ids": pa.array([table.column("doc_id").to_pylist()] + [None] * (rows - 1), pa.list_(pa.int64())),
            "firsts": pa.array([firsts.astype(np.int32)] + [None] * (rows - 1), pa.list_(pa.int32())),
        }
    )


INDEX = (
    "block int, term string, strata array<int>, impacts array<long>, ends array<int>, docs array<int>, "
    "doc_ids array<long>, firsts array<int>"
)


def index(docs: DataFrame, wanted: bytes | None = None) -> tuple[DataFrame, int, int]:
    """doc_id, text -> the index, its number of blocks and of documents."""
    held = settle(counted(docs, wanted))
    total = held.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    if not total["n"]:
        return docs.sparkSession.createDataFrame([], INDEX), 0, 0
    n = F.col("n").cast("decimal(38,0)") * F.lit(LENGTH) * F.lit(total["n"]).cast("decimal(19,0)")
    m = F.lit(100 - LENGTH) + F.call_function("div", n, F.lit(total["l"]).cast("decimal(19,0)"))
    held = held.withColumn("m", m.cast("long")).withColumn("band", F.floor(F.log2("m") * 4).cast("int"))
    # At most four bands for each power of two of m reach the driver.
    load = {r["band"]: r["load"] for r in held.groupBy("band").agg(F.sum(F.size("tfs") + 1).alias("load")).collect()}
    parts = {band: sized(n, BLOCK) for band, n in load.items()}
    firsts, blocks = {}, 0
    for band in sorted(parts):
        firsts[band], blocks = blocks, blocks + parts[band]
    low, high = min(parts), max(parts)
    of = lambda table: F.get(F.array(*[F.lit(table.get(b, 0)) for b in range(low, high + 1)]), F.col("band") - low)
    # Equal rows share a block, so the hash takes more than the id.
    share = F.pmod(F.xxhash64("doc_id", "n", F.hash("terms"), "tfs"), F.greatest(F.lit(1), of(parts)))
    dealt = held.select("doc_id", "m", "terms", "tfs", (of(firsts) + share).cast("int").alias("block"))
    return settle(dealt.groupBy("block").applyInArrow(build, INDEX)), blocks, total["n"]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, text -> item_id, item (the id and a hash of the text), term, times."""
    own = items.select(F.col("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    item = F.concat_ws(":", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.md5(F.col("text").cast("binary")))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate("text", letters, letters.lower()), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return own.select("item_id", item.alias("item"), F.explode(found).alias("term")).groupBy("item_id", "item", "term").agg(F.count("*").alias("times"))


class Block:
    """The rows of a block's index, ready to be searched."""

    def __init__(self, table: pa.Table) -> None:
        self.terms: dict[str, tuple] = {}
        names = table.column("term").to_pylist()
        for row, name in enumerate(names):
            if name is None:
                ids = table.column("doc_ids")[row].values
                self.null = ids.is_null().to_numpy(zero_copy_only=False)
                self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                firsts = table.column("firsts")[row].values.to_numpy()
                self.sizes = np.diff(np.r_[firsts, len(self.ids)])
            else:
                strata, impacts, ends, docs = (table.column(c)[row].values.to_numpy() for c in ("strata", "impacts", "ends", "docs"))
                last = np.flatnonzero(np.r_[strata[1:] != strata[:-1], True])  # impacts rise with tf
                self.terms[name] = (strata, impacts, np.diff(np.r_[0, ends]), docs, strata[last], impacts[last])

    def search(self, item: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best documents for (term, weight)s."""
        own = [(*self.terms[t], w) for t, w in item if t in self.terms]
        bound = np.zeros(len(self.sizes), np.int64)
        for *_, strata, greatest, weight in own:
            bound[strata] += weight * greatest
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        scores = np.zeros(len(self.ids), np.int64)
        upto, floor, read = 0, 1, FIRST
        covered = np.cumsum(self.sizes[order])
        while upto < len(order) and bound[order[upto]] >= floor:
            more = max(upto + 1, int(np.searchsorted(covered, read)) + 1)
            visit = order[upto:more]
            visit = visit[bound[visit] >= floor]
            chosen = np.zeros(len(bound), bool)
            chosen[visit] = True
            for strata, impacts, counts, docs, _, _, weight in own:
                group = chosen[strata]
                if group.any():
                    at = docs if group.all() else docs[np.repeat(group, counts)]
                    scores[at] += np.repeat(weight * impacts[group], counts[group])
            best = scores[scores > 0]
            if len(best) >= k:
                floor = int(np.partition(best, len(best) - k)[len(best) - k])
            upto, read = more, 4 * read
        found = np.flatnonzero(scores >= floor)
        found = found[np.lexsort((self.ids[found], self.null[found], -scores[found]))][:k]
        return found, scores[found]


FOUND = "item string, doc_id long, score long"


def search(indexed: tuple[DataFrame, int, int], items: DataFrame, k: int) -> DataFrame:
    """The index and ``item_terms`` -> item_id, rank, doc_id, score."""
    stored, blocks, documents = indexed
    holds = stored.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    ratio = F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double")
    weight = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    weighed = items.join(holds, "term").select("item_id", "item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")
    asked = settle(weighed.groupBy("item_id", "item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")))
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    item_blocks = sized(size, ITEM_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))
    left = asked.select("item", "terms", "weights", F.pmod(F.hash("item"), F.lit(item_blocks)).alias("item_block"), every(blocks).alias("block"))
    right = stored.withColumn("item_block", every(item_blocks))

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        names, ids, scores = [], [], []
        if some.num_rows and rows.num_rows:
            block = Block(rows)
            for item, own, weights in zip(*(some.column(c).to_pylist() for c in ("item", "terms", "weights")), strict=True):
                at, score = block.search(list(zip(own, weights, strict=True)), k)
                names += [item] * len(at)
                ids += [None if block.null[i] else int(block.ids[i]) for i in at]
                scores += score.tolist()
        return pa.table({"item": pa.array(names, pa.string()), "doc_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    keys = ("block", "item_block")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, FOUND)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = asked.select("item", "item_id")
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def top_k(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """doc_id, text and item_id, text -> item_id, rank, doc_id, score."""
    asked = settle(item_terms(items))
    return search(index(docs, places(asked)), asked, k)
