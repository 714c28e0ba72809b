"""Mixing sources to target weights by capped water-filling, with seeded repetitions.

Every source has a size (its words) and a weight.  The mix shares ``SHARE`` times all words by
weight; a source whose part exceeds ``EPOCHS`` times its size is clamped there and the excess is
shared again among the others until none is above.  Each round is one aggregate over the table of
sources (two numbers reach the driver), so the sources may be many; a round clamps one more source
at least, and on usual tables a handful of rounds is enough.

A source then repeats its documents: all of them as often as its target holds its whole size, and
once more those that come first in a seeded order until the target is met.  The one document in
which the target falls gives just the words that are left, so the words taken are the target,
rounded down.  The order is a hash of the id: sums per (source, range of hashes) place the target
in one range, and only the rows of that range, bounded whatever the size of the source, are ordered.

Only DataFrame functions are used.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of
its own, the last one; very long texts count whole; repeated rows and equal ids count and are taken
each on their own (equal hashes go by id, then size); rows with a null id hash as one; other columns are ignored,
whatever their names; a table without words has targets of 0; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions.ordering import position
from evidara.llm.base import settle, sized

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
# Of all words, as a fraction.
SHARE = (3, 2)
EPOCHS = 2
SEED = "mix-1:"
# Rows of a range of hashes within which documents are ordered.
RANGE_ROWS = 20_000
EXACT = "decimal(38,0)"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, text -> doc_id, source, size, and the source as a key without nulls."""
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size")
    )


def weighted(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """key, source, source_size -> with ``weight``: the given ones, repeating, by code point of the source."""
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    placed = position(sizes, [], [F.asc_nulls_last("source")], out="place")
    return placed.select("key", "source_size", F.get(cycle, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """key, source_size, weight -> key, source_size, target.

    Amounts are kept as whole multiples of 1 / share[1], so what is clamped is decided exactly.
    """
    over = share[1]
    cap = (F.col("source_size") * (epochs * over)).cast(EXACT)
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, weight = share[0] * (whole["size"] or 0), whole["weight"] or 0
    everything = left

    def above(left: int, weight: int) -> Column:
        """Is the part by weight of what is left above the cap?  Without weight left, all are clamped."""
        part = F.col("weight").cast(EXACT) * F.lit(left).cast(EXACT)
        return (part > cap * F.lit(weight).cast(EXACT)) if weight else F.lit(True)

    clamped = 0
    while weight:
        full = above(left, weight)
        found = sources.agg(
            F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("weight")
        ).first()
        if found["n"] == clamped:
            break
        clamped, left, weight = found["n"], everything - int(found["cap"]), found["weight"] or 0
    part = (F.col("weight") * F.lit(left)).cast("double") / F.lit(max(1, weight) * over).cast("double")
    target = F.when(above(left, weight), (F.col("source_size") * epochs).cast("double")).otherwise(part)
    return sources.select("key", "source_size", target.alias("target"))


def taken(docs: DataFrame, wanted: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, key, size and the targets -> doc_id, size, source_size, target, taken."""
    ranges = sized(docs.count(), RANGE_ROWS)
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    first = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    goal = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0).cast("long"))
    wanted = wanted.withColumn("goal", goal).withColumn("whole", whole)
    wanted = wanted.withColumn("extra", F.col("goal") - F.col("whole") * F.col("source_size")).drop("goal")
    dealt = docs.withColumn("hash", digest).withColumn("range", F.shiftright(first * F.lit(ranges), 32))
    sums = dealt.groupBy("key", "range").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(wanted, "key")
    # The extra words that a range gives: all of its words, none, or a part of them.
    given = F.greatest(F.lit(0), F.least(F.col("words"), F.col("extra") - F.col("before")))
    placed = before.select("key", "range", "words", "source_size", "target", "whole", given.alias("given"))
    met = dealt.join(placed, ["key", "range"])
    row = ["doc_id", "size", "source_size", "target"]
    repeated = F.col("whole") * F.col("size")
    all_or_none = (F.col("given") == 0) | (F.col("given") == F.col("words"))
    plain = met.where(all_or_none).select(
        *row, (repeated + F.when(F.col("given") > 0, F.col("size")).otherwise(F.lit(0))).alias("taken")
    )
    earlier = (
        Window.partitionBy("key", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = met.where(~all_or_none).withColumn("earlier", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("given") - F.col("earlier")))
    return plain.unionByName(cut.select(*row, (repeated + part).alias("taken")))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, text -> doc_id, size, source_size, target, taken."""
    counted = settle(measured(docs))
    sizes = counted.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    wanted = targets(weighted(sizes, weights), share, epochs)
    return taken(counted.drop("source"), wanted, seed)
