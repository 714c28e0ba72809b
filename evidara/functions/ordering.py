"""Order-sensitive building blocks that never put one key's rows into one task.

``first_by`` / ``last_by`` combine on the map side.  ``running_total`` and
``block_edges`` split a key into bounded blocks and order the blocks.  ``position``
numbers rows globally through a range partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.session import settle, stored

# Most hashes of shared keys that are sent to all tasks (8 bytes each).
FEW = 1 << 20


def first_by(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order`` (first-wins deduplication)."""
    return _extreme(df, keys, order, F.min_by)


def last_by(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the last in ``order`` (last-write-wins)."""
    return _extreme(df, keys, order, F.max_by)


def apart(df: DataFrame, keys: Sequence[Column | str]) -> tuple[DataFrame | None, DataFrame]:
    """Rows that are alone with their key, and rows that may share it; the first are null when too many share one.

    Only a hash of the key and a count travel.  ``df`` is read up to three times, so it should be a
    scan or a stored table.  A shared hash can only send a row to the second part, where whole keys decide.
    """
    hashed = F.xxhash64(*keys)
    counted = df.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    shared = stored(counted.select("_h"))
    if shared.count() > FEW:
        return None, df
    few, tagged = F.broadcast(shared), df.withColumn("_h", hashed)
    return tagged.join(few, "_h", "left_anti").drop("_h"), tagged.join(few, "_h", "left_semi").drop("_h")


def first_by_apart(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """``first_by`` for rows of which most are alone with their key: those stay where they lie."""
    alone, shared = apart(df, keys)
    kept = first_by(shared, keys, order)
    return kept if alone is None else alone.unionByName(kept)


def _extreme(df: DataFrame, keys, order, pick) -> DataFrame:
    """Columns that are keys themselves are read off the group, so each travels once."""
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = {k: f"_k{i}" for i, k in enumerate(keys) if isinstance(k, str) and k in df.columns}
    ranked = [F.col(o) if isinstance(o, str) else o for o in order]
    by = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(ranked)])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in held]
    row = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_"))
    picked = df.groupBy(*named).agg(pick(row, by).alias("_row"))
    return picked.select(*[F.col(held[c]).alias(c) if c in held else F.col(f"_row.`{c}`") for c in df.columns])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most ``k`` rows per key.  Spark limits groups before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = 4096
) -> DataFrame:
    """Sum of ``value`` over the rows of the key with a smaller integer ``order``.

    ``order`` must be unique per key.  Blocks of ``block`` consecutive order values are
    summed first; only block sums are ordered per key, and rows are ordered per block.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sums = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(offsets, [*keys, "_block"])
    return joined.withColumn(out, F.col("_local") + F.col("_offset")).drop("_block", "_local", "_offset")


def block_edges(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: str
) -> DataFrame:
    """Per (key, block) in ``order``: first, last, row count and whether ``value`` never falls."""
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    stepped = df.withColumn("_previous", F.lag(value).over(inside))
    place = F.struct(*order)
    return stepped.groupBy(*keys, block).agg(
        F.min_by(value, place).alias("first"),
        F.max_by(value, place).alias("last"),
        F.count("*").alias("points"),
        F.bool_and(F.coalesce(F.col("_previous") <= F.col(value), F.lit(True))).alias("rising"),
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "position", partitions: int | None = None,
    helpers: Sequence[str] = (),
) -> DataFrame:
    """1-based row number per key over any group size.

    Rows are range-partitioned by (keys, order) and sorted inside partitions; the
    number inside a partition plus the group's rows in earlier partitions is the
    position.  Only one row per (partition, key) is ordered per key.  ``helpers`` are columns
    that serve the order alone; they are left out before the rows are fixed.
    """
    ranged = [*[F.col(k) for k in keys], *order]
    if partitions:
        spread = df.repartitionByRange(partitions, *ranged)
    else:
        spread = df.repartitionByRange(*ranged)
    spread = spread.sortWithinPartitions(*ranged)
    numbered = spread.withColumn("_row", F.monotonically_increasing_id()).drop(*helpers)
    # The row ids depend on the physical layout, so they are fixed before both uses.
    numbered = settle(numbered.withColumn("_part", F.shiftright("_row", 33)))
    parts = numbered.groupBy(*keys, "_part").agg(F.min("_row").alias("_low"), F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_part", "_low", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))
    joined = numbered.join(offsets, [*keys, "_part"])
    return joined.withColumn(out, F.col("_row") - F.col("_low") + F.col("_offset") + 1).drop(
        "_row", "_part", "_low", "_offset"
    )
