"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.session import settle, tune

__all__ = ["bucket_of", "numbered", "read", "session", "settle", "sized", "texts", "unused"]

# Rows per Arrow batch: whole texts travel, so a batch is kept short.
BATCH_ROWS = 256


def session(spark: SparkSession) -> SparkSession:
    """Runtime settings of the library, with Arrow batches short enough for long texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) only, so extra columns never clash with own ones."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def bucket_of(column: Column | str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus`` (null: of the empty text)."""
    value = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sized(rows: int, per_part: int, least: int = 1) -> int:
    """Number of parts that follows the rows counted."""
    return max(least, -(-int(rows) // per_part))


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (in any case of letters)."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by number: ``mapInArrow`` takes no name with a dot."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
