"""Typed scans of readings and inventory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.values import as_number


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV as text columns (a byte-order mark is accepted)."""
    ddl = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, header=True, schema=ddl, enforceSchema=False, encoding="UTF-8")


def typed(df: DataFrame, numbers: list[str], timestamps: list[str] = ()) -> DataFrame:
    """Text columns to doubles (bad numbers become 0.0) and timestamps (bad ones null)."""
    changes = {c: as_number(c) for c in numbers}
    changes.update({c: F.try_to_timestamp(F.col(c)) for c in timestamps})
    return df.withColumns(changes)
