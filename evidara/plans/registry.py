"""Registration of queries: a Spark callable, its SQL twin, and the inventory rows it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


class Tables:
    """The given parquet tables by name: ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.plans: dict[str, object] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.once(name, lambda: self._read(name))

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df, "doc_id") if name == "documents" else df

    def once(self, name: str, make: Callable[[], object]):
        """Build a plan once per query, so shared parts are one plan (and one exchange)."""
        if name not in self.plans:
            self.plans[name] = make()
        return self.plans[name]


# Share of a core's fair load that the fullest split may hold before rows are dealt out anew.
UNEVEN = 1.25


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows over the cores when a table arrives in too few or too uneven splits.

    Text rules are CPU-bound.  A file is cut into splits by bytes, but a row group is read by
    one split alone, so a large file with one row group has many splits and one with rows.  A
    table whose rows lie in enough splits is left as it is scanned, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and _even(df, cores):
        return df
    return df.repartition(max(cores, splits), key)


def _even(df: DataFrame, cores: int) -> bool:
    """Whether no split holds much more than a core's share; counts rows and reads no column."""
    held = df.groupBy(F.spark_partition_id().alias("split")).count()
    most, rows = held.agg(F.max("count"), F.sum("count")).first()
    return rows is None or most * cores <= UNEVEN * rows


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
