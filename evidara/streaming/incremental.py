"""Incremental ingest, embedding back-fill and threshold counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidara.functions.values import compare
from evidara.operators import ingest, search
from evidara.sources import files as S

CATALOGUE = "workspace_id string, id bigint, filename string, content_hash string, batch_id bigint"


def _catalogue(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Catalogue rows of earlier micro-batches; a retried batch does not see its own rows."""
    try:
        rows = spark.read.schema(CATALOGUE).parquet(path)
    except AnalysisException as fault:
        # The catalogue does not exist before the first batch; any other failure is one.
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CATALOGUE)
    return rows.where(F.col("batch_id") < before)


def ingest_stream(
    spark: SparkSession, source: str, catalogue: str, statuses: str, checkpoint: str, workspace: str = "local"
) -> StreamingQuery:
    """Watch a folder; every micro-batch is gated, hashed and deduplicated against the catalogue.

    Both outputs are partitioned by ``batch_id`` and overwritten per batch, so a batch that is
    replayed after a failure replaces its own rows.
    """
    files = spark.readStream.format("binaryFile").schema(_file_schema()).load(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        named = S.named_files(batch)
        uploads = named.select(
            F.lit(workspace).alias("workspace_id"),
            F.xxhash64("path").alias("ord"),
            "path",
            "filename",
            ingest.content_hash("content").alias("content_hash"),
            S.reject_reason().alias("reject_reason"),
        )
        known = _catalogue(session, catalogue, batch_id)
        rows = ingest.classify_uploads(uploads, known).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows = rows.persist()
        _replace_batch(rows, statuses)
        fresh = rows.where(F.col("status") == "uploaded")
        _replace_batch(fresh.select("workspace_id", F.col("ord").alias("id"), "filename", "content_hash", "batch_id"), catalogue)
        rows.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace_batch(rows: DataFrame, path: str) -> None:
    writer = rows.write.mode("overwrite").partitionBy("batch_id").option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _file_schema():
    from evidara import schemas

    return schemas.FILES


def backfill_stream(
    chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Embed only chunks without a vector.  ``embed`` maps (keys, text) rows to (keys, embedding)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = embed(search.missing_embeddings(batch)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        _replace_batch(rows, path)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def breach_counts(readings: DataFrame, keys: list[str], value: str, threshold: float, operator: str = ">") -> DataFrame:
    """Streaming aggregate of threshold breaches and peaks; the same aggregate as in batch."""
    return readings.groupBy(*keys).agg(
        F.count_if(compare(value, operator, F.lit(threshold))).alias("breach_count"), F.max(value).alias("peak_value")
    )
