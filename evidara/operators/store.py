"""Table maintenance without row updates.

Derived tables are append-only with a partition for each run and attempt; a manifest names the attempt that
counts, and publishing a run is one row in the run log.  Readers follow the latest complete run of each workspace, so a failed
run leaves the old state and an empty result replaces the old one like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara import schemas
from evidara.functions import vocab as V
from evidara.functions.ordering import last_by
from evidara.functions.values import or_default


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Insert or overwrite all non-key columns; the last incoming row of a key wins."""
    newest = last_by(incoming, keys, [order]).drop(order) if order else incoming
    kept = stored.join(newest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(newest.select(*stored.columns))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the incoming rows whose key is new, once each."""
    fresh = incoming.select(*stored.columns).dropDuplicates(list(keys))
    return fresh.join(stored.select(*keys), list(keys), "left_anti")


def replace_workspaces(stored: DataFrame, new_rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Table content after the run: other workspaces unchanged, those of the run fully replaced."""
    kept = stored.join(workspaces.select("workspace_id").distinct(), "workspace_id", "left_anti")
    return kept.unionByName(new_rows.select(*stored.columns))


def delete_cascade(parents: DataFrame, removed: DataFrame, children: Mapping[str, tuple[DataFrame, Mapping[str, str]]], keys: Sequence[str]) -> dict[str, DataFrame]:
    """Parents and all child tables without the removed keys.

    ``children`` maps a table name to (table, {parent key: child column}).
    """
    gone = removed.select(*keys).distinct()
    result = {"parents": parents.join(gone, list(keys), "left_anti")}
    for name, (table, columns) in children.items():
        renamed = gone.withColumnsRenamed(dict(columns))
        result[name] = table.join(renamed, [columns.get(k, k) for k in keys], "left_anti")
    return result


def append_defaults(records: DataFrame, table: str) -> DataFrame:
    """Rows in table layout with the stored defaults for missing sources."""
    layout = schemas.TABLES[table]
    columns = []
    for field in layout.fields:
        if field.name not in records.columns:
            c = F.lit(None).cast(field.dataType)
        else:
            c = F.col(field.name).cast(field.dataType)
        if field.name == "source_page":
            c = F.coalesce(c, F.lit(1))
        elif field.name == "source_document":
            c = F.coalesce(c, F.lit(""))
        columns.append(c.alias(field.name))
    return records.select(*columns)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def stored_counts(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """Row count per stored table."""
    return table_counts({n: spark.read.parquet(f"{root}/{n}") for n in names})


def truncate(spark: SparkSession, root: str, names: Sequence[str]) -> None:
    """Empty stored tables; their schemas stay."""
    for name in names:
        schema = spark.read.parquet(f"{root}/{name}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


# -- run-partitioned derived tables ---------------------------------------------
MANIFEST = "table_name string, run_id bigint, attempt string"


def write_derived(tables: Mapping[str, DataFrame], root: str, run_id: int) -> None:
    """Write the rows of a run, all its workspaces at once, as a new attempt that the manifest then names.

    Readers see the named attempt only, so a failed write changes nothing, and after a retry no row of an
    earlier attempt is left in view, also where a workspace has no rows any more.
    """
    attempt = f"a{uuid.uuid4().hex}"
    for name, df in tables.items():
        rows = df.withColumns({"run_id": F.lit(run_id).cast("bigint"), "attempt": F.lit(attempt)})
        rows.write.mode("append").partitionBy("workspace_id", "run_id", "attempt").parquet(f"{root}/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        named = spark.createDataFrame([(name, run_id, attempt) for name in tables], MANIFEST)
        _replace_partitions(named, f"{root}/manifest", ["run_id", "table_name"])


def publish_runs(runs: DataFrame, root: str) -> None:
    _replace_partitions(runs, f"{root}/analysis_runs", ["workspace_id", "id"])


def _replace_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write partitions as a whole, so a retried run replaces its own rows and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


RUN_COUNTS = ["documents_ingested", "entities_extracted", "assets", "timeline_events", "compliance_gaps", "contradictions"]


def open_runs(workspaces: DataFrame, root: str, run_id: int, source: str, started_at: str, status: str = "running") -> None:
    """Write the run row of each workspace before the work; ``publish_runs`` replaces it after."""
    row = {
        "id": F.lit(run_id).cast("bigint"), "source": F.lit(source), "status": F.lit(status), "message": F.lit(""),
        "started_at": F.lit(started_at), "completed_at": F.lit(""), **{c: F.lit(0).cast("bigint") for c in RUN_COUNTS},
    }
    publish_runs(workspaces.select("workspace_id").distinct().withColumns(row), root)


def clear_derived(workspaces: DataFrame, root: str, run_id: int, at: str) -> None:
    """Clear all derived rows of workspaces: a complete run without rows becomes their latest."""
    open_runs(workspaces, root, run_id, "clear", at, "complete")


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    """Latest complete run per workspace."""
    runs = spark.read.schema(schemas.ANALYSIS_RUNS).parquet(f"{root}/analysis_runs")
    done = runs.where(F.col("status") == "complete")
    return done.groupBy("workspace_id").agg(F.max("id").alias("run_id"))


def read_current(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """A derived table as of each workspace's latest complete run (prunes run partitions)."""
    full = T.StructType([*schema.fields, T.StructField("run_id", T.LongType()), T.StructField("attempt", T.StringType())])
    rows = spark.read.schema(full).parquet(f"{root}/{name}")
    named = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").where(F.col("table_name") == name)
    valid = rows.join(named.select("run_id", "attempt"), ["run_id", "attempt"], "left_semi")
    return valid.join(current_runs(spark, root), ["workspace_id", "run_id"], "left_semi").select(*schema.names)


# -- run log --------------------------------------------------------------------
def latest_status(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Latest run per workspace; a complete run is stale once the document count changed."""
    newest = runs.groupBy("workspace_id").agg(F.max_by(F.struct(*runs.columns), "id").alias("_r")).select("_r.*")
    counts = documents.groupBy("workspace_id").agg(F.count("*").alias("_now"))
    joined = newest.join(counts, "workspace_id", "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    stale = (F.col("status") == "complete") & (F.col("_now") != F.col("documents_ingested"))
    return joined.withColumns(
        {
            "message": F.when(stale, V.STALE_MESSAGE).otherwise(F.col("message")),
            "documents_ingested": F.when(stale, F.col("_now")).otherwise(F.col("documents_ingested")),
            "status": F.when(stale, "stale").otherwise(F.col("status")),
        }
    ).drop("_now")


def stage_table(status: DataFrame) -> DataFrame:
    """Four stage rows per workspace from its status row (needs ``graph_edges``)."""
    run = or_default("status", "not_run")

    def stage(count: str):
        return (
            F.when(run == "running", "running").when(run == "failed", "blocked").when(run == "stale", "stale")
            .when(F.col(count) > 0, "complete").otherwise("not_run")
        )

    def words(*parts):
        return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])

    ready = (F.col("assets") > 0) & (F.col("graph_edges") > 0) & (run != "running")
    compliance = F.when((run == "complete") & (F.col("assets") > 0) & (F.col("compliance_gaps") == 0), "complete").otherwise(
        stage("compliance_gaps")
    )
    rows = [
        ("Document", F.when(F.col("documents_ingested") > 0, "complete").otherwise("not_run"), "documents_ingested",
         words("$documents_ingested", " documents ingested; ", "$entities_extracted", " entities extracted.")),
        ("Graph", stage("graph_edges"), "graph_edges", words("$graph_edges", " persisted evidence edges.")),
        ("Compliance", compliance, "compliance_gaps", words("$compliance_gaps", " generated gaps tied to source evidence.")),
        ("RCA", F.when(ready, "ready").otherwise("not_run"), "contradictions",
         F.when(ready, words("$contradictions", " contradictions available for RCA context.")).otherwise(
             "RCA becomes ready after assets and graph evidence exist.")),
    ]
    structs = F.array(
        *[
            F.struct(F.lit(name).alias("stage"), s.alias("stage_status"), F.col(n).cast("bigint").alias("records"), m.alias("stage_message"))
            for name, s, n, m in rows
        ]
    )
    return status.select("workspace_id", F.inline(structs))
