"""Lists, filters, facets, counts and distributions over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import vocab as V
from evidara.functions.text import any_contains
from evidara.functions.values import lookup, severity_order


def in_workspace(df: DataFrame, workspace_id: str) -> DataFrame:
    return df.where(F.col("workspace_id") == workspace_id)


def of_document_type(df: DataFrame, document_type: str | None) -> DataFrame:
    """Case-insensitive type filter; none keeps all."""
    return df.where(F.upper("document_type") == document_type.upper()) if document_type else df


def facet(df: DataFrame, column: str, wanted: str) -> DataFrame:
    return df if wanted == "All" else df.where(F.col(column) == wanted)


def search_rows(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    return df.where(any_contains(columns, query))


def facet_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Point lookup for a table of requested ids, compared in upper case."""
    wanted = ids.select(F.upper(key).alias(key)).distinct()
    return df.join(wanted, key, "left_semi")


def with_documents(rows: DataFrame, documents: DataFrame, columns: Sequence[str] = ("filename", "document_type")) -> DataFrame:
    """Inner join on (workspace, document)."""
    d = documents.select("workspace_id", F.col("id").alias("document_id"), *columns)
    return rows.join(d, ["workspace_id", "document_id"])


# -- orders --------------------------------------------------------------------
def by_severity(df: DataFrame, column: str, *then: Column) -> DataFrame:
    return df.orderBy(severity_order(column), *then)


def preview(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of a report list (a sort-limit, no full sort)."""
    return df.orderBy(*order).limit(k)


def hidden_count(df: DataFrame, k: int) -> DataFrame:
    return df.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("hidden_count"))


# -- aggregates ----------------------------------------------------------------
def dashboard(documents: DataFrame, assets: DataFrame, gaps: DataFrame) -> DataFrame:
    """Counts per workspace; each table is reduced before the small results are joined."""
    keys = ["workspace_id"]
    d = documents.groupBy(*keys).agg(F.count("*").alias("total_documents"))
    a = assets.groupBy(*keys).agg(
        F.count("*").alias("total_assets"), F.count_if(F.col("risk_level") == "High").alias("high_risk_assets")
    )
    g = gaps.groupBy(*keys).agg(F.count("*").alias("detected_compliance_gaps"))
    joined = d.join(a, keys, "full").join(g, keys, "full")
    return joined.na.fill(0)


def top_values(df: DataFrame, column: str, order: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the value seen first."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("count"), "_first").limit(k).drop("_first")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share of total per label."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    # The window runs over one row per label.
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("count") * 100.0 / total)


def pick_first(df: DataFrame, preferred: Column, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The first preferred row, or the first row when none is preferred."""
    rank = F.struct(F.when(preferred, 0).otherwise(1).alias("p"), F.col(order).alias("o"))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("_r")).select("_r.*")


def gap_counts(gaps: DataFrame, keys: Sequence[str] = ("workspace_id",)) -> DataFrame:
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("total_gaps"),
        F.count_if(F.col("status") == "Open").alias("open_gaps"),
        F.count_if(F.col("severity") == "High").alias("high_gaps"),
    )


def related_values(entities: DataFrame, matches: DataFrame, k: int = V.TOP_RELATED) -> DataFrame:
    """Distinct equipment, failure and spare values in matched documents, first k by value per query."""
    from evidara.functions.ordering import top_rows

    wanted = entities.where(F.col("entity_type").isin(V.RELATED_TYPES)).select("workspace_id", "document_id", "value").distinct()
    # The first k of a union lie in the union of each document's first k, so cut before joining.
    wanted = top_rows(wanted, ["workspace_id", "document_id"], [F.col("value")], k, "_nth").drop("_nth")
    documents = matches.select("query_id", "workspace_id", "document_id").distinct()
    values = documents.join(wanted, ["workspace_id", "document_id"]).select("query_id", "value").distinct()
    return top_rows(values, ["query_id"], [F.col("value")], k)


def event_rank(c: str = "event_type") -> Column:
    return lookup(c, V.EVENT_TYPE_RANK, 0)
