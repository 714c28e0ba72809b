"""Order-aware merging of validated records across batches.

Every rule is an aggregate that combines on the map side; no window or list ever holds
all records of one asset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import values as W
from evidara.functions import vocab as V
from evidara.functions.ordering import first_by


def merge_entities(entities: DataFrame) -> DataFrame:
    return first_by(
        entities, ["workspace_id", "document_id", "source_page", "entity_type", F.lower("value")], ["ord"]
    )


def merge_assets(assets: DataFrame) -> DataFrame:
    """One row per (workspace, asset): highest risk, first informative labels, latest inspection,
    ordered union of actions, all source documents, provenance of the first record with a source."""
    keys = ["workspace_id", "asset_id"]

    def informative(name: str) -> Column:
        c = F.col(name)
        return (c != "") & (c != "Unknown") & (c != F.col("asset_id"))

    def label(name: str) -> Column:
        first_good = F.min_by(F.when(informative(name), F.col(name)), F.when(informative(name), F.col("ord")))
        last_filled = F.max_by(F.when(F.col(name) != "", F.col(name)), F.when(F.col(name) != "", F.col("ord")))
        first_any = F.min_by(name, "ord")
        return F.coalesce(first_good, last_filled, first_any).alias(name)

    with_source = F.when(F.coalesce(F.col("source_document"), F.lit("")) != "", F.col("ord"))
    provenance = F.struct("source_document", "source_page", "evidence_text")
    core = assets.groupBy(*keys).agg(
        *[label(name) for name in ("name", "asset_type", "location")],
        F.max_by("risk_level", W.lookup("risk_level", V.RISK_RANK, 0)).alias("risk_level"),
        F.max("last_inspection").alias("last_inspection"),
        F.min_by(F.when(with_source.isNotNull(), provenance), with_source).alias("_source"),
        F.min("ord").alias("ord"),
    )
    actions = (
        assets.select(*keys, "ord", F.posexplode("suggested_actions").alias("_pos", "_action"))
        .where(F.col("_action") != "")
        .groupBy(*keys, "_action")
        .agg(F.min(F.struct("ord", "_pos")).alias("_at"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_action"))).alias("_actions"))
        .select(*keys, F.transform("_actions", lambda a: a["_action"]).alias("suggested_actions"))
    )
    return (
        core.join(actions, keys, "left")
        .withColumn("suggested_actions", F.coalesce("suggested_actions", F.array().cast("array<string>")))
        .select(
            *keys, "ord", "name", "asset_type", "location", "risk_level", "last_inspection", "suggested_actions",
            F.coalesce("_source.source_document", F.lit("")).alias("source_document"),
            F.coalesce("_source.source_page", F.lit(1)).alias("source_page"),
            F.coalesce("_source.evidence_text", F.lit("")).alias("evidence_text"),
        )
    )


def asset_sources(assets: DataFrame, documents: DataFrame) -> DataFrame:
    """Asset-document links: every source file of an asset that is in the catalogue."""
    ids = documents.groupBy("workspace_id", "filename").agg(F.max("id").alias("document_id"))
    named = assets.select("workspace_id", "asset_id", F.col("source_document").alias("filename")).distinct()
    return named.join(ids, ["workspace_id", "filename"]).select("workspace_id", "asset_id", "document_id").distinct()


def of_known_assets(records: DataFrame, assets: DataFrame) -> DataFrame:
    """Keep records whose asset survived validation."""
    return records.join(assets.select("workspace_id", "asset_id").distinct(), ["workspace_id", "asset_id"], "left_semi")


def merge_events(events: DataFrame) -> DataFrame:
    return first_by(
        events,
        ["workspace_id", "asset_id", "event_date", F.lower("title"), "source_document", "source_page"],
        ["ord"],
    )


def merge_gaps(gaps: DataFrame, keys: Sequence[Column | str] | None = None) -> DataFrame:
    """One gap per (asset, lower gap type).

    The record is the first that reaches the highest severity; its status is the most
    open one among that record and later ones.  A status counts if its last occurrence
    is not before the record, so one aggregation decides everything.  A gap keeps the place
    (``ord``) where it was first seen, whichever record wins.
    """
    keys = list(keys or ["workspace_id", "asset_id", F.lower("gap_type")])
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    severity = W.lookup("severity", V.SEVERITY_RANK, 0)
    by_rank = sorted(V.STATUS_RANK, key=V.STATUS_RANK.get, reverse=True)
    row = F.struct(*[F.col(c) for c in gaps.columns])
    merged = gaps.groupBy(*named).agg(
        F.min_by(row, F.struct((-severity).alias("s"), F.col("ord").alias("o"))).alias("_row"),
        F.min("ord").alias("_place"),
        *[F.max(F.when(F.col("status") == s, F.col("ord"))).alias(f"_last{i}") for i, s in enumerate(by_rank)],
    )
    status = F.coalesce(
        *[F.when(F.col(f"_last{i}") >= F.col("_row.ord"), F.lit(s)) for i, s in enumerate(by_rank)],
        F.col("_row.status"),
    )
    own = {"status": status.alias("status"), "ord": F.col("_place").alias("ord")}
    columns = [own.get(c, F.col(f"_row.{c}")) for c in gaps.columns]
    return merged.select(*columns)


def merge_contradictions(contradictions: DataFrame) -> DataFrame:
    return first_by(
        contradictions,
        [
            "workspace_id", "asset_id", F.lower("contradiction_type"), F.lower("evidence_a"), F.lower("evidence_b"),
            "source_document_a", "source_page_a", "source_document_b", "source_page_b",
        ],
        ["ord"],
    )


def open_gap_counts(assets: DataFrame, gaps: DataFrame) -> DataFrame:
    """Assets with ``open_compliance_gaps``, 0 when there are none."""
    counts = gaps.groupBy("workspace_id", "asset_id").agg(
        F.count_if(F.col("status") == "Open").alias("open_compliance_gaps")
    )
    joined = assets.join(counts, ["workspace_id", "asset_id"], "left")
    return joined.withColumn("open_compliance_gaps", F.coalesce("open_compliance_gaps", F.lit(0).cast("bigint")))


def merge_analysis(accepted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five merged record sets."""
    assets = merge_assets(accepted["assets"])
    gaps = merge_gaps(of_known_assets(accepted["compliance_gaps"], assets))
    return {
        "entities": merge_entities(accepted["entities"]),
        "assets": open_gap_counts(assets, gaps),
        "timeline_events": merge_events(of_known_assets(accepted["timeline_events"], assets)),
        "compliance_gaps": gaps,
        "contradictions": merge_contradictions(of_known_assets(accepted["contradictions"], assets)),
    }
