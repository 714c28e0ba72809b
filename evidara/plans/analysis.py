"""The batch jobs that tie the operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions.ordering import position
from evidara.functions.text import document_type
from evidara.operators import graph as G
from evidara.operators import ingest, merge, store, validate
from evidara.session import settle
from evidara.session import stored as fixed
from evidara.sources import files as S
from evidara.sources import payloads as P


def ingest_files(files: DataFrame, stored: DataFrame | None = None, chunk_keys=("workspace_id", "document_id")) -> dict[str, DataFrame]:
    """Uploaded files -> statuses, document rows and chunk rows.

    ``files``: workspace_id, ord, path, length, content and optionally content_type; an upload is
    (workspace_id, ord), so workspaces may share paths.  Every file is read, gated, hashed and
    parsed in one pass that is written once; statuses, documents and chunks come from it.  The
    holder of a content hash is the first file that parsed.
    """
    kind = "content_type" if "content_type" in files.columns else None
    # Contents above the limit are refused by their size and never read.
    within = files.where(F.col("length") <= S.MAX_UPLOAD_BYTES)
    beyond = files.where(F.col("length") > S.MAX_UPLOAD_BYTES).withColumn("content", F.lit(None).cast("binary"))
    gate = S.named_files(within.unionByName(beyond)).withColumn(
        "reject_reason", S.reject_reason(content_type=kind, size="length")
    )
    gate = gate.withColumn("content_hash", ingest.content_hash("content"))
    held = gate.withColumn("content", F.when(F.col("reject_reason").isNull(), F.col("content")))
    upload = ["workspace_id", "ord", "path", "filename", "extension", "content_hash", "length", "reject_reason"]
    parsed = settle(S.parse_files(held, upload))
    fault = F.coalesce("reject_reason", "error")
    statuses = ingest.classify_uploads(parsed.select(*upload[:-1], fault.alias("reject_reason")), stored)
    fresh = statuses.where(F.col("status") == "uploaded").select("workspace_id", "ord")
    kept = parsed.join(fresh, ["workspace_id", "ord"], "left_semi")
    pages = S.parsed_pages(kept, ["workspace_id", "ord"]).withColumnRenamed("ord", "document_id")
    chunks = ingest.chunk_pages(pages, chunk_keys)
    documents = ingest.document_rows(kept.withColumns({"size_bytes": F.col("length"), "upload_time": F.lit("")}))
    return {"statuses": statuses, "documents": documents, "chunks": chunks}


def run_analysis(payloads: DataFrame, chunks: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """Raw model payloads -> merged tables, edges and run rows.

    ``payloads``: workspace_id, batch, content.  ``chunks``: workspace_id, id, document_id,
    filename, page, text.  One bad payload fails its workspace's run, and only that one:
    failed workspaces contribute no rows, so their stored state stays as it is.
    """
    unwrapped = settle(P.unwrap(payloads).drop("content"))
    failed = unwrapped.where(F.col("payload_error").isNotNull()).groupBy("workspace_id").agg(
        F.min_by("payload_error", "batch").alias("message")
    )
    # Its size is known once it is stored, so that payloads need not be exchanged when few fail.
    failed = fixed(failed)
    good = unwrapped.join(failed.select("workspace_id"), "workspace_id", "left_anti")
    pages = fixed(validate.feature_table(ingest.source_pages(chunks)))
    checked = validate.validate_payloads(good, pages, documents)
    accepted = {kind: validate.accepted(df) for kind, df in checked.items()}
    # Read by several merges; the other kinds are read once and fixed when they get their ids.
    for kind in ("assets", "compliance_gaps"):
        accepted[kind] = settle(accepted[kind])
    merged = merge.merge_analysis(accepted)
    links = merge.asset_sources(accepted["assets"], documents)
    tables = _with_ids(merged)
    graph_input = {
        "documents": documents.select("workspace_id", "id", "filename", document_type("filename").alias("document_type")),
        "entities": tables["entities"].join(
            documents.select("workspace_id", F.col("id").alias("document_id"), "filename"), ["workspace_id", "document_id"]
        ),
        "assets": tables["assets"],
        "events": tables["timeline_events"],
        "gaps": tables["compliance_gaps"],
        "contradictions": tables["contradictions"],
        "asset_documents": links,
    }
    tables["asset_documents"] = links
    tables["graph_edges"] = G.derive_edges(graph_input)
    tables["runs"] = run_rows(documents, unwrapped.select("workspace_id").distinct(), failed, tables)
    tables["rejects"] = validate.rejects(checked)
    tables["graph_input"] = graph_input
    return tables


def _with_ids(merged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Surrogate ids per workspace in record order; numbering fixes the rows (``position`` checkpoints)."""
    tables = {"assets": settle(merged["assets"])}
    for kind in ("entities", "timeline_events", "compliance_gaps", "contradictions"):
        tables[kind] = position(merged[kind], ["workspace_id"], [F.col("ord")], "id")
    tables["entities"] = tables["entities"].withColumnRenamed("source_page", "page")
    return tables


def run_rows(documents: DataFrame, workspaces: DataFrame, failed: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Status and counts of the run per workspace."""
    rows = workspaces.join(failed, "workspace_id", "left")
    counted = {"documents_ingested": documents, "entities_extracted": tables["entities"]}
    counted.update({k: tables[k] for k in ("assets", "timeline_events", "compliance_gaps", "contradictions")})
    for name, df in counted.items():
        rows = rows.join(df.groupBy("workspace_id").agg(F.count("*").alias(name)), "workspace_id", "left")
    rows = rows.na.fill(0, list(counted))
    return rows.withColumn("status", F.when(F.col("message").isNull(), "complete").otherwise("failed")).withColumn(
        "message", F.coalesce("message", F.lit(""))
    )


def publish(tables: dict[str, DataFrame], root: str, run_id: int, source: str, started_at: str, completed_at: str) -> None:
    """Write the derived tables of a run, then its run row; readers switch with that row."""
    derived = {k: tables[k] for k in ("entities", "assets", "timeline_events", "compliance_gaps", "contradictions", "asset_documents")}
    derived["graph_edges"] = tables["graph_edges"]
    store.write_derived({k: df.drop("ord") for k, df in derived.items()}, root, run_id)
    runs = tables["runs"].select(
        "workspace_id", F.lit(run_id).cast("bigint").alias("id"), F.lit(source).alias("source"), "status", "message",
        F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), "documents_ingested",
        "entities_extracted", "assets", "timeline_events", "compliance_gaps", "contradictions",
    )
    store.publish_runs(runs, root)
