"""Target table layouts.  All tables are partitioned by ``workspace_id`` at rest."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
    "array<float>": T.ArrayType(T.FloatType()),
    "array<page>": T.ArrayType(
        T.StructType([T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType())])
    ),
}


def _table(columns: str) -> T.StructType:
    pairs = (column.split(" ") for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


WORKSPACES = _table("workspace_id string, name string, created_at string")

DOCUMENTS = _table(
    "workspace_id string, id bigint, filename string, document_type string, upload_time string, "
    "parsed_text string, page_count int, parser string, ocr_used boolean, ocr_engine string, "
    "ocr_confidence double, extracted_tables_count int, extracted_images_count int, "
    "extraction_warnings array<string>, content_hash string, size_bytes bigint"
)

CHUNKS = _table(
    "workspace_id string, id bigint, document_id bigint, chunk_index bigint, page int, text string, "
    "embedding array<float>"
)

ENTITIES = _table(
    "workspace_id string, id bigint, document_id bigint, page int, entity_type string, value string, "
    "confidence double, context string"
)

ASSETS = _table(
    "workspace_id string, id string, name string, asset_type string, location string, risk_level string, "
    "last_inspection string, open_compliance_gaps bigint, suggested_actions array<string>, "
    "source_document string, source_page int, evidence_text string"
)

ASSET_DOCUMENTS = _table("workspace_id string, asset_id string, document_id bigint")

TIMELINE_EVENTS = _table(
    "workspace_id string, id bigint, asset_id string, event_date string, event_type string, title string, "
    "description string, source_document string, source_page int"
)

COMPLIANCE_GAPS = _table(
    "workspace_id string, id bigint, asset_id string, severity string, gap_type string, description string, "
    "evidence string, corrective_action string, status string, source_document string, source_page int"
)

CONTRADICTIONS = _table(
    "workspace_id string, id bigint, asset_id string, severity string, contradiction_type string, "
    "description string, evidence_a string, source_document_a string, source_page_a int, "
    "evidence_b string, source_document_b string, source_page_b int, status string"
)

GRAPH_EDGES = _table(
    "workspace_id string, id bigint, source_id string, target_id string, label string, relation_type string, "
    "confidence double, source_document string, source_page int, evidence_text string, "
    "validation_status string, validation_reason string"
)

ANALYSIS_RUNS = _table(
    "workspace_id string, id bigint, source string, status string, message string, started_at string, "
    "completed_at string, documents_ingested bigint, entities_extracted bigint, assets bigint, "
    "timeline_events bigint, compliance_gaps bigint, contradictions bigint"
)

# The schema of ``spark.read.format("binaryFile")``, which the file parsers expect.
FILES = _table("path string, modificationTime timestamp, length bigint, content binary")

PARSED = _table(
    "path string, pages array<page>, text string, page_count int, parser string, "
    "ocr_used boolean, ocr_engine string, ocr_confidence double, extracted_tables_count int, "
    "extracted_images_count int, extraction_warnings array<string>, error string"
)

TABLES = {
    "workspaces": WORKSPACES,
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "entities": ENTITIES,
    "assets": ASSETS,
    "asset_documents": ASSET_DOCUMENTS,
    "timeline_events": TIMELINE_EVENTS,
    "compliance_gaps": COMPLIANCE_GAPS,
    "contradictions": CONTRADICTIONS,
    "graph_edges": GRAPH_EDGES,
    "analysis_runs": ANALYSIS_RUNS,
}
