"""The given tables seen as evidence tables, in Spark and as SQL for the twins.

Assets are customers, gaps and contradictions are orders, the timeline is ``events``,
catalogue documents are suppliers, entities are read off orders.  Text documents keep
their language as workspace.  ``w0`` to ``w3`` are the workspaces of the star schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _glue(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _workspace(key: str) -> Column:
    return _glue("w", _text(F.col(key) % 4)).alias("workspace_id")


TEXTS_SQL = "SELECT lang AS workspace_id, doc_id AS id, source || '-' || doc_id || '.txt' AS filename, 'TXT' AS document_type, text FROM documents"


def texts(t) -> DataFrame:
    return t.documents.select(
        F.col("lang").alias("workspace_id"), F.col("doc_id").alias("id"),
        _glue(F.col("source"), "-", _text("doc_id"), ".txt").alias("filename"), F.lit("TXT").alias("document_type"), "text",
    )


DOCUMENTS_SQL = "SELECT 'w' || (s_suppkey % 4) AS workspace_id, s_suppkey AS id, s_name || '.txt' AS filename, 'TXT' AS document_type FROM supplier"


def documents(t) -> DataFrame:
    return t.supplier.select(
        _workspace("s_suppkey"), F.col("s_suppkey").alias("id"), _glue(F.col("s_name"), ".txt").alias("filename"),
        F.lit("TXT").alias("document_type"),
    )


RISK = {"AUTOMOBILE": "High", "BUILDING": "Medium", "MACHINERY": "Low"}
ASSETS_SQL = """SELECT 'w' || (c_custkey % 4) AS workspace_id, 'C-' || c_custkey AS asset_id, c_name AS name, c_mktsegment AS asset_type,
  CASE WHEN c_nationkey % 5 = 0 THEN 'Unknown' ELSE 'NATION_' || c_nationkey END AS location,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'High' WHEN 'BUILDING' THEN 'Medium' WHEN 'MACHINERY' THEN 'Low' ELSE 'Unknown' END AS risk_level,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '2024-0' || (1 + c_custkey % 9) || '-15' END AS last_inspection,
  'src-' || (c_custkey % 50) || '.txt' AS source_document, (1 + c_custkey % 3)::INTEGER AS source_page,
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'Evidence for C-' || c_custkey END AS evidence_text, c_custkey, c_acctbal FROM customer"""


def assets(t) -> DataFrame:
    key = F.col("c_custkey")
    risk = F.lit("Unknown")
    for segment, level in RISK.items():
        risk = F.when(F.col("c_mktsegment") == segment, level).otherwise(risk)
    return t.customer.select(
        _workspace("c_custkey"),
        _glue("C-", _text(key)).alias("asset_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("asset_type"),
        F.when(F.col("c_nationkey") % 5 == 0, "Unknown").otherwise(_glue("NATION_", _text("c_nationkey"))).alias("location"),
        risk.alias("risk_level"),
        F.when(key % 3 != 0, _glue("2024-0", _text(1 + key % 9), "-15")).alias("last_inspection"),
        F.when(key % 2 == 0, F.array(_glue("Inspect C-", _text(key)), F.lit("Review the log"))).otherwise(F.array().cast("array<string>")).alias("suggested_actions"),
        _glue("src-", _text(key % 50), ".txt").alias("source_document"),
        (1 + key % 3).cast("int").alias("source_page"),
        F.when(key % 10 == 0, "").otherwise(_glue("Evidence for C-", _text(key))).alias("evidence_text"),
        "c_custkey",
        "c_acctbal",
    )


SEVERITY_SQL = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'Low' END"
STATUS_SQL = "CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Closed' WHEN 'P' THEN 'In Progress' ELSE 'Monitoring' END"


def severity() -> Column:
    p = F.col("o_orderpriority")
    return F.when(p.isin("1-URGENT", "2-HIGH"), "High").when(p == "3-MEDIUM", "Medium").otherwise("Low")


def status() -> Column:
    s = F.col("o_orderstatus")
    return F.when(s == "O", "Open").when(s == "F", "Closed").when(s == "P", "In Progress").otherwise("Monitoring")


GAPS_SQL = f"""SELECT 'w' || (o_custkey % 4) AS workspace_id, o_orderkey AS id, 'C-' || o_custkey AS asset_id, {SEVERITY_SQL} AS severity,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE lower(o_orderpriority) END AS gap_type, 'Order ' || o_orderkey || ' of C-' || o_custkey AS description,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'Total ' || (o_orderkey % 1000) END AS evidence, 'Review order' AS corrective_action,
  {STATUS_SQL} AS status, 'gap-' || (o_orderkey % 20) || '.txt' AS source_document, (1 + o_orderkey % 4)::INTEGER AS source_page FROM orders"""


def gaps(t) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        _workspace("o_custkey"), key.alias("id"), _glue("C-", _text("o_custkey")).alias("asset_id"), severity().alias("severity"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("gap_type"),
        _glue("Order ", _text(key), " of C-", _text("o_custkey")).alias("description"),
        F.when(key % 9 == 0, "").otherwise(_glue("Total ", _text(key % 1000))).alias("evidence"),
        F.lit("Review order").alias("corrective_action"), status().alias("status"),
        _glue("gap-", _text(key % 20), ".txt").alias("source_document"), (1 + key % 4).cast("int").alias("source_page"),
    )


CONTRADICTIONS_SQL = f"""SELECT 'w' || (o_custkey % 4) AS workspace_id, o_orderkey AS id, 'C-' || o_custkey AS asset_id, {SEVERITY_SQL} AS severity,
  'Risk Conflict' AS contradiction_type, 'Conflict on order ' || o_orderkey AS description, 'Open ' || o_orderkey AS evidence_a,
  'a-' || (o_orderkey % 20) || '.txt' AS source_document_a, 1 AS source_page_a, 'Closed ' || o_orderkey AS evidence_b,
  'b-' || (o_orderkey % 20) || '.txt' AS source_document_b, 2 AS source_page_b, 'Open' AS status FROM orders WHERE o_orderstatus = 'P'"""


def contradictions(t) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.where(F.col("o_orderstatus") == "P").select(
        _workspace("o_custkey"), key.alias("id"), _glue("C-", _text("o_custkey")).alias("asset_id"), severity().alias("severity"),
        F.lit("Risk Conflict").alias("contradiction_type"), _glue("Conflict on order ", _text(key)).alias("description"),
        _glue("Open ", _text(key)).alias("evidence_a"), _glue("a-", _text(key % 20), ".txt").alias("source_document_a"),
        F.lit(1).alias("source_page_a"), _glue("Closed ", _text(key)).alias("evidence_b"),
        _glue("b-", _text(key % 20), ".txt").alias("source_document_b"), F.lit(2).alias("source_page_b"), F.lit("Open").alias("status"),
    )


EVENT_TYPES = {"error": "Incident", "view": "Inspection", "click": "Service", "purchase": "Work Order"}
EVENTS_SQL = """SELECT 'w' || (user_id % 4) AS workspace_id, event_id AS id, 'C-' || user_id AS asset_id, strftime(ts, '%Y-%m-%d') AS event_date,
  CASE event_type WHEN 'error' THEN 'Incident' WHEN 'view' THEN 'Inspection' WHEN 'click' THEN 'Service' WHEN 'purchase' THEN 'Work Order' ELSE 'Other' END AS event_type,
  event_type || ' ' || event_id AS title, props AS description, 'log-' || event_type || '.csv' AS source_document, 1 AS source_page FROM events"""


def events(t) -> DataFrame:
    kind = F.lit("Other")
    for raw, shown in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == raw, shown).otherwise(kind)
    return t.events.select(
        _workspace("user_id"), F.col("event_id").alias("id"), _glue("C-", _text("user_id")).alias("asset_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("event_date"), kind.alias("event_type"),
        _glue(F.col("event_type"), " ", _text("event_id")).alias("title"), F.col("props").alias("description"),
        _glue("log-", F.col("event_type"), ".csv").alias("source_document"), F.lit(1).alias("source_page"),
    )


# Document of an order: a supplier of the same workspace, two per workspace.
ORDER_DOCUMENT_SQL = "(o_custkey % 4) + 4 * (o_orderkey % 2)"
ENTITIES_SQL = f"""SELECT 'w' || (o_custkey % 4) AS workspace_id, o_orderkey AS id, {ORDER_DOCUMENT_SQL} AS document_id, (1 + o_orderkey % 3)::INTEGER AS page,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Failure Mode' WHEN '2-HIGH' THEN 'Equipment' WHEN '3-MEDIUM' THEN 'Spare Part' WHEN '4-NOT SPECIFIED' THEN 'Location' ELSE 'Work Order' END AS entity_type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Mode ' || (o_orderkey % 7)
    WHEN '2-HIGH' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'X-' || (o_orderkey % 50) ELSE 'C-' || o_custkey END
    WHEN '3-MEDIUM' THEN 'Seal ' || (o_orderkey % 11) WHEN '4-NOT SPECIFIED' THEN 'NATION_' || (o_custkey % 25) ELSE 'WO-' || o_orderkey END AS value,
  (o_orderkey % 101) / 100.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Order for c-' || o_custkey || ', total noted.' END AS context,
  s_name || '.txt' AS filename FROM orders JOIN supplier ON s_suppkey = {ORDER_DOCUMENT_SQL}"""


def order_document() -> Column:
    return F.col("o_custkey") % 4 + 4 * (F.col("o_orderkey") % 2)


def entities(t) -> DataFrame:
    key, p = F.col("o_orderkey"), F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "Failure Mode").when(p == "2-HIGH", "Equipment").when(p == "3-MEDIUM", "Spare Part").when(p == "4-NOT SPECIFIED", "Location").otherwise("Work Order")
    value = (
        F.when(p == "1-URGENT", _glue("Mode ", _text(key % 7)))
        .when((p == "2-HIGH") & (key % 3 == 0), _glue("X-", _text(key % 50)))
        .when(p == "2-HIGH", _glue("C-", _text("o_custkey")))
        .when(p == "3-MEDIUM", _glue("Seal ", _text(key % 11)))
        .when(p == "4-NOT SPECIFIED", _glue("NATION_", _text(F.col("o_custkey") % 25)))
        .otherwise(_glue("WO-", _text(key)))
    )
    rows = t.orders.select(
        _workspace("o_custkey"), key.alias("id"), order_document().alias("document_id"), (1 + key % 3).cast("int").alias("page"),
        kind.alias("entity_type"), value.alias("value"), ((key % 101) / 100.0).alias("confidence"),
        F.when(key % 13 == 0, "").otherwise(_glue("Order for c-", _text("o_custkey"), ", total noted.")).alias("context"),
    )
    names = documents(t).select("workspace_id", F.col("id").alias("document_id"), "filename")
    return rows.join(names, ["workspace_id", "document_id"])


LINKS_SQL = f"SELECT DISTINCT 'w' || (o_custkey % 4) AS workspace_id, 'C-' || o_custkey AS asset_id, {ORDER_DOCUMENT_SQL} AS document_id FROM orders"


def links(t) -> DataFrame:
    return t.orders.select(_workspace("o_custkey"), _glue("C-", _text("o_custkey")).alias("asset_id"), order_document().alias("document_id")).distinct()


def graph_tables(t) -> dict[str, DataFrame]:
    makers = {
        "documents": documents, "entities": entities, "assets": assets, "gaps": gaps, "events": events,
        "asset_documents": links, "contradictions": contradictions,
    }
    return {name: t.once(f"standin {name}", lambda make=make: make(t)) for name, make in makers.items()}


WITH = (
    f"WITH documents_t AS ({DOCUMENTS_SQL}), entities_t AS ({ENTITIES_SQL}), assets_t AS ({ASSETS_SQL}), gaps_t AS ({GAPS_SQL}), "
    f"events_t AS ({EVENTS_SQL}), links_t AS ({LINKS_SQL}), contradictions_t AS ({CONTRADICTIONS_SQL})"
)
