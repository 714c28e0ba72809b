"""Evidence graph and reports over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vocab as V
from evidara.operators import graph as G
from evidara.operators import reports as R
from evidara.plans import ingest_queries as I
from evidara.plans import standins as S
from evidara.plans import twin as Q
from evidara.plans.registry import query
from evidara.session import stored

LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENTITY_EDGE_LABELS.items())
STATUS = f"CASE WHEN document = '' OR evidence = '' THEN 'rejected' WHEN c >= 0.7 THEN 'accepted' ELSE 'weak' END"

# The edge rules on the stand-in tables, first edge per key; rule, k1, k2, at_id and sub reproduce their order.
EDGES = f"""{S.WITH}, mention AS (SELECT e.id, a.asset_id FROM entities_t e JOIN assets_t a ON a.workspace_id = e.workspace_id AND contains(upper(e.value || ' ' || e.context || ' ' || e.filename), upper(a.asset_id)) WHERE e.entity_type <> 'Equipment'),
 rules AS (
  SELECT workspace_id, asset_id AS source_id, 'Location:' || location AS target_id, 'EQUIPMENT_LOCATED_IN' AS relation_type, 0.72 AS c, source_document AS document, source_page AS page, evidence_text AS evidence, 1 AS rule, 0 AS id, '' AS sub, '' AS k1, '' AS k2 FROM assets_t WHERE location <> 'Unknown'
  UNION ALL SELECT workspace_id, CASE WHEN entity_type = 'Equipment' THEN value ELSE entity_type || ':' || value END, 'Document:' || document_id, CASE WHEN entity_type = 'Equipment' THEN 'EQUIPMENT_MENTIONED_IN_DOCUMENT' ELSE 'MENTIONED_IN_DOCUMENT' END, confidence, filename, page, context, 2, id, '', entity_type, value FROM entities_t
  UNION ALL SELECT e.workspace_id, m.asset_id, entity_type || ':' || value, CASE entity_type {LABELS} ELSE 'EQUIPMENT_RELATED_TO_ENTITY' END, confidence, filename, page, context, 2, e.id, m.asset_id, entity_type, value FROM entities_t e JOIN mention m USING (id)
  UNION ALL SELECT workspace_id, asset_id, 'Maintenance Event:' || id, 'EQUIPMENT_HAS_MAINTENANCE_EVENT', 0.86, source_document, source_page, description, 3, id, '', '', '' FROM events_t
  UNION ALL SELECT l.workspace_id, l.asset_id, 'Document:' || l.document_id, 'EQUIPMENT_SUPPORTED_BY_DOCUMENT', 0.58, coalesce(d.filename, a.source_document, ''), coalesce(a.source_page, 1), coalesce(a.evidence_text, ''), 4, l.document_id, l.asset_id, '', ''
    FROM links_t l LEFT JOIN documents_t d ON d.workspace_id = l.workspace_id AND d.id = l.document_id LEFT JOIN assets_t a ON a.workspace_id = l.workspace_id AND a.asset_id = l.asset_id
  UNION ALL SELECT workspace_id, asset_id, 'Compliance Gap:' || id, 'EQUIPMENT_HAS_COMPLIANCE_GAP', 0.9, source_document, source_page, evidence, 5, id, '', '', '' FROM gaps_t
  UNION ALL SELECT workspace_id, asset_id, 'Contradiction:' || id, 'EQUIPMENT_HAS_CONTRADICTION', 0.82, source_document_a, source_page_a, evidence_a, 6, id, '', '', '' FROM contradictions_t),
 edges_t AS MATERIALIZED (SELECT workspace_id, source_id, target_id, relation_type, c AS confidence, CASE WHEN rule = 4 THEN 'weak' ELSE {STATUS} END AS validation_status, document AS source_document, page::INTEGER AS source_page, evidence AS evidence_text, rule, k1, k2, id AS at_id, sub
  FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, source_id, target_id, relation_type, document, evidence ORDER BY rule, id, sub) AS r FROM rules) WHERE r = 1)"""

NODES = """, node_parts AS (
  SELECT workspace_id, 'Document:' || id AS id, filename AS label, 'Document' AS type FROM documents_t
  UNION SELECT workspace_id, asset_id, name, 'Equipment' FROM assets_t
  UNION SELECT workspace_id, 'Location:' || location, location, 'Location' FROM assets_t WHERE location <> 'Unknown'
  UNION SELECT workspace_id, entity_type || ':' || value, value, entity_type FROM entities_t WHERE entity_type <> 'Equipment'
  UNION SELECT workspace_id, value, value, 'Equipment' FROM entities_t e WHERE entity_type = 'Equipment' AND NOT EXISTS (SELECT 1 FROM assets_t a WHERE a.workspace_id = e.workspace_id AND a.asset_id = e.value)
  UNION SELECT workspace_id, 'Maintenance Event:' || id, title, 'Maintenance Event' FROM events_t
  UNION SELECT workspace_id, 'Compliance Gap:' || id, gap_type, 'Compliance Gap' FROM gaps_t
  UNION SELECT workspace_id, 'Contradiction:' || id, contradiction_type, 'Contradiction' FROM contradictions_t), nodes_t AS MATERIALIZED (SELECT * FROM node_parts)"""
EDGE_FIELDS = ["source_id", "target_id", "relation_type", "confidence", "validation_status", "source_document", "source_page", "evidence_text"]
EDGE_SQL = "source_id, target_id, relation_type, round(confidence, 2) AS confidence, validation_status, source_document, source_page, evidence_text"
VISIBLE = EDGES + NODES + """, shown AS MATERIALIZED (SELECT * FROM edges_t e WHERE EXISTS (SELECT 1 FROM nodes_t n WHERE n.workspace_id = e.workspace_id AND n.id = e.source_id)
  AND EXISTS (SELECT 1 FROM nodes_t n WHERE n.workspace_id = e.workspace_id AND n.id = e.target_id))"""


ENDS = ("workspace_id", "source_id", "target_id", "ord")


def nodes(t, details: bool = False) -> DataFrame:
    return t.once(f"nodes {details}", lambda: stored(G.derive_nodes(S.graph_tables(t), details)))


def edges(t) -> DataFrame:
    return t.once("edges", lambda: stored(G.derive_edges(S.graph_tables(t))))


def shown(t) -> DataFrame:
    return t.once("shown", lambda: G.visible_edges(edges(t), nodes(t)))


def shown_ends(t) -> DataFrame:
    """Ends and places of the visible edges, for queries that read nothing else of an edge."""
    ends = t.once("edge ends", lambda: stored(G.derive_edges(S.graph_tables(t)).select(*ENDS)))
    return t.once("shown ends", lambda: G.visible_edges(ends, nodes(t)))


@query("graph_edges", "J1 J2 H2 D13", f"{EDGES} SELECT workspace_id, source_id, target_id, relation_type, round(confidence, 2) AS confidence, validation_status, source_document, source_page, evidence_text FROM edges_t")
def _(t):
    return edges(t).select("workspace_id", "source_id", "target_id", "relation_type", F.round("confidence", 2).alias("confidence"), "validation_status", "source_document", "source_page", "evidence_text")


@query("graph_nodes", "H3", f"{EDGES}{NODES} SELECT workspace_id, id, label, type FROM nodes_t")
def _(t):
    return nodes(t).select("workspace_id", "id", "label", "type")


@query("edge_confidence_rounding", "J1", f"""
SELECT event_id, {Q.half_even('c', 2)} AS confidence, CASE WHEN {Q.half_even('c', 2)} >= 0.7 THEN 'accepted' ELSE 'weak' END AS validation_status
FROM (SELECT event_id, (event_id % 1000) / 1000.0::DOUBLE AS c FROM events)""")
def _(t):
    number = (F.col("event_id") % 1000) / F.lit(1000.0)
    record = G.edge_record(number, F.lit("doc.txt"), F.lit("text"))
    return t.events.select("event_id", *record[:2])


@query("edge_audit", "E5", f"{EDGES} SELECT workspace_id, count(*) FILTER (validation_status = 'accepted') AS accepted, count(*) FILTER (validation_status = 'weak') AS weak, count(*) FILTER (validation_status = 'rejected') AS rejected, count(*) AS total FROM edges_t GROUP BY 1")
def _(t):
    return G.edge_audit(edges(t))


@query("visible_edges", "D11 J4", f"{VISIBLE} SELECT workspace_id, {EDGE_SQL} FROM shown")
def _(t):
    return shown(t).select("workspace_id", *EDGE_FIELDS)


@query("graph_view", "J4 F2 F3", f"""{VISIBLE}, e4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, asset_id ORDER BY event_date DESC,
 CASE event_type WHEN 'Incident' THEN 5 WHEN 'Inspection' THEN 3 WHEN 'Service' THEN 2 WHEN 'Work Order' THEN 1 ELSE 0 END DESC, id DESC) AS k FROM events_t) WHERE k <= 4),
 g3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, asset_id ORDER BY CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC, id DESC) AS k FROM gaps_t) WHERE k <= 3)
SELECT workspace_id, {EDGE_SQL} FROM shown s WHERE (relation_type NOT IN ('EQUIPMENT_HAS_MAINTENANCE_EVENT', 'EQUIPMENT_HAS_COMPLIANCE_GAP'))
 OR target_id IN (SELECT 'Maintenance Event:' || id FROM e4) OR target_id IN (SELECT 'Compliance Gap:' || id FROM g3)""")
def _(t):
    tables = S.graph_tables(t)
    limited = {**tables, "events": G.limit_events(tables["events"]), "gaps": G.limit_gaps(tables["gaps"])}
    view = G.visible_edges(edges(t), G.derive_nodes(limited))
    return view.select("workspace_id", *EDGE_FIELDS)


@query("edge_ids", "F5", f"{VISIBLE} SELECT workspace_id, source_id || '-' || target_id AS pair, count(*) AS edges FROM shown GROUP BY ALL")
def _(t):
    numbered = G.number_edges(shown_ends(t), nodes(t))
    pair = F.regexp_replace("edge_id", r"-\d+\z", "")
    return numbered.groupBy("workspace_id", pair.alias("pair")).agg(F.count_distinct("edge_index").alias("edges"))


@query("edge_index_range", "F5", f"{VISIBLE} SELECT workspace_id, 0 AS lowest, count(*) - 1 AS highest, count(*) AS indexes FROM shown GROUP BY workspace_id")
def _(t):
    numbered = G.number_edges(shown_ends(t), nodes(t))
    return numbered.groupBy("workspace_id").agg(
        F.min("edge_index").alias("lowest"), F.max("edge_index").alias("highest"), F.count_distinct("edge_index").alias("indexes")
    )


@query("node_degree", "E28", f"""{VISIBLE}, ends AS (SELECT workspace_id, source_id AS id FROM shown UNION ALL SELECT workspace_id, target_id FROM shown)
SELECT n.workspace_id, n.id, count(e.id) AS degree FROM nodes_t n LEFT JOIN ends e ON e.workspace_id = n.workspace_id AND e.id = n.id GROUP BY ALL""")
def _(t):
    return G.node_degree(shown_ends(t), nodes(t)).select("workspace_id", "id", "degree")


COLUMN = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.GRAPH_COLUMNS.items())


@query("graph_layout", "F6", f"""{VISIBLE}, ends AS (SELECT workspace_id, source_id AS id FROM shown UNION ALL SELECT workspace_id, target_id FROM shown),
 d AS (SELECT n.workspace_id, n.id, n.type, n.label, CASE n.type {COLUMN} ELSE 8 END AS col, count(e.id) AS degree FROM nodes_t n LEFT JOIN ends e ON e.workspace_id = n.workspace_id AND e.id = n.id GROUP BY ALL),
 p AS (SELECT *, min(col) OVER (PARTITION BY workspace_id) AS low, row_number() OVER (PARTITION BY workspace_id, col ORDER BY degree DESC, type, label) AS r FROM d)
SELECT workspace_id, type, ((col - low) * 260)::INTEGER AS x, (r - 1) * 128 AS y, degree FROM p""")
def _(t):
    return G.layout(shown_ends(t), nodes(t)).select("workspace_id", "type", "x", "y", "degree")


@query("dominant_asset", "E28", f"""{VISIBLE}, ends AS (SELECT workspace_id, source_id AS id FROM shown UNION ALL SELECT workspace_id, target_id FROM shown),
 links AS (SELECT s.workspace_id, CASE WHEN a.type = 'Equipment' THEN s.target_id ELSE s.source_id END AS id, CASE WHEN a.type = 'Equipment' THEN s.source_id ELSE s.target_id END AS asset_id
  FROM shown s JOIN nodes_t a ON a.workspace_id = s.workspace_id AND a.id = s.source_id JOIN nodes_t b ON b.workspace_id = s.workspace_id AND b.id = s.target_id WHERE (a.type = 'Equipment') <> (b.type = 'Equipment')),
 c AS (SELECT workspace_id, id, asset_id, count(*) AS links FROM links GROUP BY ALL), d AS (SELECT workspace_id, id, count(*) AS degree FROM ends GROUP BY ALL)
SELECT workspace_id, id, asset_id, links FROM (SELECT c.*, row_number() OVER (PARTITION BY c.workspace_id, c.id ORDER BY links DESC, degree DESC, label, asset_id) AS r
 FROM c JOIN d ON d.workspace_id = c.workspace_id AND d.id = c.asset_id JOIN nodes_t n ON n.workspace_id = c.workspace_id AND n.id = c.asset_id) WHERE r = 1""")
def _(t):
    return G.dominant_asset(shown_ends(t), nodes(t))


@query("core_nodes", "C15", f"{EDGES}{NODES} SELECT workspace_id, id FROM nodes_t WHERE type NOT IN ({Q.quoted(V.CORE_EXCLUDED_TYPES)}) AND (contains(lower(label), 'l 1') OR contains(lower(type), 'l 1'))")
def _(t):
    return G.filter_nodes(nodes(t), "Core", "L 1").select("workspace_id", "id")


@query("mention_join", "D7", f"""{S.WITH} SELECT e.id, a.asset_id FROM entities_t e JOIN assets_t a ON a.workspace_id = e.workspace_id AND contains(upper(e.value || ' ' || e.context || ' ' || e.filename), upper(a.asset_id)) WHERE e.entity_type <> 'Equipment'""")
def _(t):
    rows = S.entities(t).where(F.col("entity_type") != "Equipment")
    return G.related_assets(rows, S.assets(t)).select("id", "asset_id")


@query("mentions_in_documents", "D7", r"""
SELECT d.doc_id, a.asset_id FROM documents d JOIN (SELECT DISTINCT 'th' || substr(c_mktsegment, 1, 1) AS asset_id FROM customer UNION SELECT DISTINCT lower(substr(p_type, 2, 2)) FROM part) a ON contains(upper(d.text), upper(a.asset_id))""")
def _(t):
    ids = t.customer.select(F.concat(F.lit("th"), F.substring("c_mktsegment", 1, 1)).alias("asset_id")).union(t.part.select(F.lower(F.substring("p_type", 2, 2)))).distinct()
    docs = t.documents.select(F.lit("w").alias("workspace_id"), "doc_id", "text")
    return G.mention_pairs(docs, ids.withColumn("workspace_id", F.lit("w")), ["workspace_id", "doc_id"], F.col("text")).select("doc_id", "asset_id")


@query("failure_patterns", "D9", f"{S.WITH} SELECT DISTINCT a.workspace_id, a.asset_id, e.value FROM (SELECT *, replace(context, 'c-', 'C-') AS ctx FROM entities_t) e JOIN assets_t a ON a.workspace_id = e.workspace_id AND contains(ctx, a.asset_id) WHERE entity_type = 'Failure Mode'")
def _(t):
    rows = S.entities(t).withColumn("context", F.replace("context", F.lit("c-"), F.lit("C-")))
    return R.failure_patterns(rows, S.assets(t))


PATHS = VISIBLE + """, inc AS (SELECT a.workspace_id, a.asset_id, s.* EXCLUDE (workspace_id) FROM shown s JOIN assets_t a ON a.workspace_id = s.workspace_id AND (a.asset_id = s.source_id OR a.asset_id = s.target_id)),
 top AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, asset_id ORDER BY CASE validation_status WHEN 'accepted' THEN 3 WHEN 'weak' THEN 2 ELSE 1 END DESC, confidence DESC, relation_type DESC, rule, k1, k2, at_id, sub) AS k FROM inc)"""


@query("incident_edges", "D14", f"{PATHS} SELECT workspace_id, asset_id, {EDGE_SQL} FROM inc")
def _(t):
    return G.incident_edges(shown(t), S.assets(t)).select("workspace_id", "asset_id", *EDGE_FIELDS)


@query("path_edges", "F4", f"{PATHS} SELECT workspace_id, asset_id, {EDGE_SQL}, k AS rank FROM top WHERE k <= 12")
def _(t):
    return G.path_edges(shown(t), S.assets(t)).select("workspace_id", "asset_id", *EDGE_FIELDS, "rank")


@query("evidence_paths", "J5 E16", f"""{PATHS}, best AS (SELECT * FROM top WHERE k <= 12),
 ends AS (SELECT workspace_id, asset_id, source_id AS id FROM best UNION SELECT workspace_id, asset_id, target_id FROM best UNION SELECT workspace_id, asset_id, asset_id FROM best),
 named AS (SELECT e.workspace_id, e.asset_id, string_agg(n.id || '=' || n.label || '=' || n.type, '|' ORDER BY n.id) AS nodes FROM ends e JOIN nodes_t n ON n.workspace_id = e.workspace_id AND n.id = e.id GROUP BY ALL)
SELECT workspace_id, asset_id, count(*)::INTEGER AS edges, round(avg(confidence), 6) AS mean_confidence,
 string_agg(source_id || '>' || relation_type || '>' || target_id || '>' || evidence_text, '|' ORDER BY k) AS edge_list, any_value(nodes) AS node_list
FROM best JOIN named USING (workspace_id, asset_id) GROUP BY workspace_id, asset_id""")
def _(t):
    paths = G.paths(shown(t), nodes(t), S.assets(t))
    mean = F.aggregate("edges", F.lit(0.0), lambda a, e: a + e["confidence"]) / F.size("edges")
    edge = lambda e: F.concat_ws(">", e["source_id"], e["relation_type"], e["target_id"], e["evidence_text"])
    node = lambda n: F.concat_ws("=", n["id"], n["label"], n["type"])
    return paths.select(
        "workspace_id", "asset_id", F.size("edges").alias("edges"), F.round(mean, 6).alias("mean_confidence"),
        F.array_join(F.transform("edges", edge), "|").alias("edge_list"), F.array_join(F.transform("nodes", node), "|").alias("node_list"),
    )


@query("path_evidence_rows", "J6", f"{PATHS} SELECT workspace_id, asset_id, k AS rank, round(confidence, 2) AS confidence, validation_status AS status, source_document AS document, source_page AS page FROM top WHERE k <= 8")
def _(t):
    rows = G.path_evidence(G.paths(shown(t), nodes(t), S.assets(t)))
    return rows.select("workspace_id", "asset_id", "rank", F.round("confidence", 2).alias("confidence"), "status", "document", "page")


@query("path_of_node", "J7", f"{PATHS} SELECT workspace_id, asset_id AS id, asset_id FROM top WHERE k = 1")
def _(t):
    # Assets are only linked to other node types, so the path of an asset node is its own.
    paths = G.paths(shown(t), nodes(t), S.assets(t))
    wanted = S.assets(t).select("workspace_id", F.col("asset_id").alias("id"))
    return G.path_of_node(paths, wanted)


@query("node_neighbours", "D16", f"""{VISIBLE} SELECT DISTINCT workspace_id, id FROM (
 SELECT workspace_id, source_id AS id FROM shown WHERE starts_with(target_id, 'Location:') UNION ALL SELECT workspace_id, target_id FROM shown WHERE starts_with(source_id, 'Location:') UNION ALL SELECT workspace_id, id FROM nodes_t WHERE type = 'Location')""")
def _(t):
    picked = nodes(t).where(F.col("type") == "Location")
    return G.neighbours(shown_ends(t), picked)


@query("cypher_nodes", "A18", f"""{EDGES}{NODES}
SELECT 'MERGE (n:EvidenceNode {{id: ''' || id || '''}}) SET n.label = ''' || replace(label, '''', '\\''') || ''', n.type = ''' || type || ''', n.details_json = ''{{}}'';' AS line FROM nodes_t""")
def _(t):
    return G.cypher_nodes(nodes(t).withColumn("details", F.lit("{}"))).select("line")


@query("cypher_edges", "A18", f"""{EDGES}
SELECT 'MATCH (a:EvidenceNode {{id: ''' || source_id || '''}}), (b:EvidenceNode {{id: ''' || target_id || '''}}) MERGE (a)-[r:' || relation_type || ']->(b) SET r += {{label: ''' || relation_type || ''', relation_type: ''' || relation_type
 || ''', source_node: ''' || source_id || ''', target_node: ''' || target_id || ''', confidence: ' || round(confidence, 2)::DOUBLE || ', source_document: ''' || source_document || ''', source_page: ' || source_page || ', evidence_text: '''
 || evidence_text || ''', validation_status: ''' || validation_status || ''', validation_reason: ''-''}};' AS line FROM edges_t""")
def _(t):
    return G.cypher_edges(edges(t).withColumn("validation_reason", F.lit("-"))).select("line")


@query("graph_json_export", "A17", f"{EDGES}{NODES} SELECT workspace_id, id, label FROM nodes_t")
def _(t):
    lines = G.node_json(nodes(t, details=True))
    parsed = F.from_json("line", "id string, data struct<label:string,type:string,details:string>")
    return lines.select("workspace_id", parsed.alias("n")).select("workspace_id", "n.id", F.col("n.data.label").alias("label"))


@query("edge_json_export", "A17", f"{VISIBLE} SELECT workspace_id, {EDGE_SQL}, relation_type AS label FROM shown")
def _(t):
    lines = G.edge_json(shown(t))
    schema = "source_id string, target_id string, relation_type string, confidence double, validation_status string, source_document string, source_page int, evidence_text string, label string"
    return lines.select("workspace_id", F.from_json("line", schema).alias("e")).select("workspace_id", "e.*")


@query("stored_edge_defaults", "J3", f"{EDGES} SELECT workspace_id, source_id, target_id, relation_type AS label, CASE WHEN starts_with(relation_type, 'MENTIONED') THEN 'weak' ELSE validation_status END AS validation_status FROM edges_t")
def _(t):
    stored = edges(t).withColumn("label", F.lit(None).cast("string")).withColumn(
        "validation_status", F.when(~F.col("relation_type").startswith("MENTIONED"), F.col("validation_status"))
    )
    return G.stored_edges(stored).select("workspace_id", "source_id", "target_id", "label", "validation_status")


# -- reports ----------------------------------------------------------------------
@query("compliance_pack", "A19", f"""{S.WITH}, n AS (SELECT workspace_id, count(*) AS n, count(*) FILTER (status = 'Open') AS o, count(*) FILTER (severity = 'High') AS h FROM gaps_t GROUP BY 1)
SELECT workspace_id, 0::BIGINT AS id, unnest(['# Compliance Evidence Pack', '', 'Generated: ', '', '## Summary', '', '- Total gaps: ' || n, '- Open gaps: ' || o, '- High severity gaps: ' || h, '', '## Findings', '']) AS line FROM n
UNION ALL SELECT workspace_id, id, unnest(['### ' || asset_id || ' | ' || gap_type, '', '- Severity: ' || severity, '- Status: ' || status, '- Description: ' || description, '- Evidence: ' || evidence,
 '- Source: ' || source_document || ', page ' || source_page, '- Evidence status: accepted', '- Corrective action: ' || corrective_action, '']) FROM gaps_t""")
def _(t):
    return R.compliance_pack(S.gaps(t)).select("workspace_id", "id", "line")


@query("asset_pack", "A19", f"""{PATHS}, lines AS (
 SELECT workspace_id, asset_id, 13 AS n FROM assets_t UNION ALL SELECT workspace_id, asset_id, 18 FROM assets_t UNION ALL SELECT workspace_id, asset_id, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END FROM assets_t
 UNION ALL SELECT a.workspace_id, a.asset_id, greatest(1, 10 * count(g.id)) FROM assets_t a LEFT JOIN gaps_t g ON g.asset_id = a.asset_id GROUP BY ALL
 UNION ALL SELECT a.workspace_id, a.asset_id, greatest(1, count(g.id)) FROM assets_t a LEFT JOIN events_t g ON g.asset_id = a.asset_id GROUP BY ALL
 UNION ALL SELECT a.workspace_id, a.asset_id, greatest(1, count(g.document_id)) FROM assets_t a LEFT JOIN links_t g ON g.asset_id = a.asset_id GROUP BY ALL
 UNION ALL SELECT a.workspace_id, a.asset_id, greatest(1, 10 * count(g.id)) FROM assets_t a LEFT JOIN contradictions_t g ON g.asset_id = a.asset_id GROUP BY ALL
 UNION ALL SELECT a.workspace_id, a.asset_id, CASE WHEN count(p.k) = 0 THEN 1 ELSE 4 + count(p.k) END FROM assets_t a LEFT JOIN top p ON p.workspace_id = a.workspace_id AND p.asset_id = a.asset_id AND p.k <= 12 GROUP BY ALL)
SELECT asset_id, sum(n)::BIGINT AS lines FROM lines GROUP BY asset_id""")
def _(t):
    pack = R.asset_pack(S.assets(t), S.gaps(t), S.events(t), S.links(t).where(F.col("document_id") >= 0), S.documents(t), S.contradictions(t), shown(t))
    # Source and evidence lines of an edge depend on which of several equal edges is shown.
    return pack.where(~F.col("line").startswith("  ")).groupBy("asset_id").agg(F.count("*").alias("lines"))


@query("asset_detail", "K3", f"""{S.WITH}
SELECT asset_id, 'asset' AS section, '' AS sort_key, 0::BIGINT AS sort_id, name AS label, asset_type || ' | ' || location || ' | ' || risk_level AS detail FROM assets_t
UNION ALL SELECT l.asset_id, 'document', d.filename, d.id, d.filename, d.document_type FROM links_t l JOIN documents_t d ON d.workspace_id = l.workspace_id AND d.id = l.document_id
UNION ALL SELECT asset_id, 'event', event_date, id, title, event_type FROM events_t""")
def _(t):
    return R.asset_detail(S.assets(t), S.links(t), S.documents(t), S.events(t)).drop("workspace_id")


@query("risk_summary", "K4", f"""{PATHS}
SELECT asset_id, 'risk' AS section, risk_level AS label, coalesce(last_inspection, '') AS detail FROM assets_t
UNION ALL SELECT asset_id, 'gap', gap_type, CASE WHEN evidence <> '' THEN 'accepted' ELSE 'rejected' END FROM gaps_t
UNION ALL SELECT asset_id, 'event', title, event_type FROM events_t
UNION ALL SELECT asset_id, 'action', unnest(['Inspect ' || asset_id, 'Review the log']), source_document || ' | ' || source_page || ' | ' || evidence_text FROM assets_t WHERE c_custkey % 2 = 0
UNION ALL SELECT asset_id, 'failure_pattern', value, '' FROM (SELECT DISTINCT a.workspace_id, a.asset_id, e.value FROM entities_t e JOIN assets_t a ON a.workspace_id = e.workspace_id AND contains(e.context, a.asset_id) WHERE entity_type = 'Failure Mode')
UNION ALL SELECT asset_id, 'path_edge', source_id || ' -> ' || relation_type || ' -> ' || target_id, validation_status FROM top WHERE k <= 12
UNION ALL SELECT asset_id, 'contradiction', contradiction_type, description FROM contradictions_t""")
def _(t):
    summary = R.risk_summary(S.assets(t), S.gaps(t), S.entities(t), S.events(t), S.contradictions(t), shown(t))
    return summary.select("asset_id", "section", "label", "detail")


@query("document_detail", "K6", f"""{S.WITH}
SELECT id AS document_id, 'document' AS section, '' AS sort_key, 0::BIGINT AS sort_id, filename AS label FROM documents_t
UNION ALL SELECT document_id, 'entity', entity_type || chr(9) || value, e.id, value FROM entities_t e JOIN documents_t d ON d.workspace_id = e.workspace_id AND d.id = e.document_id
UNION ALL SELECT l_suppkey, 'chunk', '', l_orderkey, l_returnflag FROM lineitem""")
def _(t):
    workspace = F.concat(F.lit("w"), (F.col("l_suppkey") % 4).cast("string")).alias("workspace_id")
    chunks = t.lineitem.select(workspace, F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("chunk_index"), F.col("l_returnflag").alias("text"))
    return R.document_detail(S.documents(t), chunks, S.entities(t)).drop("workspace_id")


# -- question and root-cause bundles -------------------------------------------------
def matches(t) -> DataFrame:
    """Six best retrieval chunks per benchmark question with their text."""
    hits = I.lexical_hits(t, V.TOP_CHUNKS)
    rows = hits.join(I.hit_texts(t, hits), ["chunk_id", "text_hash"])
    return rows.select("query_id", "rank", "score", F.col("document").alias("filename"), "page", "text", F.col("page").alias("document_id"))


MATCHES = f"""m AS MATERIALIZED (SELECT l.query_id, l.rank, l.score, l.chunk_id, split_part(l.chunk_id, '#', 1) || '.txt' AS filename, l.page, c.text
  FROM ({I.lexical_sql(I.QUESTIONS_SQL, 6)}) l JOIN ({I.CHUNKS_SQL}) c ON c.document_id || '#' || c.chunk_index = l.chunk_id)"""


@query("question_citations", "K1 B14", f"WITH {MATCHES} SELECT query_id, rank, filename AS document, page, CASE WHEN length(text) <= 280 THEN text ELSE rtrim(substr(text, 1, 280)) || '...' END AS snippet FROM m WHERE rank <= 4")
def _(t):
    return R.citations(matches(t))


@query("question_context", "B38 K2", f"WITH {MATCHES} SELECT query_id, md5(string_agg(filename || ' page ' || page || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM m GROUP BY query_id")
def _(t):
    return R.context_text(matches(t)).select("query_id", F.md5("context_text").alias("digest"))


@query("cited_documents", "H5 K2", f"WITH {MATCHES} SELECT query_id, array_to_string(list_sort(list(DISTINCT filename)), '|') AS documents FROM m WHERE rank <= 4 GROUP BY query_id")
def _(t):
    return R.cited_documents(R.citations(matches(t))).select("query_id", F.array_join("cited_documents", "|").alias("documents"))


ASKED = "SELECT item_id AS query_id, 'w' || (item_id % 4) AS workspace_id, text || ' c-' || (item_id * 3) || ' and X' AS query FROM benchmark"


@query("asset_mentions_in_questions", "D8", f"""{S.WITH} SELECT query_id, asset_id, rank FROM (SELECT q.query_id, a.asset_id, row_number() OVER (PARTITION BY q.query_id ORDER BY a.asset_id) AS rank
 FROM ({ASKED}) q JOIN assets_t a ON a.workspace_id = q.workspace_id AND contains(lower(q.query), lower(a.asset_id))) WHERE rank <= 3""")
def _(t):
    asked, none = _asked(t), t.benchmark.limit(0)
    empty = none.select(F.lit("w").alias("workspace_id"), F.col("item_id").alias("query_id"), F.lit(0).alias("rank"), "text", F.lit("").alias("filename"))
    return R.mentioned_assets(asked, empty, S.assets(t)).select("query_id", "asset_id", "rank")


def _asked(t) -> DataFrame:
    workspace = F.concat(F.lit("w"), (F.col("item_id") % 4).cast("string"))
    question = F.concat("text", F.lit(" c-"), (F.col("item_id") * 3).cast("string"), F.lit(" and X"))
    return t.benchmark.select(F.col("item_id").alias("query_id"), workspace.alias("workspace_id"), question.alias("query"))


@query("question_bundle", "K1 D4 D8 C18", f"""WITH {MATCHES}, {PATHS[5:]}, asked AS ({ASKED}),
 hay AS (SELECT workspace_id, query_id, query AS hay FROM asked UNION ALL SELECT 'w' || (query_id % 4), query_id, text || ' ' || filename FROM m),
 named AS (SELECT query_id, workspace_id, asset_id, row_number() OVER (PARTITION BY workspace_id, query_id ORDER BY asset_id) AS place FROM (SELECT DISTINCT h.query_id, h.workspace_id, a.asset_id FROM hay h JOIN assets_t a ON a.workspace_id = h.workspace_id AND contains(upper(h.hay), upper(a.asset_id)))),
 related AS (SELECT query_id, value, row_number() OVER (PARTITION BY query_id ORDER BY value) AS r FROM (SELECT DISTINCT k.query_id, e.value FROM (SELECT DISTINCT query_id, 'w' || (query_id % 4) AS workspace_id, page % 8 AS document_id FROM m) k JOIN entities_t e USING (workspace_id, document_id) WHERE entity_type IN ({Q.quoted(V.RELATED_TYPES)})))
SELECT query_id, 'citation' AS section, rank::BIGINT AS rank, filename AS label, CASE WHEN length(text) <= 280 THEN text ELSE rtrim(substr(text, 1, 280)) || '...' END AS detail, page::DOUBLE AS score FROM m WHERE rank <= 4
UNION ALL SELECT query_id, 'confidence', 1, 'confidence', '', {Q.half_even(f'least({V.ANSWER_CONFIDENCE_CAP}, max(score))', 2)} FROM m GROUP BY query_id
UNION ALL SELECT query_id, 'related_entity', r, value, '', NULL FROM related WHERE r <= 12
UNION ALL SELECT n.query_id, 'path_edge', n.place * 100 + p.k, n.asset_id, p.source_id || ' -> ' || p.relation_type || ' -> ' || p.target_id, round(p.confidence, 2)::DOUBLE FROM named n JOIN top p ON p.workspace_id = n.workspace_id AND p.asset_id = n.asset_id AND p.k <= 12 WHERE n.place <= 3
UNION ALL SELECT query_id, 'status', 1, 'no_match', 'No uploaded evidence matched this question. Upload relevant documents first.', NULL FROM asked WHERE query_id NOT IN (SELECT query_id FROM m)""")
def _(t):
    found = matches(t).withColumn("workspace_id", F.concat(F.lit("w"), (F.col("query_id") % 4).cast("string"))).withColumn("document_id", F.col("page") % 8)
    bundle = R.question_bundle(_asked(t), found, S.entities(t), S.assets(t), shown(t))
    return bundle.withColumn("score", F.when(F.col("section") == "path_edge", F.round("score", 2)).otherwise(F.col("score")))


@query("rca_bundle", "K2 B27", f"""WITH {MATCHES}, lists AS (SELECT item_id AS query_id, 'likely_causes' AS section, split_part({Q.squeeze('text')}, ' ', 1) AS item FROM benchmark UNION ALL SELECT item_id, 'likely_causes', split_part({Q.squeeze('text')}, ' ', 2) FROM benchmark
 UNION ALL SELECT item_id, 'recommended_checks', 'Check it' FROM benchmark UNION ALL SELECT item_id, 'preventive_actions', 'LLM RCA response returned no preventive_actions.' FROM benchmark)
SELECT l.query_id, l.section, l.item AS text, m.rank AS citation, m.filename AS document FROM lists l LEFT JOIN (SELECT * FROM m WHERE rank <= 2) m USING (query_id)""")
def _(t):
    words = F.split(X.squeeze("text"), " ")
    first, second = words[0], words[1]
    lists = F.struct(F.array(first, second, F.lit(" ")).alias("likely_causes"), F.array(F.lit(" Check  it ")).alias("recommended_checks"), F.array(F.lit("")).alias("preventive_actions"))
    payload = t.benchmark.select(F.col("item_id").alias("query_id"), F.to_json(lists).alias("content"))
    return R.rca_items(payload, R.citations(matches(t))).select("query_id", "section", "text", "citation", "document")


@query("rca_query_text", "K2", "SELECT item_id, 'Root cause analysis for C-' || item_id || ': ' || text AS query FROM benchmark")
def _(t):
    return t.benchmark.select("item_id", R.rca_query(F.concat(F.lit("c-"), F.col("item_id").cast("string")), "text").alias("query"))
