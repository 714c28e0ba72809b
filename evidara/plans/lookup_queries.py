"""Filters, joins, lists, counts, limits and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidara.functions import vocab as V
from evidara.functions.ordering import first_by
from evidara.functions.ordering import position
from evidara.operators import ingest, lookups as L, reports as R, store
from evidara.plans import standins as S
from evidara.plans import twin as Q
from evidara.plans.registry import query
from evidara.session import settle, shared_folder

NATION_ASSETS = "SELECT n_name AS workspace_id, c_custkey AS id, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey"


@query("workspace_scope", "C1", "SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_3'")
def _(t):
    scoped = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).withColumnRenamed("n_name", "workspace_id")
    return L.in_workspace(scoped, "NATION_3").select("c_custkey", "c_name")


@query("document_type_filter", "C2", "SELECT doc_id, source FROM documents WHERE upper(source) = 'SRC3'")
def _(t):
    return L.of_document_type(t.documents.withColumn("document_type", F.col("source")), "SrC3").select("doc_id", "source")


EMBEDDED = "SELECT d.doc_id, d.lang, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"


def embedded(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return t.documents.select("doc_id", "lang", "text").join(vectors, "doc_id", "left")


@query("embedding_presence", "C3", f"SELECT lang, count(embedding)::BIGINT AS present, count(*) FILTER (embedding IS NULL)::BIGINT AS missing FROM ({EMBEDDED}) GROUP BY lang")
def _(t):
    return embedded(t).groupBy("lang").agg(F.count("embedding").alias("present"), F.count_if(F.col("embedding").isNull()).alias("missing"))


@query("missing_embeddings", "G7", f"SELECT doc_id FROM ({EMBEDDED}) WHERE embedding IS NULL")
def _(t):
    from evidara.operators.search import missing_embeddings

    return missing_embeddings(embedded(t)).select("doc_id")


@query("keyed_embedding_update", "A20", """
SELECT d.doc_id, CASE WHEN n.vec_id IS NOT NULL THEN -n.embedding[1] ELSE e.embedding[1] END AS head
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN embeddings n ON n.vec_id = d.doc_id AND n.label < 3""")
def _(t):
    from evidara.operators.search import update_embeddings

    new = t.embeddings.where(F.col("label") < 3).select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    return update_embeddings(embedded(t), new, ["doc_id"]).select("doc_id", F.try_element_at("embedding", F.lit(1)).alias("head"))


@query("entity_search", "C11", "SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' AND (contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt'))")
def _(t):
    return L.search_rows(L.facet(t.part, "p_type", "SMALL"), ["p_name", "p_brand"], " Bolt ").select("p_partkey", "p_name")


@query("gap_search", "C12", f"{S.WITH} SELECT id, asset_id FROM gaps_t WHERE severity = 'High' AND status = 'Open' AND (contains(lower(asset_id), '77') OR contains(lower(gap_type), '77') OR contains(lower(description), '77') OR contains(lower(evidence), '77'))")
def _(t):
    rows = L.facet(L.facet(S.gaps(t), "severity", "High"), "status", "Open")
    return L.search_rows(rows, ["asset_id", "gap_type", "description", "evidence"], "77").select("id", "asset_id")


@query("asset_search", "C13", f"{S.WITH} SELECT asset_id, location FROM assets_t WHERE contains(lower(name), 'nation_1') OR contains(lower(asset_id), 'nation_1') OR contains(lower(location), 'nation_1')")
def _(t):
    return L.search_rows(S.assets(t), ["name", "asset_id", "location"], "Nation_1").select("asset_id", "location")


@query("timeline_type_filter", "C14", f"{S.WITH} SELECT id, event_date FROM events_t WHERE event_type = 'Incident'")
def _(t):
    return L.facet(S.events(t), "event_type", "Incident").select("id", "event_date")


@query("point_lookup", "C19", f"{S.WITH} SELECT asset_id, name FROM assets_t WHERE asset_id IN (SELECT upper('c-' || user_id) FROM events)")
def _(t):
    wanted = t.events.select(F.concat(F.lit("c-"), F.col("user_id").cast("string")).alias("asset_id"))
    return L.by_ids(S.assets(t), wanted, "asset_id").select("asset_id", "name")


@query("required_result_status", "C18", f"""
SELECT q.item_id, CASE WHEN count(d.doc_id) = 0 THEN 'no_match' ELSE 'ok' END AS status
FROM benchmark q LEFT JOIN documents d ON {Q.compact('d.text')} = {Q.compact('q.text')} GROUP BY q.item_id""")
def _(t):
    from evidara.functions.text import compact

    d = t.documents.select(compact("text").alias("k")).distinct().withColumn("hit", F.lit(1))
    q = t.benchmark.select("item_id", compact("text").alias("k"))
    return q.join(d, "k", "left").select("item_id", F.when(F.col("hit").isNull(), "no_match").otherwise("ok").alias("status"))


# -- joins ---------------------------------------------------------------------
@query("chunk_document_join", "D1", """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus AS filename, o_orderpriority AS document_type
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(t):
    docs = t.orders.select(F.lit("w").alias("workspace_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("filename"), F.col("o_orderpriority").alias("document_type"))
    rows = t.lineitem.select(F.lit("w").alias("workspace_id"), F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_partkey")
    return L.with_documents(rows, docs).select(F.col("document_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "filename", "document_type")


@query("entity_document_join", "D2", f"{S.WITH} SELECT e.id, e.value, d.filename, d.document_type FROM entities_t e JOIN documents_t d ON d.workspace_id = e.workspace_id AND d.id = e.document_id")
def _(t):
    return L.with_documents(S.entities(t).drop("filename"), S.documents(t)).select("id", "value", "filename", "document_type")


@query("asset_document_join", "D3", f"{S.WITH} SELECT l.asset_id, l.document_id, d.filename FROM links_t l JOIN documents_t d ON d.workspace_id = l.workspace_id AND d.id = l.document_id")
def _(t):
    return L.with_documents(S.links(t), S.documents(t)).select("asset_id", "document_id", "filename")


@query("related_values", "D4 H5", f"""{S.WITH}
SELECT query_id, value, rank FROM (SELECT query_id, value, row_number() OVER (PARTITION BY query_id ORDER BY value) AS rank FROM (
  SELECT DISTINCT m.query_id, e.value FROM (SELECT DISTINCT c_nationkey AS query_id, 'w' || (c_custkey % 4) AS workspace_id, c_custkey % 8 AS document_id FROM customer) m
  JOIN entities_t e ON e.workspace_id = m.workspace_id AND e.document_id = m.document_id WHERE e.entity_type IN ('Equipment', 'Failure Mode', 'Spare Part'))) WHERE rank <= 12""")
def _(t):
    matches = t.customer.select(
        F.col("c_nationkey").alias("query_id"), F.concat(F.lit("w"), (F.col("c_custkey") % 4).cast("string")).alias("workspace_id"),
        (F.col("c_custkey") % 8).alias("document_id"),
    )
    return L.related_values(S.entities(t), matches)


@query("surviving_assets_only", "D10", f"{S.WITH} SELECT id FROM events_t WHERE (workspace_id, asset_id) IN (SELECT workspace_id, asset_id FROM assets_t WHERE risk_level = 'High')")
def _(t):
    from evidara.operators.merge import of_known_assets

    return of_known_assets(S.events(t), S.assets(t).where(F.col("risk_level") == "High")).select("id")


@query("filename_to_document", "D12", f"""{S.WITH}
SELECT DISTINCT a.asset_id, d.id AS document_id FROM (SELECT workspace_id, asset_id, 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') || '.txt' AS filename FROM assets_t) a
JOIN (SELECT workspace_id, filename, max(id) AS id FROM documents_t GROUP BY ALL) d USING (workspace_id, filename)""")
def _(t):
    from evidara.operators.merge import asset_sources

    named = S.assets(t).withColumn("source_document", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 40).cast("string"), 9, "0"), F.lit(".txt")))
    return asset_sources(named, S.documents(t)).select("asset_id", "document_id")


@query("already_ingested", "D15 A9", """
SELECT d.doc_id, (SELECT min(s.doc_id) FROM documents s WHERE s.text = d.text AND s.source < 'src15') AS stored_id FROM documents d WHERE d.source >= 'src15'""")
def _(t):
    hashed = t.documents.select("doc_id", "source", ingest.content_hash("text").alias("h"))
    stored = hashed.where(F.col("source") < "src15").groupBy("h").agg(F.min("doc_id").alias("stored_id"))
    return hashed.where(F.col("source") >= "src15").join(stored, "h", "left").select("doc_id", "stored_id")


# -- counts and distributions ---------------------------------------------------
@query("dashboard_counts", "E1", f"""{S.WITH}
SELECT d.workspace_id, d.n AS total_documents, a.n AS total_assets, a.h AS high_risk_assets, g.n AS detected_compliance_gaps
FROM (SELECT workspace_id, count(*) AS n FROM documents_t GROUP BY 1) d JOIN (SELECT workspace_id, count(*) AS n, count(*) FILTER (risk_level = 'High') AS h FROM assets_t GROUP BY 1) a USING (workspace_id)
JOIN (SELECT workspace_id, count(*) AS n FROM gaps_t GROUP BY 1) g USING (workspace_id)""")
def _(t):
    return L.dashboard(S.documents(t), S.assets(t), S.gaps(t))


@query("top_failure_modes", "E2", f"""{S.WITH}
SELECT value, count(*) AS count FROM entities_t WHERE entity_type = 'Failure Mode' GROUP BY value ORDER BY count(*) DESC, min(id) LIMIT 5""")
def _(t):
    return L.top_values(S.entities(t).where(F.col("entity_type") == "Failure Mode"), "value", "id", 5)


@query("severity_distribution", "E3", f"{S.WITH} SELECT severity, count(*) AS count, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM gaps_t GROUP BY severity")
def _(t):
    return L.distribution(S.gaps(t), "severity")


@query("priority_gap", "E4", f"""{S.WITH}
SELECT workspace_id, id, severity FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY CASE WHEN severity = 'High' THEN 0 ELSE 1 END, id) AS r FROM gaps_t) WHERE r = 1""")
def _(t):
    return L.pick_first(S.gaps(t), F.lower("severity") == "high", "id", ["workspace_id"]).select("workspace_id", "id", "severity")


@query("gap_counts", "E6", f"{S.WITH} SELECT workspace_id, count(*) AS total_gaps, count(*) FILTER (status = 'Open') AS open_gaps, count(*) FILTER (severity = 'High') AS high_gaps FROM gaps_t GROUP BY 1")
def _(t):
    return L.gap_counts(S.gaps(t))


@query("facet_values", "E26", f"{S.WITH} SELECT DISTINCT event_type FROM events_t")
def _(t):
    return L.facet_values(S.events(t), "event_type")


@query("table_counts", "E27", "SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS before, 0 AS after UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), 0 UNION ALL SELECT 'events', (SELECT count(*) FROM events), 0")
def _(t):
    # Stored copies are counted, truncated and counted again.
    root, names = f"{shared_folder(t.spark).rstrip('/')}/tables-{uuid.uuid4().hex}", ["orders", "lineitem", "events"]
    for name in names:
        getattr(t, name).write.parquet(f"{root}/{name}")
    before = settle(store.stored_counts(t.spark, root, names).withColumnRenamed("row_count", "before"))
    store.truncate(t.spark, root, names)
    return before.join(store.stored_counts(t.spark, root, names).withColumnRenamed("row_count", "after"), "table_name")


# -- orders and limits ----------------------------------------------------------
@query("severity_order", "G3", f"{S.WITH} SELECT id, severity FROM gaps_t")
def _(t):
    return L.by_severity(S.gaps(t), "severity", F.desc("id")).select("id", "severity")


@query("severity_order_head", "G3 G6", f"""{S.WITH} SELECT id, asset_id, severity FROM contradictions_t
ORDER BY CASE severity WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END, asset_id, id DESC""")
def _(t):
    return L.by_severity(S.contradictions(t), "severity", F.col("asset_id"), F.desc("id")).select("id", "asset_id", "severity")


@query("plain_orders", "G4", f"""{S.WITH}
SELECT 'timeline' AS list, id, row_number() OVER (ORDER BY event_date DESC, id DESC) AS position FROM events_t
UNION ALL SELECT 'pack', id, row_number() OVER (ORDER BY severity, asset_id, id) FROM gaps_t
UNION ALL SELECT 'entities', id, row_number() OVER (ORDER BY entity_type, value, id) FROM entities_t
UNION ALL SELECT 'documents', id, row_number() OVER (ORDER BY id DESC) FROM documents_t""")
def _(t):
    lists = {
        "timeline": (S.events(t), [F.desc("event_date"), F.desc("id")]),
        "pack": (S.gaps(t), [F.col("severity"), F.col("asset_id"), F.col("id")]),
        "entities": (S.entities(t), [F.col("entity_type"), F.col("value"), F.col("id")]),
        "documents": (S.documents(t), [F.desc("id")]),
    }
    parts = [position(df, [], order).select(F.lit(name).alias("list"), "id", "position") for name, (df, order) in lists.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("recent_documents", "G6", "SELECT id, hidden FROM (SELECT doc_id AS id FROM documents ORDER BY doc_id DESC LIMIT 8) CROSS JOIN (SELECT greatest(count(*) - 8, 0) AS hidden FROM documents)")
def _(t):
    docs = S.texts(t)
    hidden = L.hidden_count(docs, V.DOCUMENT_PREVIEW).scalar()
    return L.preview(docs, [F.desc("id")], V.DOCUMENT_PREVIEW).select("id", hidden.alias("hidden"))


RUNS = """SELECT 'w' || (user_id % 4) AS workspace_id, event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'complete' END AS status,
  (event_id % 50) AS documents_ingested FROM events"""


def runs(t):
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("complete")
    return t.events.select(
        F.concat(F.lit("w"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), F.col("event_id").alias("id"), state.alias("status"),
        F.lit("").alias("message"), (F.col("event_id") % 50).alias("documents_ingested"),
    )


@query("latest_run", "G5 E14", f"SELECT workspace_id, max(id) AS id, arg_max(status, id) AS status FROM ({RUNS}) GROUP BY workspace_id")
def _(t):
    return runs(t).groupBy("workspace_id").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"))


@query("stale_status", "C17 E14", f"""{S.WITH}
SELECT r.workspace_id, r.id, CASE WHEN r.status = 'complete' AND n <> documents_ingested THEN 'stale' ELSE r.status END AS status,
 CASE WHEN r.status = 'complete' THEN n ELSE documents_ingested END AS documents_ingested
FROM (SELECT workspace_id, max(id) AS id, arg_max(status, id) AS status, arg_max(documents_ingested, id) AS documents_ingested FROM ({RUNS}) GROUP BY workspace_id) r
JOIN (SELECT workspace_id, count(*) AS n FROM documents_t GROUP BY 1) USING (workspace_id)""")
def _(t):
    return store.latest_status(runs(t), S.documents(t)).select("workspace_id", "id", "status", "documents_ingested")


@query("stage_table", "E15", f"""{S.WITH}, s AS (
  SELECT workspace_id, max(id) AS id, arg_max(status, id) AS status FROM ({RUNS}) GROUP BY workspace_id),
 c AS (SELECT s.*, (SELECT count(*) FROM documents_t x WHERE x.workspace_id = s.workspace_id) AS d, (SELECT count(*) FROM entities_t x WHERE x.workspace_id = s.workspace_id) AS e,
  (SELECT count(*) FROM gaps_t x WHERE x.workspace_id = s.workspace_id) AS g, (SELECT count(*) FROM contradictions_t x WHERE x.workspace_id = s.workspace_id) AS k,
  (SELECT count(*) FROM assets_t x WHERE x.workspace_id = s.workspace_id) AS a, CASE status WHEN 'running' THEN 'running' WHEN 'failed' THEN 'blocked' ELSE 'complete' END AS st FROM s)
SELECT workspace_id, 'Document' AS stage, 'complete' AS stage_status, d AS records, d || ' documents ingested; ' || e || ' entities extracted.' AS stage_message FROM c
UNION ALL SELECT workspace_id, 'Graph', st, g, g || ' persisted evidence edges.' FROM c
UNION ALL SELECT workspace_id, 'Compliance', st, g, g || ' generated gaps tied to source evidence.' FROM c
UNION ALL SELECT workspace_id, 'RCA', CASE WHEN status <> 'running' THEN 'ready' ELSE 'not_run' END, k,
  CASE WHEN status <> 'running' THEN k || ' contradictions available for RCA context.' ELSE 'RCA becomes ready after assets and graph evidence exist.' END FROM c""")
def _(t):
    newest = runs(t).groupBy("workspace_id").agg(F.max_by("status", "id").alias("status"))
    counts = {
        "documents_ingested": S.documents(t), "entities_extracted": S.entities(t), "compliance_gaps": S.gaps(t),
        "contradictions": S.contradictions(t), "assets": S.assets(t), "graph_edges": S.gaps(t),
    }
    for name, df in counts.items():
        newest = newest.join(df.groupBy("workspace_id").agg(F.count("*").alias(name)), "workspace_id", "left")
    return store.stage_table(newest.na.fill(0))


# -- table maintenance -----------------------------------------------------------
@query("upsert_assets", "A11", """
SELECT c_custkey AS id, coalesce(n.name, c_name) AS name, coalesce(n.balance, c_acctbal) AS balance FROM customer LEFT JOIN
 (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS name, arg_max(o_totalprice, o_orderkey) AS balance FROM orders GROUP BY o_custkey) n ON o_custkey = c_custkey
UNION ALL SELECT * FROM (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey), arg_max(o_totalprice, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey)""")
def _(t):
    stored = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    incoming = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return store.upsert(stored, incoming, ["id"], "o_orderkey")


@query("insert_if_absent", "A12", """
SELECT DISTINCT l_suppkey AS asset_id, l_partkey AS document_id FROM lineitem WHERE l_returnflag <> 'A'
 AND (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def _(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("asset_id"), F.col("l_partkey").alias("document_id"), "l_returnflag")
    stored = pairs.where(F.col("l_returnflag") == "A").drop("l_returnflag").distinct()
    return store.insert_absent(stored, pairs.where(F.col("l_returnflag") != "A"), ["asset_id", "document_id"])


@query("replace_workspace_rows", "A13", """
SELECT o_orderkey AS id, o_orderpriority AS workspace_id, o_totalprice AS amount FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT o_orderkey, o_orderpriority, -o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'""")
def _(t):
    stored = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("workspace_id"), F.col("o_totalprice").alias("amount"))
    run = stored.where(F.col("workspace_id").isin("1-URGENT", "5-LOW")).select("workspace_id")
    # The rerun of 5-LOW yields no rows at all.
    new = stored.where(F.col("workspace_id") == "1-URGENT").withColumn("amount", -F.col("amount"))
    return store.replace_workspaces(stored, new, run)


@query("delete_cascade", "A14", """
SELECT 'orders' AS table_name, o_orderstatus AS flag, count(*) AS kept FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL
UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def _(t):
    removed = t.orders.where(F.col("o_orderstatus") == "F")
    left = store.delete_cascade(t.orders, removed, {"lineitem": (t.lineitem, {"o_orderkey": "l_orderkey"})}, ["o_orderkey"])
    parents = left["parents"].groupBy(F.col("o_orderstatus").alias("flag")).agg(F.count("*").alias("kept"))
    children = left["lineitem"].groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("kept"))
    return parents.select(F.lit("orders").alias("table_name"), "*").unionByName(children.select(F.lit("lineitem").alias("table_name"), "*"))


@query("append_with_defaults", "A16 B26", """
SELECT event_id AS id, 'C-' || user_id AS asset_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS source_document,
 CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS source_page FROM events""")
def _(t):
    kind = F.col("event_type")
    rows = S.events(t).withColumn("source_document", F.when(F.col("event_type") != "Incident", F.regexp_extract("title", r"\A(\w+)", 1)))
    rows = rows.withColumn("source_page", F.when(kind != "Inspection", 2))
    return store.append_defaults(rows, "timeline_events").select("id", "asset_id", "source_document", "source_page")


@query("unique_stored_names", "B19", """
SELECT doc_id, CASE WHEN r = 1 THEN source || '.txt' ELSE source || '-' || r || '.txt' END AS stored_filename
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)""")
def _(t):
    files = t.documents.select("doc_id", F.concat("source", F.lit(".txt")).alias("filename"))
    return ingest.unique_names(files, [], "doc_id").select("doc_id", "stored_filename")


@query("selection_dedup", "A21", """
SELECT min(event_id) AS event_id, event_type AS name, user_id AS length FROM events GROUP BY event_type, user_id""")
def _(t):
    from evidara.sources.files import select_new

    picked = t.events.select(
        "event_id", F.concat(F.lit("/in/"), "event_type").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        F.col("user_id").alias("length"),
    )
    return select_new(picked, "event_id").select("event_id", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


@query("gap_status_list", "K5 G3", f"""{S.WITH} SELECT id, severity, CASE WHEN evidence <> '' THEN 'accepted' ELSE 'rejected' END AS evidence_status,
 CASE WHEN evidence <> '' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM gaps_t""")
def _(t):
    return R.compliance_list(S.gaps(t)).select("id", "severity", "evidence_status", "confidence")


@query("first_wins_events", "E9 H1", f"{S.WITH} SELECT min(id) AS id FROM events_t GROUP BY workspace_id, asset_id, event_date, lower(event_type)")
def _(t):
    return first_by(S.events(t), ["workspace_id", "asset_id", "event_date", F.lower("event_type")], ["id"]).select("id")
