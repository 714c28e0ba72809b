"""Payloads, validation and merging over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vocab as V
from evidara.functions.evidence import overlap, page_features, supported
from evidara.operators import merge, validate
from evidara.operators.scorecard import literal_holders
from evidara.plans import standins as S
from evidara.plans import twin as Q
from evidara.plans.registry import query
from evidara.session import settle, stored
from evidara.sources import payloads as P


# -- the evidence predicate -------------------------------------------------------
@query("evidence_supported", "C4", f"""
WITH p AS (SELECT doc_id, {Q.page_columns('text')} FROM documents),
 c AS (SELECT doc_id, b.text AS claim FROM documents JOIN benchmark b ON b.item_id = doc_id % 40)
SELECT c.doc_id, {Q.supported('c.claim')} AS supported FROM c JOIN p USING (doc_id)""")
def _(t):
    return claims(t).select("doc_id", supported("claim").alias("supported"))


def claims(t) -> DataFrame:
    """Every document with the text of a benchmark item as a claim."""
    b = t.benchmark.select(F.col("item_id").alias("k"), F.col("text").alias("claim"))
    return page_features(t.documents.withColumn("k", F.col("doc_id") % 40).join(b, "k"))


@query("claim_token_overlap", "C4", f"""
WITH p AS (SELECT doc_id, {Q.page_columns('text')} FROM documents),
 c AS (SELECT doc_id, {Q.evidence_tokens("b.text")} AS w FROM documents JOIN benchmark b ON b.item_id = doc_id % 40)
SELECT c.doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains(p.tokens, x))) / len(w) END AS overlap FROM c JOIN p USING (doc_id)""")
def _(t):
    b = t.benchmark.select(F.col("item_id").alias("k"), F.col("text").alias("claim"))
    joined = page_features(t.documents.withColumn("k", F.col("doc_id") % 40)).join(b, "k")
    return joined.select("doc_id", overlap("claim").alias("overlap"))


@query("best_evidence_page", "C4 D19", f"""
WITH p AS (SELECT doc_id, lang, {Q.page_columns('text')} FROM documents), b AS (SELECT item_id, text FROM benchmark),
 hit AS (SELECT item_id, doc_id FROM b JOIN p ON contains(p.compact, {Q.compact('b.text')}) OR contains(p.norm, {Q.norm('b.text')}))
SELECT item_id, count(*) AS pages, min(doc_id) AS first_page FROM hit GROUP BY item_id""")
def _(t):
    hits = literal_holders(t.documents, t.benchmark, ["doc_id"], "item_id")
    return hits.groupBy("item_id").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"))


# -- payload recovery -------------------------------------------------------------
@query("payload_recovery", "B20 B21 C10", """
SELECT event_id, CASE event_id % 8 WHEN 5 THEN 'LLM response did not contain valid JSON.' WHEN 6 THEN 'LLM JSON response must be an object.'
  WHEN 7 THEN 'Generated analysis must include an assets array.' WHEN 4 THEN 'Generated analysis must include at least one recognised analysis array.' END AS payload_error,
 CASE WHEN event_id % 8 < 4 THEN 1 ELSE -1 END AS gaps FROM events""")
def _(t):
    gap = F.concat(F.lit('{"compliance_gaps": ['), "props", F.lit("]}"))
    kind = F.col("event_id") % 8
    content = (
        F.when(kind == 0, gap)
        .when(kind == 1, F.concat(F.lit("Here you are: "), gap, F.lit(" - done")))
        .when(kind == 2, F.concat(F.lit('{"result": '), gap, F.lit("}")))
        .when(kind == 3, F.concat(F.lit('```json {"note": 1, "output": '), gap, F.lit("} ```")))
        .when(kind == 4, F.col("props"))
        .when(kind == 5, F.col("event_type"))
        .when(kind == 6, F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.concat(F.lit('{"assets": '), "props", F.lit("}")))
    )
    rows = t.events.select(F.lit("w").alias("workspace_id"), F.col("event_id").alias("batch"), content.alias("content"))
    return P.unwrap(rows).select(
        F.col("batch").alias("event_id"), "payload_error",
        F.when(F.col("payload_error").isNull(), F.coalesce(F.size("compliance_gaps"), F.lit(0))).otherwise(-1).alias("gaps"),
    )


@query("payload_field_aliases", "B22 B24", """
SELECT event_id, CASE event_id % 4 WHEN 3 THEN '' ELSE event_type END AS value,
 CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE 1 END AS page FROM events""")
def _(t):
    kind = F.col("event_id") % 4
    name = F.col("event_type")
    content = (
        F.when(kind == 0, F.concat(F.lit('{"value": "'), name, F.lit('", "source_page": "2"}')))
        .when(kind == 1, F.concat(F.lit('{"value": "", "id": 0, "name": " '), name, F.lit('", "source_page": 0, "page": 3.7}')))
        .when(kind == 2, F.concat(F.lit('{"value": null, "id": "'), name, F.lit('", "source_page": "two"}')))
        .otherwise(F.lit('{"value": false, "page": true}'))
    )
    items = t.events.select("event_id", F.try_parse_json(content).alias("item")).withColumn("fields", P.truthy_fields("item"))
    return items.select("event_id", P.clean_field("value", "id", "name").alias("value"), P.page_number("source_page", "page").alias("page"))


@query("contradiction_evidence_pairs", "B23", """
SELECT event_id, event_type || ' a' AS evidence_a, event_type || ' b' AS evidence_b, 'x.txt' AS document_a, CASE event_id % 3 WHEN 0 THEN 5 ELSE 4 END AS page_b FROM events""")
def _(t):
    kind, name = F.col("event_id") % 3, F.col("event_type")
    content = (
        F.when(kind == 0, F.concat(F.lit('{"evidence": [{"text": "'), name, F.lit(' a", "source": "x.txt", "page": 1}, {"evidence": "'), name, F.lit(' b", "page": 5}]}')))
        .when(kind == 1, F.concat(F.lit('{"evidence_a": "'), name, F.lit(' a", "source_document_a": "x.txt", "evidence_b": "'), name, F.lit(' b", "page_b": 4}')))
        .otherwise(F.concat(F.lit('{"first_evidence": "'), name, F.lit(' a", "first_source_document": "x.txt", "evidence_2": "'), name, F.lit(' b", "source_page_2": "4"}')))
    )
    items = t.events.select("event_id", F.try_parse_json(content).alias("item")).withColumn("fields", P.truthy_fields("item"))
    pairs = P.evidence_pairs(items)
    return pairs.select(
        "event_id", F.col("first.evidence").alias("evidence_a"), F.col("second.evidence").alias("evidence_b"),
        F.col("first.source_document").alias("document_a"), F.col("second.source_page").alias("page_b"),
    )


# -- payloads derived from the documents ---------------------------------------------
PAGES_SQL = f"""SELECT lang AS workspace_id, doc_id, source || '-' || doc_id || '.txt' AS filename, 'P-' || (doc_id % 100) AS tag,
  'Unit P-' || (doc_id % 100) || ' noted on 2024-01-15 by crew. ' || text AS page_text, string_split({Q.squeeze('text')}, ' ') AS w FROM documents"""
PAGE_WITH = f"""WITH raw AS ({PAGES_SQL}), p AS (SELECT raw.*, array_to_string(w[3:5], ' ') AS phrase, array_to_string(w[1:12], ' ') AS head,
  array_to_string(string_split({Q.squeeze('b.text')}, ' ')[1:9], ' ') AS foreign_words, {Q.squeeze('page_text')} AS clean, {Q.page_columns('page_text')}
  FROM raw JOIN benchmark b ON b.item_id = raw.doc_id % 40)"""


def documents_with_tags(t) -> DataFrame:
    """Documents as one-page files whose text opens with an equipment tag and a date."""
    w = F.split(X.squeeze("text"), " ")
    b = t.benchmark.select((F.col("item_id")).alias("k"), F.array_join(F.slice(F.split(X.squeeze("text"), " "), 1, 9), " ").alias("foreign_words"))
    tag = F.concat(F.lit("P-"), (F.col("doc_id") % 100).cast("string"))
    rows = t.documents.select(
        F.col("lang").alias("workspace_id"), "doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        tag.alias("tag"), F.concat(F.lit("Unit "), tag, F.lit(" noted on 2024-01-15 by crew. "), "text").alias("text"),
        F.array_join(F.slice(w, 3, 3), " ").alias("phrase"), F.array_join(F.slice(w, 1, 12), " ").alias("head"), (F.col("doc_id") % 40).alias("k"),
    )
    return rows.join(b, "k").drop("k")


def pages(t) -> DataFrame:
    return documents_with_tags(t).select("workspace_id", "filename", F.lit(1).alias("page"), "text")


def catalogue(t) -> DataFrame:
    return t.documents.select(
        F.col("lang").alias("workspace_id"), F.col("doc_id").alias("id"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
    )


def payloads(t) -> DataFrame:
    """One model answer per document with good, aliased and unsupported records."""
    d = documents_with_tags(t)

    def obj(**fields):
        return F.struct(*[(F.lit(v) if isinstance(v, (str, int, float)) else v).alias(k) for k, v in fields.items()])

    def array(*items):
        return F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(i) for i in items]), F.lit("]"))

    file, tag, stem = F.col("filename"), F.col("tag"), F.regexp_replace("filename", r"\.txt$", "")
    lower_tag = F.lower("tag")
    entities = array(
        obj(entity_type="Failure Mode", value=F.col("phrase"), confidence=0.9, context=F.col("head"), source_document=file, source_page=1),
        obj(type="machine", id=lower_tag, confidence="high", source=F.concat(F.lit("Source: "), stem), page="1"),
        obj(entity_type="Gizmo", value="not a tag", confidence=1.7, source_document=file, source_page=1),
        obj(entity_type="Person", name=F.col("foreign_words"), confidence=0.4, filename=file, page=1),
        obj(entity_type="Location", value=F.col("phrase"), source_document=file, source_page=7),
    )
    risk = F.element_at(F.array(F.lit("HIGH"), F.lit("medium"), F.lit("low"), F.lit("n/a")), (F.col("doc_id") % 4 + 1).cast("int"))
    assets = array(
        obj(id=lower_tag, name=F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Pump "), tag)).otherwise(""), type="Pump", risk_level=risk,
            last_inspection=F.concat(F.lit("2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-15")),
            suggested_actions=F.array(F.lit("Inspect"), F.concat(F.lit("Check "), "workspace_id")), source=file, page=1),
        obj(id="Z-99999", name="Ghost", source=file, page=1),
        obj(id="!", name="Bad", source=file, page=1),
    )
    events = array(
        obj(asset_id=tag, date="2024-01-15", event=F.col("head"), source=file, page=1),
        obj(asset_id=tag, event_date="soon", title="T", description=F.col("head"), source=file, page=1),
        obj(asset_id=tag, event_date="2024-02-01T10:00:00", event_type="Service", title="Foreign", description=F.col("foreign_words"), source=file, page=1),
    )
    gaps = array(
        obj(asset_id=tag, severity=risk, gap=F.concat(F.lit("Gap "), (F.col("doc_id") % 5).cast("string")), evidence=F.col("head"), status=F.when(F.col("doc_id") % 7 == 0, "open").otherwise("closed"), source=file, page=1),
        obj(asset_id=tag, gap_description=F.col("foreign_words"), source=file, page=1),
    )
    conflicts = array(
        obj(asset_id=tag, type="risk conflict", severity=risk,
            evidence=F.array(obj(text=F.col("head"), source=file, page=1), obj(text="noted on 2024-01-15 by crew", source=file, page=1))),
        obj(asset_id=tag, evidence_a=F.col("head"), source_document_a=file, source_page_a=1, evidence_b=F.col("foreign_words"), source_document_b=file, page_b=1),
    )
    content = F.concat(
        F.lit('Answer: {"analysis": {"entities": '), entities, F.lit(', "assets": '), assets, F.lit(', "timeline_events": '), events,
        F.lit(', "compliance_gaps": '), gaps, F.lit(', "contradictions": '), conflicts, F.lit("}}"),
    )
    return d.select("workspace_id", F.col("doc_id").alias("batch"), content.alias("content"))


def checked(t, kind: str) -> DataFrame:
    # Answers are parsed once and page features built once; references and records read them.
    items = P.items(t.once(f"unwrapped {kind}", lambda: settle(P.unwrap(payloads(t)).select("workspace_id", "batch", kind))), kind)
    features = t.once("features", lambda: stored(validate.feature_table(pages(t))))
    return validate.validate(kind, validate.CANDIDATES[kind](items), features, catalogue(t)).withColumn("doc_id", F.col("ord.batch")).withColumn("pos", F.col("ord.pos"))


NO_SOURCE = "'source_reference_not_found'"


@query("validated_entities", "C5 B11 D5 D6", f"""{PAGE_WITH}
SELECT doc_id, 0::BIGINT AS pos, 'Failure Mode' AS entity_type, phrase AS value, 0.9::DOUBLE AS confidence, CASE WHEN phrase = '' THEN 'empty_value' END AS reject_reason FROM p
UNION ALL SELECT doc_id, 1, 'Equipment', tag, 0.0, NULL FROM p
UNION ALL SELECT doc_id, 2, 'Gizmo', 'not a tag', 1.0, 'unsupported_entity_type' FROM p
UNION ALL SELECT doc_id, 3, 'Person', foreign_words, 0.4, CASE WHEN NOT ({Q.supported('p.foreign_words')}) THEN 'entity_value_not_in_source_text' END FROM p
UNION ALL SELECT doc_id, 4, 'Location', phrase, 0.0, {NO_SOURCE} FROM p""")
def _(t):
    return checked(t, "entities").select("doc_id", "pos", "entity_type", "value", "confidence", "reject_reason")


@query("validated_entity_context", "C5 B15", f"""{PAGE_WITH}
SELECT doc_id, 0::BIGINT AS pos, head AS context FROM p WHERE phrase <> ''
UNION ALL SELECT doc_id, 1, trim(substr(clean, 1, 5 + length(tag) + 140)) FROM p""")
def _(t):
    rows = validate.accepted(checked(t, "entities")).where(F.col("pos") < 2)
    return rows.select("doc_id", "pos", "context")


@query("validated_assets", "C6 B25 B26", f"""{PAGE_WITH}
SELECT doc_id, 0::BIGINT AS pos, tag AS asset_id, CASE WHEN doc_id % 3 = 0 THEN 'Pump ' || tag ELSE tag || ' Pump' END AS name, 'Pump' AS asset_type, 'Unknown' AS location,
 (['High', 'Medium', 'Low', 'Unknown'])[doc_id % 4 + 1] AS risk_level, '2024-0' || (doc_id % 9 + 1) || '-15' AS last_inspection, NULL AS reject_reason FROM p
UNION ALL SELECT doc_id, 1, 'Z-99999', 'Z-99999 Ghost', 'Ghost', 'Unknown', 'Unknown', NULL, 'asset_id_not_in_source_text' FROM p
UNION ALL SELECT doc_id, 2, '', 'Bad', 'Bad', 'Unknown', 'Unknown', NULL, 'invalid_asset_id' FROM p""")
def _(t):
    return checked(t, "assets").select("doc_id", "pos", "asset_id", "name", "asset_type", "location", "risk_level", "last_inspection", "reject_reason")


@query("validated_events", "C7 B9 B13", f"""{PAGE_WITH}
SELECT doc_id, 0::BIGINT AS pos, tag AS asset_id, '2024-01-15' AS event_date, 'Other' AS event_type, CASE WHEN length(head) <= 72 THEN head ELSE rtrim(substr(head, 1, 69)) || '...' END AS title, NULL AS reject_reason FROM p
UNION ALL SELECT doc_id, 1, tag, NULL, 'Other', 'T', 'invalid_event_date' FROM p
UNION ALL SELECT doc_id, 2, tag, '2024-02-01', 'Service', 'Foreign', CASE WHEN NOT ({Q.supported('p.foreign_words')}) THEN 'description_not_in_source_text' END FROM p""")
def _(t):
    return checked(t, "timeline_events").select("doc_id", "pos", "asset_id", "event_date", "event_type", "title", "reject_reason")


@query("validated_gaps", "C8 B26", f"""{PAGE_WITH}
SELECT doc_id, 0::BIGINT AS pos, (['High', 'Medium', 'Low', 'Medium'])[doc_id % 4 + 1] AS severity, 'Gap ' || (doc_id % 5) AS gap_type, head AS evidence, CASE WHEN doc_id % 7 = 0 THEN 'Open' ELSE 'Closed' END AS status, NULL AS reject_reason FROM p
UNION ALL SELECT doc_id, 1, 'Medium', CASE WHEN length(foreign_words) <= 72 THEN foreign_words ELSE rtrim(substr(foreign_words, 1, 69)) || '...' END, foreign_words, 'Open',
 CASE WHEN NOT ({Q.supported('p.foreign_words')}) THEN 'evidence_not_in_source_text' END FROM p""")
def _(t):
    return checked(t, "compliance_gaps").select("doc_id", "pos", "severity", "gap_type", "evidence", "status", "reject_reason")


@query("validated_contradictions", "C9 B23", f"""{PAGE_WITH}
SELECT doc_id, 0::BIGINT AS pos, 'Risk Conflict' AS contradiction_type, (['High', 'Medium', 'Low', 'Medium'])[doc_id % 4 + 1] AS severity, NULL AS reject_reason FROM p
UNION ALL SELECT doc_id, 1, 'Unknown', 'Medium', CASE WHEN NOT ({Q.supported('p.foreign_words')}) THEN 'evidence_not_in_source_text' END FROM p""")
def _(t):
    return checked(t, "contradictions").select("doc_id", "pos", "contradiction_type", "severity", "reject_reason")


@query("reject_report", "C10 L13", f"""{PAGE_WITH}, e AS (SELECT workspace_id, {Q.supported('p.foreign_words')} AS ok, phrase = '' AS bare FROM p)
SELECT * FROM (SELECT workspace_id, 'entities' AS kind, 'empty_value' AS reject_reason, count(*) AS records FROM e WHERE bare GROUP BY ALL
UNION ALL SELECT workspace_id, 'entities', 'unsupported_entity_type', count(*) FROM e GROUP BY ALL
UNION ALL SELECT workspace_id, 'entities', 'entity_value_not_in_source_text', count(*) FROM e WHERE NOT ok GROUP BY ALL
UNION ALL SELECT workspace_id, 'entities', {NO_SOURCE}, count(*) FROM e GROUP BY ALL
UNION ALL SELECT workspace_id, 'assets', 'asset_id_not_in_source_text', count(*) FROM e GROUP BY ALL
UNION ALL SELECT workspace_id, 'assets', 'invalid_asset_id', count(*) FROM e GROUP BY ALL
UNION ALL SELECT workspace_id, 'timeline_events', 'invalid_event_date', count(*) FROM e GROUP BY ALL
UNION ALL SELECT workspace_id, 'timeline_events', 'description_not_in_source_text', count(*) FROM e WHERE NOT ok GROUP BY ALL
UNION ALL SELECT workspace_id, 'compliance_gaps', 'evidence_not_in_source_text', count(*) FROM e WHERE NOT ok GROUP BY ALL
UNION ALL SELECT workspace_id, 'contradictions', 'evidence_not_in_source_text', count(*) FROM e WHERE NOT ok GROUP BY ALL)""")
def _(t):
    unwrapped = settle(P.unwrap(payloads(t)).drop("content"))
    features = stored(validate.feature_table(pages(t)))
    kinds = list(validate.CANDIDATES)
    rows = {k: validate.validate(k, validate.CANDIDATES[k](P.items(unwrapped, k)), features, catalogue(t)) for k in kinds}
    return validate.rejects(rows)


@query("exact_page_lookup", "D5", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN source || '-' || doc_id || '.txt' END AS filename, CASE WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN doc_id END AS document_id FROM documents")
def _(t):
    return _lookup(t).select("doc_id", "filename", "document_id")


@query("fuzzy_page_lookup", "D6", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 4 = 1 THEN source || '-' || doc_id || '.txt' END AS filename FROM documents""")
def _(t):
    return _lookup(t).select("doc_id", "filename")


def _lookup(t) -> DataFrame:
    """References by exact name (even), by path and stem (1 of 4) or by a name no page has."""
    name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))
    cited = (
        F.when(F.col("doc_id") % 2 == 0, F.concat(name, F.lit(".txt")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("`Source: C:\\in\\"), F.upper(name), F.lit(".TXT page 1`")))
        .otherwise(F.col("source"))
    )
    refs = t.documents.select(F.col("lang").alias("workspace_id"), "doc_id", cited.alias("ref_filename"), F.lit(1).alias("ref_page"))
    found = validate.resolve_references(refs, catalogue(t).withColumn("page", F.lit(1)), catalogue(t))
    return refs.join(found, ["workspace_id", "ref_filename", "ref_page"], "left")


@query("ambiguous_page_lookup", "D6", "SELECT source, CASE WHEN count(*) = 1 THEN min('/' || source || '/' || lang || '.txt') END AS filename FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def _(t):
    # Pages are named source/lang.txt in one workspace; a reference by the bare stem is
    # ambiguous as soon as two sources hold the language.
    known = t.documents.select(F.lit("w").alias("workspace_id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit(".txt")).alias("filename"), F.lit(1).alias("page")).distinct()
    per_source = known.withColumn("page", F.regexp_extract("filename", r"src(\d+)", 1).cast("int"))
    refs = per_source.select("workspace_id", F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]).alias("k"), F.col("page").alias("ref_page")).distinct()
    names = refs.select("workspace_id", "ref_page", F.explode("k").alias("ref_filename"))
    ids = per_source.select("workspace_id", "filename", F.col("page").alias("id"))
    found = validate.resolve_references(names, per_source, ids)
    unique = found.groupBy("ref_page").agg(F.count("*").alias("n"), F.min("filename").alias("f"))
    return unique.select(F.concat(F.lit("src"), F.col("ref_page").cast("string")).alias("source"), F.when(F.col("n") == 1, F.col("f")).alias("filename"))


# -- merging ----------------------------------------------------------------------
@query("merged_assets", "E7", """
SELECT c_nationkey AS asset_id, coalesce(arg_min(c_name, c_custkey) FILTER (c_custkey % 3 <> 0), max('')) AS name, max(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 3 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END) AS risk_rank,
 max('2024-0' || (1 + c_custkey % 9) || '-15') FILTER (c_custkey % 3 <> 0) AS last_inspection, coalesce(arg_min('src-' || (c_custkey % 50) || '.txt', c_custkey) FILTER (c_custkey % 5 <> 0), '') AS source_document,
 (SELECT string_agg(a, '|' ORDER BY k) FROM (SELECT c_mktsegment AS a, min(c_custkey) AS k FROM customer x WHERE x.c_nationkey = customer.c_nationkey GROUP BY c_mktsegment)) AS actions
FROM customer GROUP BY c_nationkey""")
def _(t):
    rows = asset_records(t)
    merged = merge.merge_assets(rows)
    rank = F.element_at(F.create_map(*[F.lit(x) for p in V.RISK_RANK.items() for x in p]), F.col("risk_level"))
    return merged.select(
        F.col("asset_id").cast("int").alias("asset_id"), "name", rank.alias("risk_rank"), "last_inspection", "source_document",
        F.array_join("suggested_actions", "|").alias("actions"),
    )


def asset_records(t) -> DataFrame:
    """Many customer records per nation, which plays the asset."""
    a, key = S.assets(t), F.col("c_custkey")
    nation = t.customer.select("c_custkey", "c_nationkey")
    return a.drop("workspace_id", "asset_id").join(nation, "c_custkey").select(
        F.lit("w").alias("workspace_id"), F.col("c_nationkey").cast("string").alias("asset_id"), key.alias("ord"),
        F.when(key % 3 == 0, "Unknown").otherwise(F.col("name")).alias("name"), "asset_type", "location", "risk_level", "last_inspection",
        F.array(F.col("asset_type")).alias("suggested_actions"),
        F.when(key % 5 == 0, "").otherwise(F.col("source_document")).alias("source_document"), "source_page", "evidence_text",
    )


@query("merged_gaps", "E8", f"""{S.WITH}, r AS (SELECT *, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS sr,
  CASE status WHEN 'Open' THEN 3 WHEN 'In Progress' THEN 2 WHEN 'Monitoring' THEN 1 ELSE 0 END AS st FROM gaps_t),
 m AS (SELECT workspace_id, asset_id, lower(gap_type) AS k, arg_min(id, (-sr, id)) AS id, min(id) AS place FROM r GROUP BY ALL)
SELECT m.id, any_value(m.place) AS place, any_value(first.severity) AS severity, (['Closed', 'Monitoring', 'In Progress', 'Open'])[max(r.st) + 1] AS status
FROM m JOIN r first ON first.id = m.id JOIN r ON r.workspace_id = m.workspace_id AND r.asset_id = m.asset_id AND lower(r.gap_type) = m.k AND r.id >= m.id GROUP BY m.id""")
def _(t):
    return merge.merge_gaps(S.gaps(t).withColumn("ord", F.col("id"))).select("id", F.col("ord").alias("place"), "severity", "status")


@query("merged_gaps_wide_groups", "E8", f"""{S.WITH}, r AS (SELECT *, CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS sr,
  CASE status WHEN 'Open' THEN 3 WHEN 'In Progress' THEN 2 WHEN 'Monitoring' THEN 1 ELSE 0 END AS st FROM gaps_t),
 m AS (SELECT source_document, source_page, arg_min(id, (-sr, id)) AS id FROM r GROUP BY ALL)
SELECT m.id, any_value(first.severity) AS severity, (['Closed', 'Monitoring', 'In Progress', 'Open'])[max(r.st) + 1] AS status
FROM m JOIN r first ON first.id = m.id JOIN r ON r.source_document = m.source_document AND r.source_page = m.source_page AND r.id >= m.id GROUP BY m.id""")
def _(t):
    return merge.merge_gaps(S.gaps(t).withColumn("ord", F.col("id")), ["source_document", "source_page"]).select("id", "severity", "status")


@query("merged_entities", "E9", f"{S.WITH} SELECT min(id) AS id FROM entities_t GROUP BY workspace_id, document_id, page, entity_type, lower(value)")
def _(t):
    rows = S.entities(t).withColumnRenamed("page", "source_page").withColumn("ord", F.col("id"))
    return merge.merge_entities(rows).select("id")


@query("merged_contradictions", "E9", f"{S.WITH} SELECT min(id) AS id FROM contradictions_t GROUP BY workspace_id, asset_id, source_document_a, severity")
def _(t):
    rows = S.contradictions(t).withColumn("ord", F.col("id")).withColumn("evidence_a", F.col("severity")).withColumn("evidence_b", F.lit("x"))
    return merge.merge_contradictions(rows).select("id")


@query("open_gaps_per_asset", "E10", f"{S.WITH} SELECT a.asset_id, count(g.id) AS open_compliance_gaps FROM assets_t a LEFT JOIN gaps_t g ON g.workspace_id = a.workspace_id AND g.asset_id = a.asset_id AND g.status = 'Open' GROUP BY a.asset_id")
def _(t):
    return merge.open_gap_counts(S.assets(t), S.gaps(t)).select("asset_id", "open_compliance_gaps")


# -- the whole run ------------------------------------------------------------------
def analysis(t) -> dict[str, DataFrame]:
    from evidara.plans.analysis import run_analysis

    chunks = documents_with_tags(t).select("workspace_id", F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), "filename", F.lit(1).alias("page"), "text")
    return run_analysis(payloads(t), chunks, catalogue(t))


RUN_SQL = f"""{PAGE_WITH}, e AS (SELECT workspace_id, doc_id, tag, phrase, head, foreign_words, {Q.supported('p.foreign_words')} AS ok FROM p),
 g AS (SELECT workspace_id, tag, lower('Gap ' || (doc_id % 5)) AS k FROM e UNION SELECT workspace_id, tag, lower(CASE WHEN length(foreign_words) <= 72 THEN foreign_words ELSE rtrim(substr(foreign_words, 1, 69)) || '...' END) FROM e WHERE ok),
 n AS (SELECT workspace_id, doc_id, 'F' || lower(phrase) AS k FROM e WHERE phrase <> '' UNION ALL SELECT workspace_id, doc_id, 'E' FROM e UNION ALL SELECT workspace_id, doc_id, 'P' FROM e WHERE ok)
SELECT workspace_id, 'complete' AS status, count(*) AS documents_ingested, (SELECT count(*) FROM n WHERE n.workspace_id = e.workspace_id) AS entities_extracted,
 count(DISTINCT tag) AS assets, count(*) + count(*) FILTER (ok) AS timeline_events, (SELECT count(*) FROM g WHERE g.workspace_id = e.workspace_id) AS compliance_gaps,
 count(*) + count(*) FILTER (ok) AS contradictions FROM e GROUP BY workspace_id"""


@query("analysis_run", "K7 E11 E14", RUN_SQL)
def _(t):
    return analysis(t)["runs"].drop("message")


@query("analysis_edges", "K7 H2 J3")
def _(t):
    edges = analysis(t)["graph_edges"]
    return edges.groupBy("workspace_id", "relation_type", "validation_status").agg(F.count("*").alias("edges"))
