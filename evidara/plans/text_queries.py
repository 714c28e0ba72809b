"""Scalar text and value rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import values as W
from evidara.functions import vocab as V
from evidara.plans import twin as Q
from evidara.plans.registry import query


@query("clean_text", "B1", f"SELECT doc_id, {Q.squeeze('text')} AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", X.clean_text("text").alias("cleaned"))


@query("normalise_text", "B2", f"SELECT doc_id, {Q.norm('text')} AS normal FROM documents")
def _(t):
    return t.documents.select("doc_id", X.normalise("text").alias("normal"))


@query("compact_text", "B3", f"SELECT doc_id, {Q.compact('text')} AS compact FROM documents")
def _(t):
    return t.documents.select("doc_id", X.compact("text").alias("compact"))


def _tagged(t):
    """Order lines as log sentences: tags, dates and measurements in running text."""
    return t.orders.select(
        "o_orderkey",
        F.concat_ws(
            " ",
            F.concat(F.lit("Wo-"), F.col("o_orderkey").cast("string")),
            F.lit("closed on"),
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.lit("at"),
            F.concat(F.pmod("o_custkey", F.lit(90)).cast("string"), F.lit(".5 mm/s after 12 days on P-")),
            F.col("o_custkey").cast("string"),
        ).alias("line"),
    )


TAGGED = """SELECT o_orderkey, 'Wo-' || o_orderkey || ' closed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' at '
  || (o_custkey % 90) || '.5 mm/s after 12 days on P- ' || o_custkey AS line FROM orders"""


@query("identifier_keys", "B4", f"SELECT o_orderkey, array_to_string(list_sort({Q.ids('line')}), ',') AS identifiers FROM ({TAGGED})")
def _(t):
    return _tagged(t).select("o_orderkey", F.array_join(F.array_sort(X.identifier_keys("line")), ",").alias("identifiers"))


@query("document_identifier_keys", "B4", f"SELECT doc_id, len({Q.ids('text')})::INTEGER AS identifier_count, array_to_string(list_sort({Q.ids('text')}), ',') AS identifiers FROM documents")
def _(t):
    found = X.identifier_keys("text")
    return t.documents.select("doc_id", F.size(found).alias("identifier_count"), F.array_join(F.array_sort(found), ",").alias("identifiers"))


@query("evidence_tokens", "B5", f"SELECT doc_id, array_to_string({Q.evidence_tokens('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.evidence_tokens("text"), " ").alias("tokens"))


@query("search_tokens", "B6", f"SELECT doc_id, array_to_string({Q.tokens('text')}, ' ') AS tokens, array_to_string({Q.query_terms('text')}, ' ') AS terms FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", F.array_join(X.search_tokens("text"), " ").alias("tokens"), F.array_join(X.query_terms("text"), " ").alias("terms")
    )


@query("asset_id_normal_form", "B7", r"""
SELECT p_partkey, CASE WHEN regexp_full_match(upper(tag), '[A-Z0-9][A-Z0-9_.-]{1,79}') THEN upper(tag) ELSE '' END AS asset_id
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '-') || '.' || p_size END AS tag FROM part)""")
def _(t):
    tag = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("."), F.col("p_size").cast("string"))
    )
    return t.part.select("p_partkey", W.asset_id(tag).alias("asset_id"))


@query("allowed_choice", "B8", """
SELECT o_orderkey, CASE substr(o_orderpriority, 3) WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' WHEN 'LOW' THEN 'Low' ELSE '' END AS severity
FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", W.choice(F.substring("o_orderpriority", 3, 20), V.SEVERITIES).alias("severity"))


@query("iso_date_or_null", "B9", """
SELECT o_orderkey, CASE WHEN o_orderkey % 24 = 4 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 24 = 10 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN o_orderkey % 24 = 16 THEN strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') WHEN o_orderkey % 24 = 22 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE CASE o_orderkey % 6
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE NULL END END AS day
FROM orders""")
def _(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind, more = F.col("o_orderkey") % 6, F.col("o_orderkey") % 24
    # Basic form, a zone that would shift the day, the bare week, and week and day.
    thursday = F.date_add(F.date_trunc("week", F.col("o_orderdate")).cast("date"), 3)
    week = F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    raw = (
        F.when(more == 4, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(more == 10, F.concat(day, F.lit("T02:00:00+05:30")))
        .when(more == 16, week)
        .when(more == 22, F.concat(week, F.lit("-"), (F.weekday("o_orderdate") + 1).cast("string")))
        .when(kind == 0, day)
        .when(kind == 1, F.concat(F.lit("  "), day, F.lit("T08:30:00 ")))
        .when(kind == 2, F.concat(day, F.lit(" 08:30:00")))
        .when(kind == 3, F.date_format("o_orderdate", "yyyy-MM"))
        .when(kind == 4, F.lit("null"))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-45")))
    )
    return t.orders.select("o_orderkey", W.iso_date(raw).alias("day"))


@query("entity_value_and_type", "B10 B11", r"""
SELECT p_partkey, kind AS entity_type, CASE WHEN kind IN ('Equipment', 'Work Order') THEN upper(tag) ELSE tag END AS value
FROM (SELECT p_partkey, tag, CASE WHEN raw NOT IN ('Work Order', 'Spare Part') AND regexp_full_match(upper(tag), '[A-Z0-9][A-Z0-9_.-]{1,79}') THEN 'Equipment' ELSE raw END AS kind
  FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '-') END AS tag,
        CASE p_partkey % 3 WHEN 0 THEN 'Work Order' WHEN 1 THEN 'Spare Part' ELSE p_type END AS raw FROM part))""")
def _(t):
    tag = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    kind = F.col("p_partkey") % 3
    raw = F.when(kind == 0, "Work Order").when(kind == 1, "Spare Part").otherwise(F.col("p_type"))
    named = t.part.select("p_partkey", tag.alias("tag"), raw.alias("raw"))
    typed = named.withColumn("entity_type", W.entity_type("raw", "tag"))
    return typed.select("p_partkey", "entity_type", W.entity_value("entity_type", "tag").alias("value"))


@query("confidence_clamp", "B12", """
SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 7 IN (3, 5) THEN 0.0 ELSE least(1.0, greatest(0.0, value / 50.0 - 0.2)) END AS confidence FROM events""")
def _(t):
    number = (F.col("value") / 50.0 - 0.2).cast("string")
    raw = (
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .when(F.col("event_id") % 7 == 3, F.concat(number, F.lit("d")))
        .when(F.col("event_id") % 7 == 5, F.lit("0x1p3"))
        .otherwise(number)
    )
    return t.events.select("event_id", W.confidence(raw).alias("confidence"))


@query("title_from_description", "B13", f"""
SELECT doc_id, CASE WHEN length(c) <= 72 THEN c ELSE rtrim(substr(c, 1, 69)) || '...' END AS title
FROM (SELECT doc_id, {Q.squeeze('text')} AS c FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.title_from_description("text").alias("title"))


@query("citation_snippet", "B14", f"""
SELECT doc_id, CASE WHEN length(c) <= 280 THEN c ELSE rtrim(substr(c, 1, 280)) || '...' END AS snippet
FROM (SELECT doc_id, {Q.squeeze('text')} AS c FROM documents)""")
def _(t):
    return t.documents.select("doc_id", X.citation_snippet("text").alias("snippet"))


@query("source_excerpt", "B15", f"""
SELECT doc_id, CASE WHEN c = '' OR source = '' THEN '' WHEN hit > 0
  THEN trim(substr(c, greatest(hit - 140, 1), hit + length(word) + 140 - greatest(hit - 140, 1))) ELSE trim(substr(c, 1, 280)) END AS excerpt
FROM (SELECT doc_id, source, c, word, instr(lower(c), lower(word)) AS hit
  FROM (SELECT doc_id, source, {Q.squeeze('text')} AS c, CASE WHEN doc_id % 4 = 0 THEN source ELSE 'Tion ' || substr(lang, 1, 1) END AS word FROM documents))""")
def _(t):
    word = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.concat(F.lit("Tion "), F.substring("lang", 1, 1)))
    return t.documents.select("doc_id", X.source_excerpt(word, "text").alias("excerpt"))


@query("term_snippet", "B16", f"""
SELECT doc_id, trim(substr(c, greatest(hit - 80, 1), 260)) AS snippet
FROM (SELECT doc_id, c, coalesce(list_filter([instr(lower(c), 'zz'), instr(lower(c), 'tion'), instr(lower(c), 'the')], lambda p: p > 0)[1], 1) AS hit
  FROM (SELECT doc_id, {Q.squeeze('text')} AS c FROM documents))""")
def _(t):
    terms = F.array(F.lit("zz"), F.lit("tion"), F.lit("The"))
    return t.documents.select("doc_id", X.term_snippet("text", terms).alias("snippet"))


@query("source_filename_keys", "B17", f"""
WITH cited AS (SELECT doc_id, source || '/' || lang || '/Doc ' || doc_id || '.txt' AS path FROM documents),
 named AS (SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM cited)
SELECT doc_id, array_to_string(list_sort(list_distinct([{Q.norm('path')}, {Q.norm('name')}, {Q.norm("regexp_replace(name, '[.][^.]+$', '')")}])), '|') AS keys FROM named""")
def _(t):
    path = F.concat(F.lit("'Source:  "), "source", F.lit("\\"), "lang", F.lit("/Doc "), F.col("doc_id").cast("string"), F.lit(".txt page 3'"))
    keys = X.filename_keys(path)
    return t.documents.select("doc_id", F.array_join(F.array_sort(keys), "|").alias("keys"))


@query("safe_filename", "B18", r"""
SELECT page_id, substr(trim(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '[^\p{L}\p{N} ._()\-]', '', 'g')), 1, 160) AS filename FROM pages""")
def _(t):
    return t.pages.select("page_id", X.safe_filename("url").alias("filename"))


@query("model_text_folding", "B28")
def _(t):
    folded = X.model_text(F.regexp_replace("text", "e", "–e…"))
    return t.documents.select("doc_id", F.length(folded).alias("characters"), F.md5(folded).alias("digest"))


@query("punctuation_folding", "B28", r"""
SELECT doc_id, trim(replace(translate(t, chr(8211) || chr(160) || chr(8217), '- '''), chr(8230), '...')) AS folded
FROM (SELECT doc_id, replace(replace(text, 'on', chr(8211) || chr(160)), 'er', chr(8217) || chr(8230)) AS t FROM documents)""")
def _(t):
    marked = F.replace(F.replace("text", F.lit("on"), F.lit("– ")), F.lit("er"), F.lit("’…"))
    return t.documents.select("doc_id", X.fold_model_text(marked).alias("folded"))


@query("gap_evidence_status", "B29", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '5%' THEN 'accepted' ELSE 'rejected' END AS evidence_status,
 CASE WHEN o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '5%' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM orders""")
def _(t):
    document = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    evidence = F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", *W.gap_evidence(document, evidence))


@query("display_label", "B30", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'P-' || p_size || 'A' WHEN p_partkey % 4 = 1 THEN p_size || '/' || p_partkey
  WHEN p_partkey % 4 = 2 THEN upper(substr(a, 1, 1)) || substr(a, 2) || ' of PDF ' || upper(substr(b, 1, 1)) || substr(b, 2) ELSE p_type END AS label
FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def _(t):
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.lit("p-"), size, F.lit("a")))
        .when(kind == 1, F.concat(size, F.lit(" / "), F.col("p_partkey").cast("string")))
        .when(kind == 2, F.concat_ws("_", F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("Of_pdf"), F.split_part("p_name", F.lit(" "), F.lit(2))))
        .otherwise(F.col("p_type"))
    )
    return t.part.select("p_partkey", X.display_label(raw).alias("label"))


@query("identifier_like_terms", "B31", f"""
SELECT term, count(*)::BIGINT AS uses, regexp_full_match(term, '[a-z]{{1,8}}-\\d+[a-z0-9-]*|\\d+(?:\\.\\d+)?') AS is_identifier
FROM (SELECT unnest({Q.tokens('text')}) AS term FROM documents) GROUP BY term""")
def _(t):
    terms = t.documents.select(F.explode(X.search_tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("uses"))
    return terms.withColumn("is_identifier", X.is_identifier_term("term"))


@query("comparison_by_name", "B32", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN value > 10 WHEN 1 THEN value >= 10 WHEN 2 THEN value < 10 WHEN 3 THEN value <= 10 ELSE abs(value - 10) <= 0.001 END AS outcome FROM events""")
def _(t):
    operator = F.element_at(F.array(*[F.lit(o) for o in (">", ">=", "<", "<=", "==")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", W.compare("value", operator, F.lit(10.0)).alias("outcome"))


@query("guarded_ratio_f1", "B33", f"""
SELECT user_id, p AS precision_value, r AS recall_value, CASE WHEN p + r = 0 THEN 0.0 ELSE {Q.half_even('2 * p * r / (p + r)', 4)} END AS f1_value
FROM (SELECT user_id, {Q.half_even('a / n', 4)} AS p, {Q.half_even('b / (n + 1)', 4)} AS r
  FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (value > 10) AS b FROM events GROUP BY user_id))""")
def _(t):
    counts = t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("value") > 10).alias("b")
    )
    rated = counts.select("user_id", W.ratio("a", "n").alias("precision_value"), W.ratio("b", F.col("n") + 1).alias("recall_value"))
    return rated.withColumn("f1_value", W.f1("precision_value", "recall_value"))


@query("stored_list_defaults", "B34", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN p_name || '|' || p_brand ELSE '' END AS warnings FROM part""")
def _(t):
    kind = F.col("p_partkey") % 4
    raw = (
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.col("p_name"))
        .when(kind == 2, F.to_json(F.array("p_name", "p_brand"))).otherwise("")
    )
    return t.part.select("p_partkey", F.array_join(W.json_list(raw), "|").alias("warnings"))


@query("redaction", "B35", """
SELECT event_id, '[redacted]' AS token, '[redacted]' AS user_key, event_type AS note, props AS payload, '[redacted]' AS inner_token, event_type AS inner_note FROM events""")
def _(t):
    entries = F.create_map(
        F.lit("Token"), F.col("props"), F.lit("my_API_key"), F.col("props"), F.lit("note"), F.col("event_type"), F.lit("tokens"), F.col("props")
    )
    m = F.col("m")
    inner = F.create_map(F.lit("token"), F.col("props"), F.lit("note"), F.col("event_type"))
    rows = t.events.select("event_id", W.redact(entries).alias("m"), F.struct(F.array(inner).alias("parts")).alias("r"))
    nested = W.redact_record("r", rows.schema["r"].dataType)["parts"][0]
    return rows.select(
        "event_id", m["Token"].alias("token"), m["my_API_key"].alias("user_key"), m["note"].alias("note"), m["tokens"].alias("payload"),
        nested["token"].alias("inner_token"), nested["note"].alias("inner_note"),
    )


@query("character_count", "B36", "SELECT doc_id, length(text)::INTEGER AS character_count FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("character_count"))


@query("document_type", "B37", r"""
SELECT page_id, upper(regexp_extract(host, '[.]([^.]+)$', 1)) AS document_type FROM (SELECT page_id, split_part(url, '/', 3) AS host FROM pages)""")
def _(t):
    return t.pages.select("page_id", X.document_type(F.split_part("url", F.lit("/"), F.lit(3))).alias("document_type"))


@query("vector_check", "B39", """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'Embedding vector is invalid.' WHEN vec_id % 5 = 0 THEN 'Embedding dimensions mismatch. Expected 64, got 63.' END AS reject_reason FROM embeddings""")
def _(t):
    vector = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return t.embeddings.select("vec_id", W.vector_reject_reason(vector, 64).alias("reject_reason"))


@query("label_lists", "B27", """
SELECT p_partkey, a || '|' || upper(b) AS unique_items, a || '|' || upper(b) || '|' || a AS all_items
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""")
def _(t):
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    items = F.array(F.concat(F.lit(" "), first), F.upper(second), F.lit("  "), first)
    return t.part.select(
        "p_partkey", F.array_join(X.clean_list(items), "|").alias("unique_items"), F.array_join(X.required_list(items), "|").alias("all_items")
    )


@query("asset_naming", "B25", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PN-' || p_partkey WHEN p_partkey % 3 = 1 THEN 'PN-' || p_partkey || ' ' || p_type ELSE p_name || ' PN-' || p_partkey END AS name FROM part""")
def _(t):
    tag = F.concat(F.lit("PN-"), F.col("p_partkey").cast("string"))
    kind = F.col("p_partkey") % 3
    named = t.part.select(
        "p_partkey", tag.alias("tag"), F.when(kind == 2, F.concat_ws(" ", "p_name", tag)).otherwise("").alias("label"),
        F.when(kind == 1, F.col("p_type")).otherwise("").alias("kind"),
    )
    return named.select("p_partkey", W.asset_name("tag", "label", "kind").alias("name"))


@query("term_matching", "C16", f"""
SELECT doc_id, array_to_string(list_filter(u, lambda x: contains(n, {Q.norm('x')})), '|') AS matched,
  array_to_string(list_filter(u, lambda x: NOT contains(n, {Q.norm('x')})), '|') AS missing
FROM (SELECT doc_id, {Q.norm('text')} AS n, ['The', 'ou of', 'zzz', lang || ' '] AS u FROM documents)""")
def _(t):
    terms = F.array(F.lit("The"), F.lit("ou of"), F.lit(" the "), F.lit("zzz"), F.concat("lang", F.lit(" ")))
    unique = t.documents.withColumn("terms", X.unique_terms(terms))
    return unique.select(
        "doc_id", F.array_join(X.matched_terms("text", "terms"), "|").alias("matched"),
        F.array_join(X.missing_terms("text", "terms"), "|").alias("missing"),
    )


@query("identifier_set_operations", "H4", f"""
SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INTEGER AS missing, len(list_filter(a, lambda x: list_contains(b, x)))::INTEGER AS shared
FROM (SELECT d.doc_id, list_distinct({Q.evidence_tokens('d.text')}) AS a, list_distinct({Q.evidence_tokens('b.text')}) AS b
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)""")
def _(t):
    b = t.benchmark.select(F.col("item_id").alias("k"), F.array_distinct(X.evidence_tokens("text")).alias("b"))
    d = t.documents.select("doc_id", (F.col("doc_id") % 40).alias("k"), F.array_distinct(X.evidence_tokens("text")).alias("a"))
    return d.join(b, "k").select("doc_id", F.size(F.array_except("a", "b")).alias("missing"), F.size(F.array_intersect("a", "b")).alias("shared"))
