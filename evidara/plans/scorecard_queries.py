"""Evaluation of checks derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import values as W
from evidara.operators import scorecard as C
from evidara.operators import signals
from evidara.plans import ingest_queries as I
from evidara.plans import twin as Q
from evidara.plans.registry import query

# Every benchmark item is checked against three documents.
PAGES_SQL = "SELECT 'in/' || source || '/' || doc_id || '.txt' AS file, 1 AS page, text, doc_id FROM documents"


def pages(t) -> DataFrame:
    file = F.concat(F.lit("in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select(file.alias("file"), F.lit(1).alias("page"), "text", "doc_id")


EVIDENCE_SQL = f"""SELECT p.doc_id AS check_id, p.file, p.page, p.doc_id % 3 AS k, p.text AS page_text, {Q.norm('p.text')} AS n,
  string_split({Q.squeeze('b.text')}, ' ') AS w, array_to_string(string_split({Q.squeeze('p.text')}, ' ')[2:3], ' ') AS own FROM ({PAGES_SQL}) p JOIN benchmark b ON b.item_id = p.doc_id % 40"""


def evidence(t) -> DataFrame:
    """One check per document: a phrase of its own, and words of a benchmark item."""
    b = t.benchmark.select(F.col("item_id").alias("k"), F.split(X.squeeze("text"), " ").alias("w"))
    own = F.array_join(F.slice(F.split(X.squeeze("text"), " "), 2, 2), " ")
    rows = pages(t).withColumn("own", own).withColumn("k", F.col("doc_id") % 40).join(b, "k")
    return rows.select(F.col("doc_id").alias("check_id"), "file", "page", "own", "w", F.lit(0).alias("evidence_no"))


def held(term: str) -> str:
    return f"contains(n, {Q.norm(term)})"


@query("evidence_match", "D19 C16 B16", f"""
SELECT check_id, regexp_extract(file, '([^/]*)$', 1) AS document, len(list_filter([own, w[1]], lambda x: contains(n, {Q.norm('x')})))::INTEGER AS matched,
  len(list_filter([own, w[1]], lambda x: NOT contains(n, {Q.norm('x')})))::INTEGER AS missing FROM ({EVIDENCE_SQL})""")
def _(t):
    m = C.evidence_match(evidence(t).withColumn("terms", F.array("own", F.col("w")[0])), pages(t))
    return m.select("check_id", "document", F.size("matched_terms").alias("matched"), F.size("missing_terms").alias("missing"))


@query("qa_checks", "L1", f"""
SELECT check_id, {held('own')} AND {held('w[1]')} AS citation_hit, {held('w[1]')} AS answer_hit, {held('own')} AND {held('w[1]')} AS passed FROM ({EVIDENCE_SQL})""")
def _(t):
    checks = evidence(t).select("check_id", "file", "page", F.array(F.col("w")[0]).alias("answer_terms"), F.array("own", F.upper(F.col("w")[0])).alias("contains"))
    return C.qa_checks(checks, pages(t)).select("check_id", "citation_hit", "answer_hit", "passed")


@query("entity_checks", "L5", f"SELECT check_id, {held('own')} AS passed, 'entity=Person:' || own || '; matched=' || CASE WHEN {held('own')} THEN 1 ELSE 0 END || '/1' AS detail FROM ({EVIDENCE_SQL})")
def _(t):
    checks = evidence(t).select("check_id", F.lit("Person").alias("entity_type"), F.col("own").alias("value"), F.array("own").alias("contains"), "file")
    return C.entity_checks(checks, pages(t)).select("check_id", "passed", "detail")


@query("compliance_checks", "L8", f"""SELECT check_id, ({held('own')})::INTEGER + ({held('w[2]')})::INTEGER AS evidence_hits, {held('own')} AND {held('w[2]')} AS passed FROM ({EVIDENCE_SQL})""")
def _(t):
    e = evidence(t)
    first = e.select("check_id", F.lit(0).alias("evidence_no"), "file", "page", F.array("own").alias("terms"))
    second = e.select("check_id", F.lit(1).alias("evidence_no"), "file", "page", F.array(F.col("w")[1]).alias("terms"))
    rows = C.evidence_checks(e.select("check_id"), first.unionByName(second), pages(t))
    return rows.select("check_id", F.col("evidence_hits").cast("int").alias("evidence_hits"), "passed")


@query("contradiction_checks", "L9", f"""SELECT check_id, ({held('w[1]')})::INTEGER + ({held('w[2]')})::INTEGER AS conflicts, {held('own')} AND {held('w[1]')} AND {held('w[2]')} AS passed FROM ({EVIDENCE_SQL})""")
def _(t):
    e = evidence(t)
    rows = e.select("check_id", "evidence_no", "file", "page", F.array("own").alias("terms"))
    checks = e.select("check_id", F.slice("w", 1, 2).alias("conflict_terms"))
    out = C.evidence_checks(checks, rows, pages(t), ["conflict_terms"])
    return out.select("check_id", F.col("matched_conflict_terms").alias("conflicts"), "passed")


@query("rca_checks", "L10", f"""SELECT check_id, {held('own')} AND {held('w[1]')} AND {held('w[3]')} AS passed FROM ({EVIDENCE_SQL})""")
def _(t):
    e = evidence(t)
    rows = e.select("check_id", "evidence_no", "file", "page", F.array("own").alias("terms"))
    checks = e.select("check_id", F.slice("w", 1, 1).alias("cause_terms"), F.slice("w", 3, 1).alias("check_terms"))
    return C.evidence_checks(checks, rows, pages(t), ["cause_terms", "check_terms"]).select("check_id", "passed")


@query("graph_checks", "L11", f"""
SELECT check_id, CASE WHEN c = 0 THEN 'rejected' WHEN conf >= 0.7 THEN 'accepted' ELSE 'weak' END AS validation_status, ({held('own')} OR c = 0) AND CASE WHEN c = 0 THEN false ELSE conf >= 0.7 END AS passed
FROM (SELECT *, check_id % 4 AS c, (check_id % 100) / 100.0 AS conf FROM ({EVIDENCE_SQL}))""")
def _(t):
    e, cited = evidence(t), F.col("check_id") % 4 != 0
    checks = e.select(
        "check_id", F.lit("C-1").alias("source_node"), F.lit("X").alias("target_node"), F.lit("R").alias("relation_type"),
        ((F.col("check_id") % 100) / 100.0).alias("edge_confidence"), F.lit("accepted").alias("expected_status"),
        F.when(cited, F.col("file")).alias("file"), "page", F.array("own").alias("terms"), F.lit("given").alias("evidence_text"),
    )
    return C.graph_checks(checks, pages(t)).select("check_id", "validation_status", "passed")


@query("grounding_checks", "L3 C4", f"""
WITH e AS ({EVIDENCE_SQL}), p AS (SELECT doc_id, {Q.page_columns('text')} FROM documents), c AS (SELECT e.*, array_to_string(w, ' ') AS claim FROM e),
 r AS (SELECT check_id, own, {held('own')} AS own_claim, {held('w[1]')} AND {held('w[2]')} AS t, {Q.supported('c.claim')} AS s, {held('w[1]')} AS ev FROM c JOIN p ON p.doc_id = c.check_id)
SELECT check_id, 2::BIGINT AS claims, own_claim::INTEGER + (t AND ev)::INTEGER AS supported_claims, (own <> '')::INTEGER + s::INTEGER AS faithful_claims, (own_claim::INTEGER + ev::INTEGER) / 2 AS citation_coverage,
 (own_claim::INTEGER + (t AND ev)::INTEGER) / 2 AS answer_claim_f1, ((own <> '')::INTEGER + s::INTEGER) / 2 AS faithfulness_proxy FROM r""")
def _(t):
    e = evidence(t)
    claim_rows = [
        e.select("check_id", F.lit(0).alias("claim_no"), F.lit("Own words: ").alias("x"), F.col("own").alias("claim"), F.array("own", "own").alias("terms")),
        e.select("check_id", F.lit(1).alias("claim_no"), F.lit("").alias("x"), F.array_join("w", " ").alias("claim"), F.slice("w", 1, 2).alias("terms")),
    ]
    facts = [
        e.select("check_id", F.lit(0).alias("claim_no"), "evidence_no", "file", "page", F.array("own").alias("terms")),
        e.select("check_id", F.lit(1).alias("claim_no"), "evidence_no", "file", "page", F.slice("w", 1, 1).alias("terms")),
    ]
    return C.grounding_checks(claim_rows[0].union(claim_rows[1]), facts[0].union(facts[1]), pages(t)).select(
        "check_id", "claims", F.col("supported_claims").cast("int").alias("supported_claims"), F.col("faithful_claims").cast("int").alias("faithful_claims"),
        "citation_coverage", "answer_claim_f1", "faithfulness_proxy",
    )


@query("parser_checks", "L12", f"""SELECT check_id, CASE WHEN {held('own')} THEN 0 ELSE 1 END AS missing_terms, check_id % 6 = 0 AND {held('own')} AS passed FROM ({EVIDENCE_SQL}) WHERE check_id % 6 IN (0, 2)""")
def _(t):
    from evidara.sources.files import parse_files

    files = I.document_files(t).where(F.col("doc_id") % 6 == 0)
    parsed = parse_files(files.drop("text", "lang", "source", "doc_id")).withColumnRenamed("path", "file")
    texts = pages(t).select("file", F.col("text").alias("body"))
    e = evidence(t).where((F.col("check_id") % 6).isin(0, 2)).join(texts, "file")
    checks = e.select("check_id", F.concat(F.lit("/"), "file").alias("file"), F.lit(1).alias("page_count_min"), F.array("own").alias("expected_terms"), F.lit(0).alias("tables_min"), F.lit(0).alias("images_min"))
    out = C.parser_checks(checks, parsed.withColumn("text", F.coalesce("text", F.lit(""))))
    # Checks of files that were never parsed report all their terms as missing.
    return out.select("check_id", F.when(F.col("check_id") % 6 == 0, F.col("missing_terms")).otherwise(F.lit(None)).alias("m"), "passed").join(
        C.evidence_match(evidence(t).withColumn("terms", F.array("own")), pages(t)).select("check_id", F.size("missing_terms").alias("missing_terms")), "check_id"
    ).select("check_id", "missing_terms", "passed")


ABSENT_SQL = f"""SELECT item_id AS check_id, CASE WHEN item_id % 2 = 0 THEN 'zq' || item_id ELSE string_split({Q.squeeze('text')}, ' ')[2] END AS term FROM benchmark"""


def absent_terms(t) -> DataFrame:
    second = F.split(X.squeeze("text"), " ")[1]
    term = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("zq"), F.col("item_id").cast("string"))).otherwise(second)
    return t.benchmark.select(F.col("item_id").alias("check_id"), term.alias("term"))


@query("present_terms", "C16 L4", f"SELECT DISTINCT term FROM ({ABSENT_SQL}) a WHERE EXISTS (SELECT 1 FROM documents d WHERE contains({Q.norm('d.text')}, {Q.norm('a.term')}))")
def _(t):
    return C.present_terms(t.documents, absent_terms(t))


@query("abstention_checks", "L4", f"""
WITH top AS (SELECT query_id AS check_id, score FROM ({I.lexical_sql(I.QUESTIONS_SQL, 1)}))
SELECT a.check_id, NOT EXISTS (SELECT 1 FROM documents d WHERE contains({Q.norm('d.text')}, {Q.norm('a.term')})) AS unsupported_terms_absent,
 NOT EXISTS (SELECT 1 FROM documents d WHERE contains({Q.norm('d.text')}, {Q.norm('a.term')})) AND coalesce(score, 0) <= 150 AS passed FROM ({ABSENT_SQL}) a LEFT JOIN top USING (check_id)""")
def _(t):
    checks = absent_terms(t).select("check_id", F.array("term").alias("absent_terms"), F.lit(150.0).alias("maximum_top_score"))
    top = I.lexical_hits(t, 1).select(F.col("query_id").alias("check_id"), "score")
    return C.abstention_checks(checks, top, t.documents).select("check_id", "unsupported_terms_absent", "passed")


# -- retrieval metrics ------------------------------------------------------------------
METRICS_SQL = f"""
WITH ranked AS MATERIALIZED (SELECT query_id, split_part(chunk_id, '#', 1) AS file, page, rank FROM ({I.lexical_sql(I.QUESTIONS_SQL, 6)})),
 rel AS MATERIALIZED (SELECT DISTINCT q.item_id AS query_id, d.source AS file, d.doc_id AS page FROM benchmark q JOIN (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)) d ON d.doc_id % 40 = q.item_id AND quality = 1
   UNION SELECT query_id, file, page FROM ranked WHERE rank IN (1, 4)),
 marked AS (SELECT r.*, CASE WHEN l.file IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN rel l ON l.query_id = r.query_id AND l.file = r.file AND l.page = r.page),
 run AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) / rank AS p FROM marked),
 per AS (SELECT query_id, count(*) AS ranked, sum(hit) AS hits, sum(p) FILTER (hit = 1) AS psum, count(DISTINCT (file, page)) FILTER (hit = 1) AS found, min(rank) FILTER (hit = 1) AS first, sum(1 / log2(rank + 1)) FILTER (hit = 1) AS dcg FROM run GROUP BY query_id),
 want AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id)
SELECT query_id, round(hits / least(6, ranked), 6) AS precision_at_k, round(psum / hits, 6) AS context_precision, round(found / n, 6) AS context_recall, round(1 / first, 6) AS mrr,
 round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 6)::BIGINT + 1) x(i)), 6) AS ndcg_at_k FROM per JOIN want USING (query_id)"""


def retrieval(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked, references, limits): labelled good documents plus two of the ranked pages per question."""
    ranked = I.lexical_hits(t, 6).select("query_id", F.regexp_extract("chunk_id", r"\A([^#]*)", 1).alias("file"), "page", "rank")
    good = t.documents.join(t.labels.where(F.col("quality") == 1), "doc_id").select((F.col("doc_id") % 40).alias("query_id"), F.col("source").alias("file"), F.col("doc_id").alias("page"))
    references = good.unionByName(ranked.where(F.col("rank").isin(1, 4)).drop("rank")).distinct()
    return ranked, references, t.benchmark.select(F.col("item_id").alias("query_id"), F.lit(6).alias("k"))


@query("retrieval_metrics", "E19 D18 F10", METRICS_SQL)
def _(t):
    m = C.retrieval_metrics(*retrieval(t), rounded=False)
    names = ["precision_at_k", "context_precision", "context_recall", "mrr", "ndcg_at_k"]
    return m.select("query_id", *[F.round(n, 6).alias(n) for n in names])


@query("retrieval_checks", "L2", f"""
SELECT query_id, context_recall >= 0.1 AND context_precision >= 0.5 AND mrr >= 0.5 AND ndcg_at_k >= 0.5 AS passed FROM ({METRICS_SQL})""")
def _(t):
    ranked, references, limits = retrieval(t)
    metrics = C.retrieval_metrics(ranked, references, limits)
    minima = {"context_recall": 0.1, "context_precision": 0.5, "mrr": 0.5, "ndcg_at_k": 0.5}
    checks = limits.select("query_id", *[F.lit(v).alias(f"minimum_{k}") for k, v in minima.items()])
    texts = t.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("page"), "text")
    cited = references.withColumn("terms", F.array().cast("array<string>"))
    return C.retrieval_checks(metrics, checks, cited, texts).select("query_id", "passed")


@query("macro_average", "E20", f"SELECT round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(context_recall), 6) AS context_recall FROM ({METRICS_SQL})")
def _(t):
    m = C.retrieval_metrics(*retrieval(t), rounded=False)
    return m.agg(*[F.round(F.avg(n), 6).alias(n) for n in ("mrr", "ndcg_at_k", "context_recall")])


# -- numeric checks ----------------------------------------------------------------------
@query("numeric_checks", "L6 F7 F8 F9 L7", """
SELECT 'threshold_breach' AS calculation, user_id AS key, count(*) FILTER (value > 20) >= 5 AS passed FROM events GROUP BY user_id
UNION ALL SELECT 'trend_increase', user_id, bool_and(p IS NULL OR p <= value) AND round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 4) >= 1 FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id
UNION ALL SELECT 'date_gap', o_custkey, coalesce(max(d) FILTER (r = 1)::DATE - max(d) FILTER (r = 2)::DATE, 0) >= 60 FROM (SELECT o_custkey, o_orderdate AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 2 GROUP BY o_custkey
UNION ALL SELECT 'stock_minimum', l_partkey, arg_min(l_quantity, k) < 25 AND arg_min(l_returnflag, k) = 'R' FROM (SELECT *, (l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) GROUP BY l_partkey""")
def _(t):
    breach = signals.threshold_breaches(t.events, ["user_id"], "value", 20.0).select(F.lit("threshold_breach").alias("calculation"), F.col("user_id").alias("key"), (F.col("breach_count") >= 5).alias("passed"))
    trend = signals.rising_trends(t.events, ["user_id"], "ts", "value", "event_id").select(F.lit("trend_increase").alias("calculation"), F.col("user_id").alias("key"), (F.col("increasing") & (F.col("trend_delta") >= 1)).alias("passed"))
    days = signals.last_interval(t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day")), ["o_custkey"], "day", ["o_orderkey"])
    gap = days.select(F.lit("date_gap").alias("calculation"), F.col("o_custkey").alias("key"), (F.col("completed_gap_days") >= 60).alias("passed"))
    stock = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("available_qty"), F.lit(25.0).alias("minimum_qty"), F.col("l_returnflag").alias("status"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("k"))
    out = signals.stock_checks(stock, ["part"], "k", "R").select(F.lit("stock_minimum").alias("calculation"), F.col("part").alias("key"), F.col("stockout").alias("passed"))
    return breach.unionByName(trend).unionByName(gap).unionByName(out)


# -- scorecard ---------------------------------------------------------------------------
CATEGORIES = ["qa", "retrieval", "grounding", "abstention", "entity", "numeric", "compliance", "contradiction", "rca", "graph", "graph_validation", "parser"]
RESULTS_SQL = f"""SELECT event_id AS check_id, ([{Q.quoted(CATEGORIES)}])[event_id % 12 + 1] AS category, event_type AS type, value > 5 AS passed, value AS elapsed_ms, (event_id % 97) / 97.0 AS m FROM events"""


def results(t) -> DataFrame:
    """Every event as the outcome of one check."""
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("event_id") % 12 + 1).cast("int"))
    m = (F.col("event_id") % 97) / F.lit(97.0)
    names = sorted({metric for _, metric in C.AVERAGES.values()})
    pairs = [x for n in names for x in (F.lit(n), m)]
    pairs += [F.lit("citation_hit"), F.when(F.col("value") > 8, 1.0).otherwise(0.0), F.lit("answer_hit"), F.when(F.col("value") > 9, 1.0).otherwise(0.0)]
    return t.events.select(
        F.col("event_id").alias("check_id"), category.alias("category"), F.col("event_type").alias("type"), (F.col("value") > 5).alias("passed"),
        F.col("value").alias("elapsed_ms"), F.create_map(*pairs).alias("metrics"), F.concat(F.lit("a|b "), "event_type").alias("detail"), F.col("event_id").alias("ord"),
    )


@query("category_counts", "E22", f"SELECT category, count(*) AS total, count(*) FILTER (passed) AS passed FROM ({RESULTS_SQL}) GROUP BY category")
def _(t):
    return C.category_counts(results(t))


AVERAGE_SQL = ", ".join(f"round(avg(m) FILTER (category = '{c}'), 6) AS {n}" for n, (c, _) in C.AVERAGES.items())
ACCURACY_SQL = ", ".join(f"round(count(*) FILTER (category = '{c}' AND passed) / count(*) FILTER (category = '{c}'), 6) AS {n}" for n, c in C.ACCURACIES.items())
CARD_SQL = f"""SELECT round(count(*) FILTER (passed) / count(*), 6) AS score, round(count(*) FILTER (category = 'qa' AND elapsed_ms > 8) / count(*) FILTER (category = 'qa'), 6) AS citation_hit_rate,
 round(count(*) FILTER (category = 'qa' AND elapsed_ms > 9) / count(*) FILTER (category = 'qa'), 6) AS answer_snippet_hit_rate, {ACCURACY_SQL}, {AVERAGE_SQL},
 1.0::DOUBLE AS entity_precision, count(*) AS benchmark_check_count, count(DISTINCT category) AS benchmark_category_count, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95_check_latency_ms FROM ({RESULTS_SQL})"""


@query("scorecard", "E23 E20 E21", CARD_SQL)
def _(t):
    card = C.scorecard(results(t), rounded=False)
    exact = {"entity_precision", "benchmark_check_count", "benchmark_category_count"}
    return card.select(*[F.col(c) if c in exact else F.round(c, 6).alias(c) for c in card.columns])


GATES = {"minimum_parser_speed": 1.0, "minimum_source_document_count": 10.0, "maximum_parse_runtime_ms": 7000.0, "minimum_score": 0.5, "minimum_retrieval_mrr": 0.6, "maximum_p95_check_latency_ms": 25.0, "minimum_check_count": 71.0, "minimum_category_count": 12.0}


@query("quality_gates", "E24", f"""WITH card AS ({CARD_SQL}) SELECT 'minimum_parser_speed' AS name, 1.0::DOUBLE AS expected, false AS passed UNION ALL SELECT 'minimum_source_document_count', 10.0, (SELECT count(*) FROM documents) >= 10
UNION ALL SELECT 'maximum_parse_runtime_ms', 7000.0, (SELECT sum(value) FROM events WHERE event_type = 'error') <= 7000 UNION ALL SELECT 'minimum_score', 0.5, score >= 0.5 AS passed FROM card UNION ALL SELECT 'minimum_retrieval_mrr', 0.6, retrieval_mrr >= 0.6 FROM card
UNION ALL SELECT 'maximum_p95_check_latency_ms', 25.0, p95_check_latency_ms <= 25 FROM card UNION ALL SELECT 'minimum_check_count', 71.0, benchmark_check_count >= 71 FROM card UNION ALL SELECT 'minimum_category_count', 12.0, benchmark_category_count >= 12 FROM card""")
def _(t):
    gates = t.spark.createDataFrame(list(GATES.items()), "name string, expected double")
    files = pages(t).select("file")
    spent = F.sum(F.when(F.col("event_type") == "error", F.col("value")))
    timings = t.events.agg(F.sum("value").alias("total_runtime_ms"), spent.alias("parse_runtime_ms"))
    card = C.scorecard(results(t), sources=C.coverage(files, files), timings=timings)
    return C.quality_gates(card, gates).select("name", "expected", "passed")


@query("scorecard_lines", "L13", f"""SELECT category, '| `' || check_id || '` | `' || type || '` | ' || CASE WHEN passed THEN 'pass' ELSE 'fail' END || ' | a\\|b ' || type || ' | No evidence |' AS line FROM ({RESULTS_SQL})
UNION ALL SELECT category, unnest(['### ' || upper(substr(category, 1, 1)) || substr(category, 2), '', '- Passed: ' || p || '/' || n, '', '| Check | Type | Status | Detail | Evidence |', '| --- | --- | --- | --- | --- |'])
 FROM (SELECT category, count(*) FILTER (passed) AS p, count(*) AS n FROM ({RESULTS_SQL}) GROUP BY category)""")
def _(t):
    return C.check_lines(results(t).withColumn("evidence_summary", F.lit(None).cast("string"))).select("category", "line")


@query("evidence_summary", "L13", f"""SELECT check_id, regexp_extract(file, '([^/]*)$', 1) || ' p1 (' || CASE WHEN {held('own')} THEN 'matched' ELSE 'missing 1' END || ')' AS evidence_summary FROM ({EVIDENCE_SQL})""")
def _(t):
    m = C.evidence_match(evidence(t).withColumn("terms", F.array("own")), pages(t))
    return C.evidence_summary(m)


@query("source_coverage", "E25", f"""
SELECT {Q.half_even("(SELECT count(DISTINCT doc_id) FROM labels) / ((SELECT count(*) FROM documents) + 0.0)", 4)} AS source_document_coverage, 1.0::DOUBLE AS source_format_coverage, (SELECT count(*) FROM documents) AS source_document_count, 1 AS source_format_count""")
def _(t):
    files = pages(t)
    declared = files.join(t.labels, "doc_id", "left_semi")
    return C.coverage(files.select("file"), declared.select("file"))


@query("guarded_rates", "B33 E20", f"SELECT category, {Q.half_even('p / (n + 0.0)', 4)} AS pass_rate FROM (SELECT category, count(*) FILTER (passed) AS p, count(*) AS n FROM ({RESULTS_SQL}) GROUP BY category)")
def _(t):
    return C.category_counts(results(t)).select("category", W.ratio("passed", "total").alias("pass_rate"))
