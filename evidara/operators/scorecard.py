"""Evaluation as a Spark job over tables of checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import values as W
from evidara.functions.evidence import page_features, supported
from evidara.operators.containment import holders
from evidara.operators.graph import edge_record


# -- evidence ------------------------------------------------------------------
def evidence_match(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """Join (file, page, terms) rows to page text; a missing page leaves all terms missing."""
    text = pages.select("file", "page", F.col("text").alias("page_text"))
    joined = evidence.join(text, ["file", "page"], "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    return joined.withColumns(
        {
            "document": X.base_name("file"),
            "matched_terms": X.matched_terms("page_text", "terms"),
            "missing_terms": X.missing_terms("page_text", "terms"),
            "snippet": X.term_snippet("page_text", "terms"),
        }
    )


def _complete() -> Column:
    return F.size("missing_terms") == 0


def _combined(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evidence of one check or claim: all found, counts, and its page texts in order.

    The list is as long as the evidence a check names, which its author wrote by hand.
    """
    parts = F.array_sort(F.collect_list(F.struct("evidence_no", "page_text")))
    return matched.groupBy(*keys).agg(
        F.bool_and(_complete()).alias("evidence_hit"),
        F.count_if(_complete()).alias("evidence_hits"),
        F.count("*").alias("evidence_count"),
        F.array_join(F.transform(parts, lambda p: p["page_text"]), " ").alias("combined_text"),
    )


def present_terms(texts: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """Distinct terms whose normal form occurs in the normal form of any text."""
    wanted = terms.select("term").distinct().withColumn("_normal", X.normalise("term"))
    # A hit is confirmed in a text, so a shared hash can only make two texts one candidate.
    hay = texts.select(X.normalise(F.coalesce(F.col(text), F.lit(""))).alias("_hay"))
    found = holders(hay.withColumn("_id", F.xxhash64("_hay")), ["_id"], F.col("_hay"), wanted, F.col("_normal"))
    return wanted.join(found.select(F.col("string").alias("_normal")), "_normal", "left_semi").select("term")


def literal_holders(texts: DataFrame, items: DataFrame, keys: Sequence[str], item_key: str) -> DataFrame:
    """(keys, item) for every text that literally holds an item's normal or compact form.

    Where a normal form is held the compact form is held too, so the compact one decides.
    """
    forms = items.select(item_key, X.compact("text").alias("string"))
    return holders(texts, keys, X.compact("text"), forms, F.col("string")).join(forms, "string").select(*keys, item_key)


# -- single checks -------------------------------------------------------------
def qa_checks(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """checks: check_id, file, page, answer_terms, contains."""
    asked = checks.withColumn("terms", X.unique_terms(F.concat("answer_terms", "contains")))
    m = evidence_match(asked, pages)
    hit = F.size(X.matched_terms("page_text", "answer_terms"))
    return m.select(
        "check_id",
        _complete().alias("citation_hit"),
        (hit == F.size("answer_terms")).alias("answer_hit"),
        (_complete() & (hit == F.size("answer_terms"))).alias("passed"),
        F.concat(F.lit("citation_hit="), _flag(_complete()), F.lit("; answer_terms="), hit.cast("string"), F.lit("/"),
                 F.size("answer_terms").cast("string")).alias("detail"),
    )


def _flag(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def retrieval_metrics(ranked: DataFrame, references: DataFrame, limits: DataFrame, rounded: bool = True) -> DataFrame:
    """precision@k, average precision, recall, MRR and nDCG@k per query.

    ranked: query_id, file, page, rank; references: query_id, file, page; limits: query_id, k.
    Two hits on one labelled page both count, so nDCG can exceed 1.
    """
    relevant = references.select("query_id", "file", "page").distinct()
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("_relevant"))
    marked = (
        ranked.join(limits, "query_id")
        .where(F.col("rank") <= F.col("k"))
        .join(relevant.withColumn("_hit", F.lit(1)), ["query_id", "file", "page"], "left")
        .withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    )
    # Running relevance over at most k rows per query.
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.sum("_hit").over(running)
    per_query = (
        marked.withColumn("_precision", F.when(F.col("_hit") == 1, seen / F.col("rank")).otherwise(0.0))
        .groupBy("query_id")
        .agg(
            F.count("*").alias("_ranked"),
            F.sum("_hit").alias("_hits"),
            F.sum("_precision").alias("_precision_sum"),
            F.count_distinct(F.when(F.col("_hit") == 1, F.struct("file", "page"))).alias("_found"),
            F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("_first"),
            F.sum(F.when(F.col("_hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"),
        )
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("_relevant"), F.col("k").cast("bigint"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)
    )
    full = (
        limits.join(per_query, "query_id", "left")
        .join(wanted, "query_id", "left")
        .na.fill(0, ["_ranked", "_hits", "_precision_sum", "_found", "_dcg", "_relevant"])
    )
    digits = 4 if rounded else None

    def part(n: Column | str, d: Column | str) -> Column:
        return F.when(F.col("_relevant") == 0, 0.0).otherwise(W.ratio(n, d, digits))

    return full.select(
        "query_id",
        part("_hits", F.least(F.col("k"), F.col("_ranked"))).alias("precision_at_k"),
        part("_precision_sum", "_hits").alias("context_precision"),
        part("_found", "_relevant").alias("context_recall"),
        F.coalesce(part(F.lit(1.0), "_first"), F.lit(0.0)).alias("mrr"),
        part("_dcg", F.when(F.col("_relevant") > 0, ideal).otherwise(0.0)).alias("ndcg_at_k"),
    )


def retrieval_checks(metrics: DataFrame, checks: DataFrame, references: DataFrame, pages: DataFrame) -> DataFrame:
    """checks: query_id plus minimum_* columns; references carry ``terms`` that must be on their page."""
    # A reference that asks for no term is covered whatever its page says, so its page is not fetched.
    asked = references.where(F.coalesce(F.size("terms"), F.lit(-1)) != 0)
    covered = evidence_match(asked, pages).groupBy("query_id").agg(F.bool_and(_complete()).alias("coverage_hit"))
    joined = metrics.join(checks, "query_id").join(covered, "query_id", "left")
    hit = F.coalesce("coverage_hit", F.lit(True))
    for name in ("context_recall", "context_precision", "mrr", "ndcg_at_k"):
        hit = hit & (F.col(name) >= F.col(f"minimum_{name}"))
    return joined.withColumn("passed", hit)


def grounding_checks(claims: DataFrame, evidence: DataFrame, pages: DataFrame, rounded: bool = True) -> DataFrame:
    """claims: check_id, claim_no, claim, terms; evidence: check_id, claim_no, evidence_no, file, page, terms."""
    keys = ["check_id", "claim_no"]
    per_claim = _combined(evidence_match(evidence, pages), keys)
    joined = claims.join(per_claim, keys, "left").withColumn("combined_text", F.coalesce("combined_text", F.lit("")))
    featured = page_features(joined, text="combined_text")
    missing = X.missing_terms("combined_text", X.unique_terms("terms"))
    by_terms = (F.size(missing) == 0) & F.coalesce("evidence_hit", F.lit(True))
    has_text = (F.trim("combined_text") != "") & (F.coalesce("claim", F.lit("")) != "")
    by_text = F.when(has_text, supported("claim")).otherwise(False)
    digits = 4 if rounded else None
    totals = (
        featured.select("check_id", by_terms.alias("t"), by_text.alias("s"), "evidence_hits", "evidence_count")
        .groupBy("check_id")
        .agg(
            F.count("*").alias("claims"),
            F.count_if("t").alias("supported_claims"),
            F.count_if("s").alias("faithful_claims"),
            F.coalesce(F.sum("evidence_hits"), F.lit(0)).alias("evidence_hits"),
            F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence_count"),
        )
    )
    precision = W.ratio("supported_claims", "claims", digits)
    return totals.select(
        "check_id", "claims", "supported_claims", "faithful_claims",
        precision.alias("answer_claim_precision"),
        precision.alias("answer_claim_recall"),
        (W.f1(precision, precision) if rounded else precision).alias("answer_claim_f1"),
        W.ratio("evidence_hits", "evidence_count", digits).alias("citation_coverage"),
        W.ratio("faithful_claims", "claims", digits).alias("faithfulness_proxy"),
    )


def abstention_checks(checks: DataFrame, top_scores: DataFrame, corpus: DataFrame) -> DataFrame:
    """checks: check_id, absent_terms, maximum_top_score; top_scores: check_id, score.

    Terms must be absent from every document and the best retrieval score must stay low.
    """
    terms = checks.select("check_id", F.explode("absent_terms").alias("term"))
    hits = terms.join(present_terms(corpus, terms), "term", "left_semi").groupBy("check_id").agg(F.count("*").alias("_present"))
    joined = checks.join(hits, "check_id", "left").join(top_scores.select("check_id", "score"), "check_id", "left")
    absent = F.col("_present").isNull()
    score = F.coalesce("score", F.lit(0.0))
    return joined.select(
        "check_id", absent.alias("unsupported_terms_absent"), score.alias("top_retrieval_score"),
        (absent & (score <= F.col("maximum_top_score"))).alias("passed"),
    )


def entity_checks(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """checks: check_id, entity_type, value, contains, file."""
    asked = checks.withColumn("page", F.lit(1)).withColumn("terms", X.unique_terms(F.concat(F.array("value"), "contains")))
    m = evidence_match(asked, pages)
    detail = F.concat(
        F.lit("entity="), "entity_type", F.lit(":"), "value", F.lit("; matched="), F.size("matched_terms").cast("string"),
        F.lit("/"), F.size("terms").cast("string"),
    )
    return m.select("check_id", _complete().alias("passed"), detail.alias("detail"))


def evidence_checks(
    checks: DataFrame, evidence: DataFrame, pages: DataFrame, term_columns: Sequence[str] = ()
) -> DataFrame:
    """Checks that pass when all evidence is found and all term lists occur in the combined text.

    With no term list this is the compliance check, with ``conflict_terms`` the
    contradiction check, with cause and check terms the root-cause check.
    """
    combined = _combined(evidence_match(evidence, pages), ["check_id"])
    joined = checks.join(combined, "check_id", "left").withColumn("combined_text", F.coalesce("combined_text", F.lit("")))
    passed = F.coalesce("evidence_hit", F.lit(True))
    counts = []
    for name in term_columns:
        held = F.size(X.matched_terms("combined_text", name))
        passed = passed & (held == F.size(name))
        counts.append(held.alias(f"matched_{name}"))
    return joined.select(
        "check_id", F.coalesce("evidence_hit", F.lit(True)).alias("evidence_hit"),
        F.coalesce("evidence_hits", F.lit(0)).alias("evidence_hits"), *counts, passed.alias("passed"),
    )


def graph_checks(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """checks: check_id, source_node, target_node, relation_type, edge_confidence, expected_status,
    file, page, terms, evidence_text.  With a file the evidence is its snippet, else ``evidence_text``."""
    m = evidence_match(checks, pages)
    cited = F.col("file").isNotNull()
    document = F.when(cited, F.col("document")).otherwise(F.lit(""))
    evidence = F.when(cited, F.col("snippet")).otherwise(F.coalesce("evidence_text", F.lit("")))
    edge = m.select("*", *edge_record("edge_confidence", document, evidence))
    found = ~cited | _complete()
    return edge.select(
        "check_id", "validation_status", "confidence",
        (found & (F.col("validation_status") == F.col("expected_status"))).alias("passed"),
    )


def parser_checks(checks: DataFrame, parsed: DataFrame) -> DataFrame:
    """checks: check_id, file, page_count_min, expected_terms, tables_min, images_min; parsed keyed by file."""
    joined = checks.join(parsed, "file", "left")
    missing = X.missing_terms("text", "expected_terms")
    enough = (F.coalesce("extracted_tables_count", F.lit(0)) >= F.col("tables_min")) & (
        F.coalesce("extracted_images_count", F.lit(0)) >= F.col("images_min")
    )
    pages_ok = F.coalesce("page_count", F.lit(0)) >= F.col("page_count_min")
    passed = F.col("parser").isNotNull() & F.col("error").isNull() & pages_ok & (F.size(missing) == 0) & enough
    return joined.select("check_id", F.size(missing).alias("missing_terms"), passed.alias("passed"))


# -- scorecard -----------------------------------------------------------------
ACCURACIES = {
    "abstention_accuracy": "abstention",
    "entity_recall": "entity",
    "numeric_reasoning_accuracy": "numeric",
    "compliance_gap_accuracy": "compliance",
    "contradiction_pair_accuracy": "contradiction",
    "rca_evidence_accuracy": "rca",
    "graph_link_completeness": "graph",
    "graph_validation_accuracy": "graph_validation",
    "parser_contract_coverage": "parser",
}
AVERAGES = {
    "retrieval_context_precision": ("retrieval", "context_precision"),
    "retrieval_context_recall": ("retrieval", "context_recall"),
    "retrieval_mrr": ("retrieval", "mrr"),
    "retrieval_ndcg_at_k": ("retrieval", "ndcg_at_k"),
    "grounded_answer_claim_f1": ("grounding", "answer_claim_f1"),
    "grounding_citation_coverage": ("grounding", "citation_coverage"),
    "faithfulness_proxy": ("grounding", "faithfulness_proxy"),
}
QA_RATES = {"citation_hit_rate": "citation_hit", "answer_snippet_hit_rate": "answer_hit"}


SOURCE_METRICS = ["source_document_coverage", "source_format_coverage", "source_document_count", "source_format_count"]
TIME_METRICS = ["total_runtime_ms", "parse_runtime_ms"]


def category_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))


ACCURACY = 10_000


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float, out: str) -> DataFrame:
    """keys, ``out``: the percentile with inclusive interpolation, exact for groups of any size.

    An approximate bracket (its rank error is bounded) comes first; then values below it are
    only counted, and only the distinct values inside are put in order.
    """
    margin = 2 / ACCURACY
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*keys, x.alias("_x"))
    ends = rows.groupBy(*keys).agg(
        F.percentile_approx("_x", F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))), F.lit(ACCURACY)).alias("_ends"),
        F.count("*").alias("_n"),
    )
    # The bracket reaches over both neighbours of the wanted place even in small groups.
    small = F.col("_n") <= ACCURACY
    low = F.when(small, F.lit(float("-inf"))).otherwise(F.col("_ends")[0])
    high = F.when(small, F.lit(float("inf"))).otherwise(F.col("_ends")[1])
    ends = ends.select(*keys, "_n", low.alias("_low"), high.alias("_high"))
    if keys:
        joined = rows.join(ends, list(keys))
    else:
        joined = rows.withColumns({c: ends.select(c).scalar() for c in ("_n", "_low", "_high")})
    held = joined.where(F.col("_x") <= F.col("_high")).withColumn("_v", F.when(F.col("_x") >= F.col("_low"), F.col("_x")))
    counts = held.groupBy(*keys, "_n", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    placed = counts.withColumn("_end", F.sum("_c").over(order))
    place = (F.col("_n") - 1) * F.lit(share)
    at = lambda rank: F.min(F.when(F.col("_end") > rank, F.col("_v")))
    found = placed.groupBy(*keys, "_n").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"))
    part = place - F.floor(place)
    return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias(out))


def scorecard(
    results: DataFrame, rounded: bool = True, sources: DataFrame | None = None, timings: DataFrame | None = None
) -> DataFrame:
    """All metrics in one row.  results: check_id, category, passed, metrics map<string,double>, elapsed_ms.

    ``sources`` is the row of ``coverage``; ``timings`` one row of total_runtime_ms and
    parse_runtime_ms.  Without them their six metrics are left out.
    """
    digits = 4 if rounded else None
    p95 = exact_percentile(results, [], "elapsed_ms", 0.95, "p95").select("p95").scalar()
    p95 = F.coalesce(F.round(p95, 2) if rounded else p95, F.lit(0.0))

    def of(category: str) -> Column:
        return F.col("category") == category

    def rate(hit: Column, group: Column) -> tuple[Column, Column]:
        return F.count_if(group & F.coalesce(hit, F.lit(False))), F.count_if(group)

    counts = {"score": rate(F.col("passed"), F.lit(True))}
    for name, metric in QA_RATES.items():
        counts[name] = rate(F.try_element_at("metrics", F.lit(metric)) > 0, of("qa"))
    for name, category in ACCURACIES.items():
        counts[name] = rate(F.col("passed"), of(category))
    pieces = []
    for name, (n, d) in counts.items():
        pieces += [n.alias(f"{name}_n"), d.alias(f"{name}_d")]
    for name, (category, metric) in AVERAGES.items():
        pieces.append(F.avg(F.when(of(category), F.try_element_at("metrics", F.lit(metric)))).alias(name))
    wide = results.agg(
        *pieces,
        F.count("*").alias("benchmark_check_count"),
        F.count_distinct("category").alias("benchmark_category_count"),
    )
    more = {}
    for frame, names in ((sources, SOURCE_METRICS), (timings, TIME_METRICS)):
        if frame is not None:
            more |= {name: frame.select(name).scalar() for name in names}
    averages = [
        (W.half_even(F.coalesce(name, F.lit(0.0)), 4) if rounded else F.coalesce(name, F.lit(0.0))).alias(name) for name in AVERAGES
    ]
    return wide.select(
        *[W.ratio(f"{name}_n", f"{name}_d", digits).alias(name) for name in counts],
        *averages,
        F.when(F.col("entity_recall_n") > 0, 1.0).otherwise(0.0).alias("entity_precision"),
        "benchmark_check_count", "benchmark_category_count", p95.alias("p95_check_latency_ms"),
        *[value.alias(name) for name, value in more.items()],
    )


def quality_gates(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """gates: name (minimum_* or maximum_*), expected.  Only configured gates are judged.

    A gate whose metric is not there has no actual value and fails.
    """
    names = {"minimum_category_count": "benchmark_category_count", "minimum_check_count": "benchmark_check_count"}
    columns = [c for c in metrics.columns]
    long = metrics.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("actual")) for c in columns]))
    )
    metric = F.coalesce(W.lookup("name", names, None), F.regexp_replace("name", r"\A(minimum|maximum)_", ""))
    joined = gates.withColumn("metric", metric).join(long, "metric", "left")
    passed = F.when(F.col("name").startswith("minimum_"), F.col("actual") >= F.col("expected")).otherwise(
        F.col("actual") <= F.col("expected")
    )
    return joined.select("name", "expected", "actual", F.coalesce(passed, F.lit(False)).alias("passed"))


def coverage(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Share of available files, and of available formats, that the checks declare."""
    present = files.select("file").distinct()
    found = present.join(declared.select("file").distinct(), "file", "left_semi")
    formats = files.select(X.file_suffix(X.base_name("file")).alias("format")).distinct()
    known = declared.select(X.file_suffix(X.base_name("file")).alias("format")).distinct()
    n = {
        "_a": present.agg(F.count("*")).scalar(),
        "_b": found.agg(F.count("*")).scalar(),
        "_c": formats.agg(F.count("*")).scalar(),
        "_d": formats.join(known, "format", "left_semi").agg(F.count("*")).scalar(),
    }
    one = files.sparkSession.range(1).select(*[v.alias(k) for k, v in n.items()])
    return one.select(
        W.ratio("_b", "_a").alias("source_document_coverage"),
        W.ratio("_d", "_c").alias("source_format_coverage"),
        F.col("_a").alias("source_document_count"),
        F.col("_c").alias("source_format_count"),
    )


def percent(c: Column | str) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.concat(F.round(value * 100, 1).cast("string"), F.lit("%"))


COUNT_GATES = ["minimum_source_document_count", "minimum_source_format_count", "minimum_category_count", "minimum_check_count"]


def gate_lines(gates: DataFrame) -> DataFrame:
    def shown(c: str) -> Column:
        return (
            F.when(F.col("name").isin(COUNT_GATES), F.round(c).cast("bigint").cast("string"))
            .when(F.col("name").endswith("_ms"), F.concat(F.round(c, 2).cast("string"), F.lit(" ms")))
            .otherwise(percent(c))
        )

    status = F.when(F.col("passed"), "pass").otherwise("fail")
    line = F.concat(F.lit("| `"), "name", F.lit("` | "), shown("expected"), F.lit(" | "), shown("actual"), F.lit(" | "), status, F.lit(" |"))
    return gates.select("name", line.alias("line"))


def check_lines(results: DataFrame) -> DataFrame:
    """Category headings and one table row per check, as ordered lines.

    results: check_id, category, type, passed, detail, evidence_summary, ord.
    """
    cell = F.replace(F.coalesce("detail", F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(
        F.lit("| `"), "check_id", F.lit("` | `"), "type", F.lit("` | "), F.when(F.col("passed"), "pass").otherwise("fail"),
        F.lit(" | "), cell, F.lit(" | "), F.coalesce("evidence_summary", F.lit("No evidence")), F.lit(" |"),
    )
    heads = category_counts(results).select(
        "category", F.lit(-1).cast("bigint").alias("ord"),
        F.posexplode(
            F.array(
                F.concat(F.lit("### "), F.initcap("category")), F.lit(""),
                F.concat(F.lit("- Passed: "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string")), F.lit(""),
                F.lit("| Check | Type | Status | Detail | Evidence |"), F.lit("| --- | --- | --- | --- | --- |"),
            )
        ).alias("line_no", "line"),
    )
    rows = results.select("category", F.col("ord").cast("bigint").alias("ord"), F.lit(0).alias("line_no"), row.alias("line"))
    return heads.unionByName(rows)


def evidence_summary(matched: DataFrame) -> DataFrame:
    """``file pN (matched)`` of the first two evidence items per check, and how many more there are."""
    top = matched.groupBy("check_id").agg(
        F.count("*").alias("n"),
        F.slice(F.array_sort(F.collect_list(F.struct("evidence_no", "document", "page", F.size("missing_terms").alias("missing")))), 1, 2).alias("first"),
    )
    item = lambda e: F.concat(
        e["document"], F.lit(" p"), e["page"].cast("string"), F.lit(" ("),
        F.when(e["missing"] == 0, "matched").otherwise(F.concat(F.lit("missing "), e["missing"].cast("string"))), F.lit(")"),
    )
    more = F.when(F.col("n") > 2, F.array(F.concat(F.lit("+"), (F.col("n") - 2).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.transform("first", item), more), "<br>")
    return top.select("check_id", F.replace(text, F.lit("|"), F.lit("\\|")).alias("evidence_summary"))
