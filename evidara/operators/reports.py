"""Evidence products: question bundles, asset details, risk summaries, Markdown packs.

Nested API answers become flat tables keyed by (query or asset, section, rank): any list
in them may be long, so nothing is gathered into one row unless its size is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import values as W
from evidara.functions import vocab as V
from evidara.functions.ordering import top_rows
from evidara.operators import graph as G


# -- retrieval products --------------------------------------------------------
def citations(matches: DataFrame, k: int = V.TOP_CITATIONS) -> DataFrame:
    """First k matches per query that name a file and page, with a snippet."""
    first = matches.where(F.col("rank") <= k)
    named = first.where((F.coalesce("filename", F.lit("")) != "") & F.col("page").isNotNull())
    return named.select("query_id", "rank", F.col("filename").alias("document"), "page", X.citation_snippet("text").alias("snippet"))


def answer_confidence(matches: DataFrame) -> DataFrame:
    best = F.least(F.lit(V.ANSWER_CONFIDENCE_CAP), F.max("score"))
    return matches.groupBy("query_id").agg(W.half_even(best, 2).alias("confidence"))


def context_text(matches: DataFrame) -> DataFrame:
    """``file page n:`` blocks of the matches in rank order (at most k per query)."""
    block = F.concat("filename", F.lit(" page "), F.col("page").cast("string"), F.lit(":\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return matches.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context_text"))


def cited_documents(citation_rows: DataFrame) -> DataFrame:
    """Sorted distinct documents per query (at most k)."""
    return citation_rows.groupBy("query_id").agg(F.array_sort(F.collect_set("document")).alias("cited_documents"))


def mentioned_assets(questions: DataFrame, matches: DataFrame, assets: DataFrame, k: int = V.TOP_PATHS) -> DataFrame:
    """First k asset ids named in the question, or in the text or file name of a match."""
    asked = questions.select("workspace_id", "query_id", F.lit(0).alias("part"), F.col("query").alias("hay"))
    seen = matches.select("workspace_id", "query_id", F.col("rank").alias("part"), F.concat_ws(" ", "text", "filename").alias("hay"))
    texts = asked.unionByName(seen)
    pairs = G.mention_pairs(texts, assets, ["workspace_id", "query_id", "part"], F.col("hay"))
    return top_rows(pairs.select("workspace_id", "query_id", "asset_id").distinct(), ["workspace_id", "query_id"], [F.col("asset_id")], k)


def question_bundle(
    questions: DataFrame, matches: DataFrame, entities: DataFrame, assets: DataFrame, edge_rows: DataFrame
) -> DataFrame:
    """One flat table (query_id, section, rank, label, detail, score) for all questions.

    A question without any match gets a ``status`` row instead.
    """
    from evidara.operators.lookups import related_values

    cited = citations(matches)
    mentioned = mentioned_assets(questions, matches, assets)
    top = G.path_edges(edge_rows, mentioned.select("workspace_id", "asset_id").distinct())
    shown = mentioned.withColumnRenamed("rank", "_path").join(top, ["workspace_id", "asset_id"])
    unmatched = questions.join(matches.select("query_id").distinct(), "query_id", "left_anti")
    parts = [
        _section("citation", cited, F.col("rank"), F.col("document"), F.col("snippet"), F.col("page").cast("double")),
        _section("confidence", answer_confidence(matches), F.lit(1), F.lit("confidence"), F.lit(""), F.col("confidence")),
        _section("related_entity", related_values(entities, matches), F.col("rank"), F.col("value"), F.lit(""), F.lit(None)),
        _section("path_edge", shown, F.col("_path") * 100 + F.col("rank"), F.col("asset_id"),
                 F.concat_ws(" -> ", "source_id", "label", "target_id"), F.col("confidence")),
        _section("status", unmatched, F.lit(1), F.lit("no_match"),
                 F.lit("No uploaded evidence matched this question. Upload relevant documents first."), F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _section(name: str, df: DataFrame, rank: Column, label: Column, detail: Column, score: Column, key: str = "query_id") -> DataFrame:
    return df.select(
        key,
        F.lit(name).alias("section"),
        rank.cast("bigint").alias("rank"),
        label.cast("string").alias("label"),
        detail.cast("string").alias("detail"),
        score.cast("double").alias("score"),
    )


def rca_query(asset: Column | str, symptom: Column | str) -> Column:
    return F.concat(F.lit("Root cause analysis for "), F.upper(X.col(asset)), F.lit(": "), X.col(symptom))


def rca_items(payloads: DataFrame, citation_rows: DataFrame) -> DataFrame:
    """Model lists of a root-cause payload, each item with the first two citations.

    ``payloads``: query_id, content.  A missing or empty list is reported as an error row.
    """
    from evidara.sources.payloads import recover

    fields = ("likely_causes", "recommended_checks", "preventive_actions")
    body = payloads.withColumn("_v", recover("content"))
    lists = [
        F.struct(
            F.lit(name).alias("section"),
            X.required_list(F.try_variant_get("_v", f"$.{name}", "array<string>")).alias("items"),
        )
        for name in fields
    ]
    per_list = body.select("query_id", F.inline(F.array(*lists)))
    good = per_list.where(F.col("items").isNotNull()).select("query_id", "section", F.posexplode("items").alias("pos", "text"))
    bad = per_list.where(F.col("items").isNull()).select(
        "query_id", F.col("section"), F.lit(-1).alias("pos"), F.concat(F.lit("LLM RCA response returned no "), "section", F.lit(".")).alias("text")
    )
    first_two = citation_rows.where(F.col("rank") <= V.ITEM_CITATIONS).select(
        "query_id", F.col("rank").alias("citation"), "document", "page", "snippet"
    )
    return good.unionByName(bad).join(first_two, "query_id", "left")


# -- asset products ------------------------------------------------------------
def asset_detail(assets: DataFrame, links: DataFrame, documents: DataFrame, events: DataFrame) -> DataFrame:
    """(workspace, asset, section, sort keys, label, detail): header, documents, timeline."""
    docs = links.join(
        documents.select("workspace_id", F.col("id").alias("document_id"), "filename", "document_type"),
        ["workspace_id", "document_id"],
    )
    parts = [
        _asset_section("asset", assets, F.lit(""), F.lit(0), F.col("name"), F.concat_ws(" | ", "asset_type", "location", "risk_level")),
        _asset_section("document", docs, F.col("filename"), F.col("document_id"), F.col("filename"), F.col("document_type")),
        _asset_section("event", events, F.col("event_date"), F.col("id"), F.col("title"), F.col("event_type")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _asset_section(name: str, df: DataFrame, at: Column, tie: Column, label: Column, detail: Column) -> DataFrame:
    return df.select(
        "workspace_id", "asset_id", F.lit(name).alias("section"), at.cast("string").alias("sort_key"),
        tie.cast("bigint").alias("sort_id"), label.cast("string").alias("label"), detail.cast("string").alias("detail"),
    )


def failure_patterns(entities: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct failure modes whose context names the asset (case-sensitive)."""
    failures = entities.where(F.col("entity_type") == "Failure Mode")
    pairs = G.mention_pairs(failures, assets, ["workspace_id", "id"], F.col("context"), fold=False)
    return failures.join(pairs, ["workspace_id", "id"]).select("workspace_id", "asset_id", "value").distinct()


def gaps_with_status(gaps: DataFrame) -> DataFrame:
    return gaps.select("*", *W.gap_evidence("source_document", "evidence"))


def compliance_list(gaps: DataFrame) -> DataFrame:
    return gaps_with_status(gaps).orderBy(W.severity_order("severity"), F.desc("id"))


def risk_summary(
    assets: DataFrame, gaps: DataFrame, entities: DataFrame, events: DataFrame, contradictions: DataFrame, edge_rows: DataFrame
) -> DataFrame:
    """Sections per asset: gaps, failure patterns, history, actions with evidence, path edges, contradictions."""
    actions = assets.select(
        "workspace_id", "asset_id", "source_document", "source_page", "evidence_text",
        F.posexplode("suggested_actions").alias("pos", "action"),
    )
    path = G.path_edges(edge_rows, assets)
    parts = [
        _asset_section("risk", assets, F.lit(""), F.lit(0), F.col("risk_level"), F.coalesce("last_inspection", F.lit(""))),
        _asset_section("gap", gaps_with_status(gaps), F.lit(""), -F.col("id"), F.col("gap_type"), F.col("evidence_status")),
        _asset_section("failure_pattern", failure_patterns(entities, assets), F.col("value"), F.lit(0), F.col("value"), F.lit("")),
        _asset_section("event", events, F.col("event_date"), F.col("id"), F.col("title"), F.col("event_type")),
        _asset_section("action", actions, F.lit(""), F.col("pos"), F.col("action"),
                       F.concat_ws(" | ", "source_document", F.col("source_page").cast("string"), "evidence_text")),
        _asset_section("path_edge", path, F.lit(""), F.col("rank"), F.concat_ws(" -> ", "source_id", "label", "target_id"), F.col("validation_status")),
        _asset_section("contradiction", contradictions, W.severity_order("severity"), -F.col("id"), F.col("contradiction_type"), F.col("description")),
    ]
    return reduce(DataFrame.unionByName, parts)


def document_detail(documents: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(workspace, document, section, sort keys, label): document, chunks, entities."""
    def part(name: str, df: DataFrame, document: Column, sort_text: Column, sort_id: Column, label: Column) -> DataFrame:
        return df.select(
            "workspace_id", document.alias("document_id"), F.lit(name).alias("section"),
            sort_text.cast("string").alias("sort_key"), sort_id.cast("bigint").alias("sort_id"), label.alias("label"),
        )

    known = documents.select("workspace_id", F.col("id").alias("document_id"))
    keys = ["workspace_id", "document_id"]
    own_chunks, own_entities = chunks.join(known, keys, "left_semi"), entities.join(known, keys, "left_semi")
    return reduce(
        DataFrame.unionByName,
        [
            part("document", documents, F.col("id"), F.lit(""), F.lit(0), F.col("filename")),
            part("chunk", own_chunks, F.col("document_id"), F.lit(""), F.col("chunk_index"), F.col("text")),
            part("entity", own_entities, F.col("document_id"), F.concat_ws("\t", "entity_type", "value"), F.col("id"), F.col("value")),
        ],
    )


# -- Markdown packs as ordered lines ---------------------------------------------
def _line(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _shown(c: str, default: str = "Not available") -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default))


def gap_lines(status: Column | None = None) -> Column:
    """The Markdown lines of one gap as an array."""
    source = _line("- Source: ", _shown("source_document"), ", page ", F.coalesce(F.nullif("source_page", F.lit(0)), F.lit(1)).cast("string"))
    return F.array(
        _line("### ", F.col("asset_id"), " | ", F.col("gap_type")),
        F.lit(""),
        _line("- Severity: ", F.col("severity")),
        _line("- Status: ", F.col("status")),
        _line("- Description: ", F.col("description")),
        _line("- Evidence: ", F.col("evidence")),
        source,
        _line("- Evidence status: ", status if status is not None else F.lit("accepted")),
        _line("- Corrective action: ", F.col("corrective_action")),
        F.lit(""),
    )


def contradiction_lines() -> Column:
    def cited(side: str) -> Column:
        return _line(f"- Source {side.upper()}: ", F.col(f"source_document_{side}"), ", page ", F.col(f"source_page_{side}").cast("string"))

    return F.array(
        _line("### ", F.col("asset_id"), " | ", F.col("contradiction_type")),
        F.lit(""),
        _line("- Severity: ", F.col("severity")),
        _line("- Status: ", F.col("status")),
        _line("- Description: ", F.col("description")),
        _line("- Evidence A: ", F.col("evidence_a")),
        cited("a"),
        _line("- Evidence B: ", F.col("evidence_b")),
        cited("b"),
        F.lit(""),
    )


def compliance_pack(gaps: DataFrame, title: str = "Compliance Evidence Pack", generated: str = "") -> DataFrame:
    """(workspace, section, sort keys, line_no, line).  Gaps sort by severity text, as the report does."""
    counts = gaps.groupBy("workspace_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "Open").alias("o"), F.count_if(F.col("severity") == "High").alias("h")
    )
    head = F.array(
        F.lit(f"# {title}"), F.lit(""), F.lit(f"Generated: {generated}"), F.lit(""), F.lit("## Summary"), F.lit(""),
        _line("- Total gaps: ", F.col("n").cast("string")),
        _line("- Open gaps: ", F.col("o").cast("string")),
        _line("- High severity gaps: ", F.col("h").cast("string")),
        F.lit(""), F.lit("## Findings"), F.lit(""),
    )
    first = counts.select(
        "workspace_id", F.lit(0).alias("section"), F.lit("").alias("severity"), F.lit("").alias("asset_id"),
        F.lit(0).cast("bigint").alias("id"), F.posexplode(head).alias("line_no", "line"),
    )
    rest = gaps.select(
        "workspace_id", F.lit(1).alias("section"), "severity", "asset_id", F.col("id").cast("bigint").alias("id"),
        F.posexplode(gap_lines()).alias("line_no", "line"),
    )
    return first.unionByName(rest)


def asset_pack(
    assets: DataFrame, gaps: DataFrame, events: DataFrame, links: DataFrame, documents: DataFrame,
    contradictions: DataFrame, edge_rows: DataFrame, generated: str = "",
) -> DataFrame:
    """(workspace, asset, section, sort_key, sort_id, line_no, line) for all assets at once.

    Sorting by these columns gives the Markdown text of each asset.  Empty sections get
    their placeholder from an anti join.
    """
    keys = ["workspace_id", "asset_id"]

    def rows(df: DataFrame, section: int, lines: Column, key: Column | None = None, tie: Column | None = None) -> DataFrame:
        return df.select(
            *keys, F.lit(section).alias("section"),
            (key if key is not None else F.lit("")).cast("string").alias("sort_key"),
            (tie if tie is not None else F.lit(0)).cast("bigint").alias("sort_id"),
            F.posexplode(lines).alias("line_no", "line"),
        )

    def heading(section: int, title: str) -> DataFrame:
        lines = [F.lit(""), F.lit(title), F.lit("")]
        return rows(assets, section, F.array(*lines), F.lit(""), F.lit(-(2**62)))

    def placeholder(section: int, present: DataFrame, text: str) -> DataFrame:
        return rows(assets.join(present.select(*keys).distinct(), keys, "left_anti"), section, F.array(F.lit(text)))

    page = F.coalesce(F.nullif("source_page", F.lit(0)), F.lit(1)).cast("string")
    head = F.array(
        _line("# Asset Evidence Pack: ", F.col("asset_id")), F.lit(""), F.lit(f"Generated: {generated}"), F.lit(""),
        F.lit("## Asset"), F.lit(""),
        _line("- Name: ", F.col("name")), _line("- Type: ", F.col("asset_type")), _line("- Location: ", F.col("location")),
        _line("- Risk level: ", F.col("risk_level")), _line("- Last inspection: ", _shown("last_inspection")),
        _line("- Source: ", _shown("source_document"), ", page ", page), _line("- Evidence: ", _shown("evidence_text")),
    )
    actions = assets.select(*keys, F.posexplode("suggested_actions").alias("pos", "action"))
    docs = links.join(
        documents.select("workspace_id", F.col("id").alias("document_id"), "filename", "document_type"), ["workspace_id", "document_id"]
    )
    path = G.path_edges(edge_rows, assets)
    path_head = F.array(
        _line("### ", F.col("asset_id"), " linked evidence path"), F.lit(""),
        _line(F.col("asset_id"), " connects generated asset intelligence to extracted evidence, events, gaps, contradictions, and source documents."),
        F.lit(""),
    )
    edge_lines = F.filter(
        F.array(
            _line("- ", F.col("source_id"), " -> ", F.col("label"), " -> ", F.col("target_id"), " (", F.col("validation_status"),
                  ", confidence ", F.col("confidence").cast("string"), ")"),
            F.when(F.col("source_document") != "", _line("  Source: ", F.col("source_document"), ", page ", page)),
            F.when(F.col("evidence_text") != "", _line("  Evidence: ", F.col("evidence_text"))),
        ),
        lambda x: x.isNotNull(),
    )
    def numbered(lines: Column, tie: Column) -> Column:
        return F.transform(lines, lambda line, i: F.struct(tie.cast("bigint").alias("sort_id"), i.alias("line_no"), line.alias("line")))

    # The heading comes with the first edge, so paths are read once.
    path_lines = F.when(F.col("rank") == 1, F.concat(numbered(path_head, F.lit(-1)), numbered(edge_lines, F.col("rank"))))
    path_rows = path.select(*keys, F.lit(6).alias("section"), F.lit("").alias("sort_key"), F.inline(path_lines.otherwise(numbered(edge_lines, F.col("rank")))))
    newest_first = F.translate(F.col("event_date"), "0123456789", "9876543210")
    parts = [
        rows(assets, 0, head),
        heading(1, "## Suggested Actions"),
        rows(actions, 1, F.array(_line("- ", F.col("action"))), F.lit(""), F.col("pos")),
        placeholder(1, actions, "- No generated action."),
        heading(2, "## Compliance Gaps"),
        rows(gaps, 2, gap_lines(), F.col("severity"), F.col("id")),
        placeholder(2, gaps, "- No compliance gaps linked to this asset."),
        heading(3, "## Timeline"),
        rows(events, 3, F.array(_line("- ", F.col("event_date"), " | ", F.col("event_type"), " | ", F.col("title"), " | ", F.col("source_document"))),
             newest_first, F.col("id")),
        placeholder(3, events, "- No generated timeline events."),
        heading(4, "## Linked Documents"),
        rows(docs, 4, F.array(_line("- ", F.col("filename"), " (", F.col("document_type"), ")")), F.col("filename"), F.col("document_id")),
        placeholder(4, docs, "- No linked documents."),
        heading(5, "## Contradictions"),
        rows(contradictions, 5, contradiction_lines(), W.severity_order("severity"), -F.col("id")),
        placeholder(5, contradictions, "- No contradictions linked to this asset."),
        heading(6, "## Graph Paths"),
        path_rows,
        # An asset has a path when it has an edge; asked of the edges, keys alone travel.
        placeholder(6, G.incident_edges(edge_rows, assets), "- No graph path generated."),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text files in report order; a report of any length spreads over several files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
