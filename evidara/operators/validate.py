"""Validation of extracted records against the text of the page they cite.

Every validator returns all candidate rows with a ``reject_reason`` (null = accepted),
so accepted rows and the reject report come from the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import values as W
from evidara.functions import vocab as V
from evidara.functions.evidence import page_features, supported
from evidara.session import stored
from evidara.sources import payloads as P

NO_SOURCE = "source_reference_not_found"


# -- resolving the cited page ---------------------------------------------------
def _number_text(path: str) -> Column:
    """Text of a number in a payload item; JSON true and false are 1 and 0, their spellings as text are none."""
    text = F.try_variant_get("item", path, "string")
    truth = F.schema_of_variant(F.try_variant_get("item", path, "variant")) == "BOOLEAN"
    return F.when(truth, F.when(text == "true", "1").otherwise("0")).otherwise(text)


def resolve_references(references: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Map distinct (workspace_id, ref_filename, ref_page) to (filename, page, document_id).

    Exact file names win.  Otherwise any shared name key counts, provided all keys of
    the reference lead to one single file.  Keys of pages are reduced to their smallest
    and largest file name first, so a key shared by many files never multiplies rows.
    """
    wanted = references.select("workspace_id", "ref_filename", "ref_page").distinct()
    known = pages.select("workspace_id", "filename", "page").distinct()
    exact = wanted.join(
        known.select("workspace_id", F.col("filename").alias("ref_filename"), F.col("page").alias("ref_page"), "filename"),
        ["workspace_id", "ref_filename", "ref_page"],
        "left",
    )
    index = (
        known.withColumn("key", F.explode(X.filename_keys("filename")))
        .groupBy("workspace_id", "page", "key")
        .agg(F.min("filename").alias("low"), F.max("filename").alias("high"))
    )
    loose = (
        exact.where(F.col("filename").isNull())
        .select("workspace_id", "ref_filename", "ref_page", F.explode(X.filename_keys("ref_filename")).alias("key"))
        .join(index.withColumnRenamed("page", "ref_page"), ["workspace_id", "ref_page", "key"])
        .groupBy("workspace_id", "ref_filename", "ref_page")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("low") == F.col("high"))
        .select("workspace_id", "ref_filename", "ref_page", F.col("low").alias("filename"))
    )
    resolved = exact.where(F.col("filename").isNotNull()).unionByName(loose)
    ids = documents.groupBy("workspace_id", "filename").agg(F.min("id").alias("document_id"))
    return resolved.join(ids, ["workspace_id", "filename"]).withColumn("page", F.col("ref_page"))


def attach_pages(
    records: DataFrame, resolved: DataFrame, features: DataFrame, side: str = ""
) -> DataFrame:
    """Join the cited page's identity, text and features to records (left joins).

    The narrow reference table goes first, so the wide page features cross the network once.
    """
    place = ["workspace_id", f"source_document{side}", f"source_page{side}"]
    found = resolved.withColumnsRenamed(
        {
            "ref_filename": f"ref_filename{side}",
            "ref_page": f"ref_page{side}",
            "filename": place[1],
            "page": place[2],
            "document_id": f"document_id{side}",
        }
    )
    wide = features.withColumnsRenamed(
        {"filename": place[1], "page": place[2]}
        | {f"page_{name}": f"page{side}_{name}" for name in ("compact", "ids", "tokens", "text")}
    )
    named = records.join(found, ["workspace_id", f"ref_filename{side}", f"ref_page{side}"], "left")
    return named.join(wide, place, "left")


def reference_filename() -> Column:
    return P.clean_field("source_document", "source", "source_filename", "filename", "document")


def feature_table(pages: DataFrame) -> DataFrame:
    """Pages with predicate features and their text; computed once, joined by all validators."""
    return page_features(pages.withColumnRenamed("text", "page_text"), text="page_text")


def _featured(pages: DataFrame) -> DataFrame:
    """Pages with their features, which are not made again where they are there."""
    return pages if "page_compact" in pages.columns else feature_table(pages)


# -- parsing candidates (no page needed) ----------------------------------------
def entity_candidates(items: DataFrame) -> DataFrame:
    raw_type, value = P.cleaned_fields("entity_type", "type"), P.clean_field("value", "id", "name")
    return _with_reference(items).select(
        *KEYS,
        *REFERENCE,
        W.entity_type(raw_type, value).alias("entity_type"),
        value.alias("value"),
        W.confidence(_number_text("$.confidence")).alias("confidence"),
        P.clean_field("context", "evidence").alias("context"),
    )


def asset_candidates(items: DataFrame) -> DataFrame:
    return _with_reference(items).select(
        *KEYS,
        *REFERENCE,
        W.asset_id(P.field("id")).alias("asset_id"),
        P.clean_field("name").alias("name"),
        P.cleaned_fields("asset_type", "type").alias("asset_type"),
        P.clean_field("location").alias("location"),
        P.field("risk_level").alias("risk_level"),
        W.iso_date(P.field("last_inspection")).alias("last_inspection"),
        X.clean_list(P.string_list("suggested_actions")).alias("suggested_actions"),
    )


def event_candidates(items: DataFrame) -> DataFrame:
    return _with_reference(items).select(
        *KEYS,
        *REFERENCE,
        W.asset_id(P.field("asset_id")).alias("asset_id"),
        W.iso_date(P.first_field("event_date", "date")).alias("event_date"),
        P.cleaned_fields("event_type", "type").alias("event_type"),
        P.clean_field("title").alias("title"),
        P.clean_field("description", "event").alias("description"),
    )


def gap_candidates(items: DataFrame) -> DataFrame:
    return _with_reference(items).select(
        *KEYS,
        *REFERENCE,
        W.asset_id(P.field("asset_id")).alias("asset_id"),
        P.field("severity").alias("severity"),
        P.clean_field("gap_type", "gap").alias("gap_type"),
        P.clean_field("description", "gap_description", "gap").alias("description"),
        P.clean_field("evidence").alias("evidence"),
        P.clean_field("corrective_action").alias("corrective_action"),
        P.field("status").alias("status"),
    )


def contradiction_candidates(items: DataFrame) -> DataFrame:
    return (
        P.evidence_pairs(items.where(F.col("fields").isNotNull()))
        .select(
            *KEYS,
            W.asset_id(P.field("asset_id")).alias("asset_id"),
            P.field("severity").alias("severity"),
            P.first_field("contradiction_type", "type").alias("contradiction_type"),
            P.clean_field("description").alias("description"),
            X.clean_text("first.evidence").alias("evidence_a"),
            X.clean_text("first.source_document").alias("ref_filename_a"),
            F.col("first.source_page").alias("ref_page_a"),
            X.clean_text("second.evidence").alias("evidence_b"),
            X.clean_text("second.source_document").alias("ref_filename_b"),
            F.col("second.source_page").alias("ref_page_b"),
            P.field("status").alias("status"),
        )
    )


KEYS = ("workspace_id", "ord")
REFERENCE = ("ref_filename", "ref_page")


def _with_reference(items: DataFrame) -> DataFrame:
    return (
        items.where(F.col("fields").isNotNull())
        .withColumn("ref_filename", reference_filename())
        .withColumn("ref_page", P.page_number("source_page", "page"))
    )


# -- validators (candidates joined to pages) ------------------------------------
def check_entities(c: DataFrame) -> DataFrame:
    """Expects candidate columns plus the joined page columns."""
    c = c.withColumn(
        "context",
        F.when(F.col("context") == "", X.source_excerpt("value", "page_text")).otherwise(F.col("context")),
    )
    return c.withColumn(
        "reject_reason",
        F.when(F.col("source_document").isNull(), NO_SOURCE)
        .when(~F.col("entity_type").isin(V.ENTITY_TYPES), "unsupported_entity_type")
        .when(F.col("value") == "", "empty_value")
        .when(F.coalesce(F.col("context"), F.lit("")) == "", "empty_context")
        .when(~supported("value"), "entity_value_not_in_source_text")
        .when(~supported("context"), "context_not_in_source_text"),
    ).withColumn("value", W.entity_value("entity_type", "value"))


def check_assets(c: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("source_document").isNull(), NO_SOURCE)
        .when(F.col("asset_id") == "", "invalid_asset_id")
        .when(~supported("asset_id"), "asset_id_not_in_source_text")
    )
    return (
        c.withColumn("reject_reason", reason)
        .withColumn("evidence_text", X.source_excerpt("asset_id", "page_text"))
        .withColumn("_name", W.asset_name("asset_id", "name", "asset_type"))
        .withColumn("asset_type", F.coalesce(W.first_filled("asset_type", "name"), F.lit("Unknown")))
        .withColumn("name", F.col("_name"))
        .withColumn("location", W.or_default("location", "Unknown"))
        .withColumn("risk_level", W.or_default(W.choice("risk_level", V.RISK_LEVELS), "Unknown"))
        .drop("_name")
    )


def check_events(c: DataFrame) -> DataFrame:
    title = F.coalesce(F.nullif("title", F.lit("")), X.title_from_description("description"))
    return (
        c.withColumn("title", title)
        .withColumn("event_type", W.or_default("event_type", "Other"))
        .withColumn(
            "reject_reason",
            F.when(F.col("source_document").isNull(), NO_SOURCE)
            .when(F.col("asset_id") == "", "invalid_asset_id")
            .when(F.col("event_date").isNull(), "invalid_event_date")
            .when(F.col("title") == "", "empty_title")
            .when(F.col("description") == "", "empty_description")
            .when(~supported("description"), "description_not_in_source_text")
            .when(~supported("asset_id"), "asset_id_not_in_source_text"),
        )
    )


def check_gaps(c: DataFrame) -> DataFrame:
    stated = F.col("description")
    evidence = W.first_filled("evidence", stated)
    gap_type = F.coalesce(F.nullif("gap_type", F.lit("")), X.title_from_description(stated))
    return (
        c.withColumn("gap_type", gap_type)
        .withColumn("evidence", F.coalesce(evidence, F.lit("")))
        .withColumn("description", F.coalesce(F.nullif(stated, F.lit("")), F.col("evidence")))
        .withColumn("severity", W.or_default(W.choice("severity", V.SEVERITIES), "Medium"))
        .withColumn("status", W.or_default(W.choice("status", V.STATUSES), "Open"))
        .withColumn("corrective_action", W.or_default("corrective_action", V.DEFAULT_CORRECTIVE_ACTION))
        .withColumn(
            "reject_reason",
            F.when(F.col("source_document").isNull(), NO_SOURCE)
            .when(F.col("asset_id") == "", "invalid_asset_id")
            .when(F.col("gap_type") == "", "empty_gap_type")
            .when(F.col("description") == "", "empty_description")
            .when(F.col("evidence") == "", "empty_evidence")
            .when(~supported("evidence"), "evidence_not_in_source_text")
            .when(~supported("asset_id"), "asset_id_not_in_source_text"),
        )
    )


def side_held(c: DataFrame, side: str) -> DataFrame:
    """What the page of one side says about a contradiction, in place of the page itself.

    Judged before the other side is attached, so no page travels with a record.
    """
    page = f"page{side}_"
    judged = c.withColumns({f"_evidence{side}": supported(f"evidence{side}", page), f"_asset{side}": supported("asset_id", page)})
    return judged.drop(*[name for name in judged.columns if name.startswith(page)])


def check_contradictions(c: DataFrame) -> DataFrame:
    """Expects candidate columns plus what ``side_held`` adds for both sides."""
    both = F.concat_ws(" ", "evidence_a", F.lit("conflicts with"), "evidence_b")
    description = F.coalesce(F.nullif("description", F.lit("")), X.title_from_description(both))
    return (
        c.withColumn("description", description)
        .withColumn("severity", W.or_default(W.choice("severity", V.SEVERITIES), "Medium"))
        .withColumn("status", W.or_default(W.choice("status", V.STATUSES), "Open"))
        .withColumn(
            "contradiction_type", W.or_default(W.choice("contradiction_type", V.CONTRADICTION_TYPES), "Unknown")
        )
        .withColumn(
            "reject_reason",
            F.when(F.col("source_document_a").isNull() | F.col("source_document_b").isNull(), NO_SOURCE)
            .when(F.col("asset_id") == "", "invalid_asset_id")
            .when((F.col("evidence_a") == "") | (F.col("evidence_b") == ""), "empty_evidence")
            .when(~F.col("_evidence_a") | ~F.col("_evidence_b"), "evidence_not_in_source_text")
            .when(~(F.col("_asset_a") | F.col("_asset_b")), "asset_id_not_in_source_text"),
        )
    )


OUTPUT = {
    "entities": ("document_id", "source_page", "entity_type", "value", "confidence", "context", "source_document"),
    "assets": (
        "asset_id", "name", "asset_type", "location", "risk_level", "last_inspection", "suggested_actions",
        "source_document", "source_page", "evidence_text",
    ),
    "timeline_events": (
        "asset_id", "event_date", "event_type", "title", "description", "source_document", "source_page",
    ),
    "compliance_gaps": (
        "asset_id", "severity", "gap_type", "description", "evidence", "corrective_action", "status",
        "source_document", "source_page",
    ),
    "contradictions": (
        "asset_id", "severity", "contradiction_type", "description", "evidence_a", "source_document_a",
        "source_page_a", "evidence_b", "source_document_b", "source_page_b", "status",
    ),
}
CANDIDATES = {
    "entities": entity_candidates,
    "assets": asset_candidates,
    "timeline_events": event_candidates,
    "compliance_gaps": gap_candidates,
    "contradictions": contradiction_candidates,
}
CHECKS = {
    "entities": check_entities,
    "assets": check_assets,
    "timeline_events": check_events,
    "compliance_gaps": check_gaps,
    "contradictions": check_contradictions,
}


def validate(kind: str, candidates: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates of one kind -> records with ``reject_reason``.

    ``pages`` holds workspace_id, filename, page, text (see ``ingest.source_pages``) or the
    output of ``feature_table``.
    """
    features = _featured(pages)
    if kind == "contradictions":
        for side in ("_a", "_b"):
            refs = candidates.select(
                "workspace_id",
                F.col(f"ref_filename{side}").alias("ref_filename"),
                F.col(f"ref_page{side}").alias("ref_page"),
            )
            candidates = side_held(attach_pages(candidates, resolve_references(refs, features, documents), features, side), side)
    else:
        candidates = attach_pages(candidates, resolve_references(candidates, features, documents), features)
    checked = CHECKS[kind](candidates)
    return checked.select("workspace_id", "ord", *OUTPUT[kind], "reject_reason")


def validate_payloads(unwrapped: DataFrame, pages: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """All five record kinds from unwrapped payloads; ``pages`` as for ``validate``.

    Records are parsed once and stored, as their references and their checks read them.
    """
    features = _featured(pages)
    return {
        kind: validate(kind, stored(CANDIDATES[kind](P.items(unwrapped, kind))), features, documents)
        for kind in V.PAYLOAD_ARRAYS
    }


def accepted(checked: DataFrame) -> DataFrame:
    """Records without a reason.  The outer generator keeps the filter above the reasons, which would else be judged twice."""
    names = [c for c in checked.columns if c != "reject_reason"]
    row = F.when(F.col("reject_reason").isNull(), F.array(F.struct(F.lit(True).alias("_held"), *[F.col(c) for c in names])))
    return checked.select(F.inline_outer(row)).where("_held").select(*names)


def rejects(checked: dict[str, DataFrame]) -> DataFrame:
    """Reject counts by record kind and reason."""
    parts = [
        # Counting non-null reasons instead of filtering first evaluates the reasons once.
        df.groupBy("workspace_id", "reject_reason")
        .agg(F.count("reject_reason").alias("records"))
        .where(F.col("records") > 0)
        .withColumn("kind", F.lit(kind))
        for kind, df in checked.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("workspace_id", "kind", "reject_reason", "records")
