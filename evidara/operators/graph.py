"""Evidence graph: node and edge derivation, limits, layout, paths, exports.

Inputs are the stored tables.  Nodes and edges carry ``ord``, the place in the order in
which the rules emit them, because first-wins and last-wins depend on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import values as W
from evidara.functions import vocab as V
from evidara.functions.ordering import first_by, first_by_apart, position, top_rows
from evidara.session import stored

NODE_COLUMNS = ("workspace_id", "id", "label", "type", "details", "ord")
EDGE_KEY = ("workspace_id", "source_id", "target_id", "relation_type", "source_document", "evidence_text")


def _ord(rule: int, *parts: Column | str) -> Column:
    """(rule, a, b, c): comparable across rules; unused places are fixed."""
    filled = [F.col(p) if isinstance(p, str) else p for p in parts]
    while len(filled) < 3:
        filled.append(F.lit(""))
    names = ("a", "b", "c")
    return F.struct(F.lit(rule).alias("rule"), *[p.cast("string").alias(n) for p, n in zip(filled, names)])


def _sortable(c: Column | str, descending: bool = False) -> Column:
    """A non-negative integer as text that sorts like the number."""
    number = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    return F.lpad((F.lit(2**62) - number if descending else number).cast("string"), 20, "0")


# -- limits for the view -------------------------------------------------------
def limit_events(events: DataFrame, k: int = V.TOP_EVENTS) -> DataFrame:
    """The k latest events per asset (date, type rank, id descending)."""
    order = [F.desc("event_date"), W.lookup("event_type", V.EVENT_TYPE_RANK, 0).desc(), F.desc("id")]
    return top_rows(events, ["workspace_id", "asset_id"], order, k)


def limit_gaps(gaps: DataFrame, k: int = V.TOP_GAPS) -> DataFrame:
    order = [W.lookup("severity", V.SEVERITY_RANK, 0).desc(), F.desc("id")]
    return top_rows(gaps, ["workspace_id", "asset_id"], order, k)


# -- nodes ---------------------------------------------------------------------
def derive_nodes(t: dict[str, DataFrame], details: bool = True) -> DataFrame:
    """Union of all node sources; a repeated id keeps its first place and its last attributes.

    Equipment entities only fill in for ids that are no assets, and the first one wins.
    Without ``details`` that column is left out, which is most of a row.
    """
    with_details = details

    def detail(df: DataFrame, *columns: str) -> Column:
        return F.to_json(F.struct(*columns)) if columns else F.lit("{}")

    def nodes(df: DataFrame, node_id: Column, label: str, kind: Column, details: Column, at: Column) -> DataFrame:
        return df.select(
            "workspace_id", node_id.alias("id"), F.col(label).alias("label"), kind.alias("type"),
            details.alias("details"), at.alias("ord"),
        )

    documents, entities, assets = t["documents"], t["entities"], t["assets"]
    located = assets.where((F.coalesce(F.col("location"), F.lit("")) != "") & (F.col("location") != "Unknown"))
    asset_order = (W.lookup("risk_level", V.SEVERITY_ORDER, 4).cast("string"), F.col("asset_id"))
    entity_at = _ord(3, "entity_type", "value", _sortable("id"))
    equipment = entities.where(F.col("entity_type") == "Equipment")
    parts = [
        nodes(documents, _document_id("id"), "filename", F.lit("Document"), detail(documents, "document_type"),
              _ord(1, _sortable("id", True))),
        nodes(assets, F.col("asset_id"), "name", F.lit("Equipment"),
              detail(assets, "asset_type", "risk_level", "location", "source_document", "source_page", "evidence_text"),
              _ord(2, *asset_order, F.lit("0"))),
        nodes(located, F.concat(F.lit("Location:"), "location"), "location", F.lit("Location"), detail(located),
              _ord(2, *asset_order, F.lit("1"))),
        nodes(entities.where(F.col("entity_type") != "Equipment"), _entity_id(), "value", F.col("entity_type"),
              F.to_json(F.struct("confidence", F.col("filename").alias("source_document"), F.col("page").alias("source_page"))),
              entity_at),
        nodes(t["events"], F.concat(F.lit("Maintenance Event:"), F.col("id").cast("string")), "title",
              F.lit("Maintenance Event"), detail(t["events"], *t["events"].columns), _ord(4, _sortable("id"))),
        nodes(t["gaps"], F.concat(F.lit("Compliance Gap:"), F.col("id").cast("string")), "gap_type",
              F.lit("Compliance Gap"), detail(t["gaps"], *t["gaps"].columns), _ord(5, _sortable("id"))),
        nodes(t["contradictions"], F.concat(F.lit("Contradiction:"), F.col("id").cast("string")), "contradiction_type",
              F.lit("Contradiction"), detail(t["contradictions"], *t["contradictions"].columns), _ord(6, _sortable("id"))),
    ]
    extra = equipment.join(
        assets.select("workspace_id", F.col("asset_id").alias("value")).distinct(), ["workspace_id", "value"], "left_anti"
    )
    parts.append(
        nodes(extra, F.col("value"), "value", F.lit("Equipment"),
              F.to_json(F.struct("confidence", F.lit("extracted entity").alias("source"))), entity_at)
    )
    union = reduce(DataFrame.unionByName, parts)
    shown = ["label", "type", "details"] if with_details else ["label", "type"]
    attributes = F.struct(*shown)
    merged = union.groupBy("workspace_id", "id").agg(
        F.min("ord").alias("ord"),
        F.min_by(attributes, "ord").alias("_first"),
        F.max_by(attributes, "ord").alias("_last"),
    )
    kept = F.when(F.col("_first.type") == "Equipment", F.col("_first")).otherwise(F.col("_last"))
    return merged.select("workspace_id", "id", kept.alias("_n"), "ord").select(
        "workspace_id", "id", *[f"_n.{c}" for c in shown], "ord"
    )


def _document_id(c: str) -> Column:
    return F.concat(F.lit("Document:"), F.col(c).cast("string"))


def _entity_id() -> Column:
    return F.concat(F.col("entity_type"), F.lit(":"), F.col("value"))


# -- edges ---------------------------------------------------------------------
def edge_record(
    confidence: Column | str | float,
    source_document: Column | str,
    evidence_text: Column | str,
    forced: str | None = None,
    reason: str = "",
) -> list[Column]:
    """(confidence, validation_status, validation_reason) of a relationship.

    Confidence is clamped and rounded on its exact binary value before it is compared.
    """
    document = F.col(source_document) if isinstance(source_document, str) else source_document
    evidence = F.col(evidence_text) if isinstance(evidence_text, str) else evidence_text
    if isinstance(confidence, float):
        rounded = F.lit(round(max(0.0, min(1.0, confidence)), 2))
    else:
        number = F.col(confidence) if isinstance(confidence, str) else confidence
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number.cast("double"), F.lit(0.0))))
        rounded = W.half_even(clamped, 2)
    missing = (F.coalesce(document, F.lit("")) == "") | (F.coalesce(evidence, F.lit("")) == "")
    if forced in V.VALIDATION_RANK:
        status, why = F.lit(forced), F.lit(reason or V.REASON_FORCED)
    else:
        accepted = rounded >= V.ACCEPT_CONFIDENCE
        status = F.when(missing, "rejected").when(accepted, "accepted").otherwise("weak")
        why = F.when(missing, V.REASON_REJECTED).when(accepted, V.REASON_ACCEPTED).otherwise(V.REASON_WEAK)
    return [rounded.alias("confidence"), status.alias("validation_status"), why.alias("validation_reason")]


def edges(
    df: DataFrame,
    source: Column,
    target: Column,
    relation: Column | str,
    confidence: Column | float,
    document: Column,
    page: Column,
    evidence: Column,
    at: Column,
    forced: str | None = None,
    reason: str = "",
) -> DataFrame:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    document, evidence = F.coalesce(document, F.lit("")), F.coalesce(evidence, F.lit(""))
    return df.select(
        "workspace_id",
        source.alias("source_id"),
        target.alias("target_id"),
        relation.alias("label"),
        relation.alias("relation_type"),
        *edge_record(confidence, document, evidence, forced, reason),
        document.alias("source_document"),
        F.coalesce(F.nullif(page.cast("int"), F.lit(0)), F.lit(1)).alias("source_page"),
        evidence.alias("evidence_text"),
        at.alias("ord"),
    )


def derive_edges(t: dict[str, DataFrame]) -> DataFrame:
    """Union of the seven edge rules; the first edge of a 5-column key wins.

    ``t`` holds documents, entities (with filename), assets, gaps, events,
    asset_documents and contradictions.  Events, gaps and contradictions make relations of
    their own, so their keys never meet an edge of another rule; as they carry the id of their record,
    hardly any share a key and they need not travel.
    """
    c = V.EDGE_CONFIDENCE
    assets, entities = t["assets"], t["entities"]
    asset_order = (W.lookup("risk_level", V.SEVERITY_ORDER, 4).cast("string"), F.col("asset_id"))
    located = assets.where((F.coalesce(F.col("location"), F.lit("")) != "") & (F.col("location") != "Unknown"))
    equipment = F.col("entity_type") == "Equipment"
    entity_at = ("entity_type", "value")
    shared = [
        edges(located, F.col("asset_id"), F.concat(F.lit("Location:"), "location"), "EQUIPMENT_LOCATED_IN", c["location"],
              F.col("source_document"), F.col("source_page"), F.col("evidence_text"), _ord(1, *asset_order)),
        edges(entities, F.when(equipment, F.col("value")).otherwise(_entity_id()), _document_id("document_id"),
              F.when(equipment, "EQUIPMENT_MENTIONED_IN_DOCUMENT").otherwise("MENTIONED_IN_DOCUMENT"), F.col("confidence"),
              F.col("filename"), F.col("page"), F.col("context"), _ord(2, *entity_at, F.concat(_sortable("id"), F.lit("/")))),
        edges(related_assets(entities.where(~equipment), assets), F.col("asset_id"), _entity_id(),
              W.lookup("entity_type", V.ENTITY_EDGE_LABELS, V.DEFAULT_ENTITY_EDGE), F.col("confidence"),
              F.col("filename"), F.col("page"), F.col("context"),
              _ord(2, *entity_at, F.concat(_sortable("id"), F.lit("/"), F.col("asset_id")))),
        edges(link_sources(t["asset_documents"], assets, t["documents"]), F.col("asset_id"), _document_id("document_id"),
              "EQUIPMENT_SUPPORTED_BY_DOCUMENT", c["document"], F.col("source_document"), F.col("source_page"),
              F.col("evidence_text"), _ord(4, "asset_id", _sortable("document_id")), "weak", V.REASON_LINK),
    ]
    own = [
        edges(t["events"], F.col("asset_id"), F.concat(F.lit("Maintenance Event:"), F.col("id").cast("string")),
              "EQUIPMENT_HAS_MAINTENANCE_EVENT", c["event"], F.col("source_document"), F.col("source_page"),
              F.col("description"), _ord(3, _sortable("id"))),
        edges(t["gaps"], F.col("asset_id"), F.concat(F.lit("Compliance Gap:"), F.col("id").cast("string")),
              "EQUIPMENT_HAS_COMPLIANCE_GAP", c["gap"], F.col("source_document"), F.col("source_page"),
              F.col("evidence"), _ord(5, _sortable("id"))),
        edges(t["contradictions"], F.col("asset_id"), F.concat(F.lit("Contradiction:"), F.col("id").cast("string")),
              "EQUIPMENT_HAS_CONTRADICTION", c["contradiction"], F.col("source_document_a"), F.col("source_page_a"),
              F.col("evidence_a"), _ord(6, _sortable("id"))),
    ]
    parts = [first_by(reduce(DataFrame.unionByName, shared), EDGE_KEY, ["ord"])]
    return reduce(DataFrame.unionByName, parts + [first_by_apart(part, EDGE_KEY, ["ord"]) for part in own])


def link_sources(links: DataFrame, assets: DataFrame, documents: DataFrame) -> DataFrame:
    """Links with file name (the asset's own source when the document is gone), page and evidence."""
    a = assets.select("workspace_id", "asset_id", F.col("source_document").alias("_own"), "source_page", "evidence_text")
    d = documents.select("workspace_id", F.col("id").alias("document_id"), "filename")
    joined = links.join(a, ["workspace_id", "asset_id"], "left").join(d, ["workspace_id", "document_id"], "left")
    return joined.withColumn("source_document", F.coalesce("filename", "_own", F.lit(""))).drop("_own", "filename")


# Window of a run of id characters, and how far two windows overlap (at least an id's length).
RUN, OVERLAP = 512, 80


def mention_pairs(
    texts: DataFrame, assets: DataFrame, keys: list[str], haystack: Column, fold: bool = True
) -> DataFrame:
    """(keys, asset_id) for every asset whose id is a substring of the haystack.

    An id consists of [A-Za-z0-9_.-] only (80 characters at most), so each hit lies inside
    one run of those characters; runs of over ``RUN`` are cut into overlapping windows.  The
    distinct runs (a vocabulary, far smaller than the text) are cut into substrings of the
    id lengths that occur and equi-joined to the ids; hits go back to the texts by another
    equi join.  No pair of text and asset is ever formed without a hit.
    """
    case = F.upper if fold else (lambda c: c)
    ids = assets.select("workspace_id", "asset_id").distinct().withColumn("_piece", case(F.col("asset_id")))
    # A few lengths for all workspaces; ids are compared within a workspace below.
    lengths = ids.agg(F.collect_set(F.length("_piece"))).scalar()
    found = F.regexp_extract_all(case(haystack), F.lit(r"[A-Za-z0-9_.\-]{2,}"), F.lit(0))
    windows = F.transform(
        found,
        lambda run: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - OVERLAP), F.lit(RUN - OVERLAP)), lambda i: F.substring(run, i, F.lit(RUN))
        ),
    )
    runs = texts.select(*keys, F.explode(F.array_distinct(F.flatten(windows))).alias("_run"))
    words = runs.select("workspace_id", "_run").distinct().withColumn("_lengths", lengths)
    sized = words.withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length("_run"))
    cut = F.transform(
        F.sequence(F.lit(1), F.length("_run") - F.col("_n") + 1), lambda i: F.substring(F.col("_run"), i, F.col("_n"))
    )
    pieces = sized.select("workspace_id", "_run", F.explode(F.array_distinct(cut)).alias("_piece"))
    hits = pieces.join(ids, ["workspace_id", "_piece"]).select("workspace_id", "_run", "asset_id").distinct()
    return runs.join(hits, ["workspace_id", "_run"]).select(*keys, "asset_id").distinct()


def related_assets(entities: DataFrame, assets: DataFrame) -> DataFrame:
    """Entities joined to every asset mentioned in their value, context or file name."""
    haystack = F.concat_ws(" ", "value", "context", "filename")
    pairs = mention_pairs(entities, assets, ["workspace_id", "id"], haystack)
    return entities.join(pairs, ["workspace_id", "id"])


# -- view ----------------------------------------------------------------------
def visible_edges(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes; ``edge_rows`` are read twice, so they should be stored.

    The ends that are no nodes are found from the distinct ends alone and stored, so that their
    size is known: unless they are many, whole edges meet them where they lie, without an exchange.
    """
    ends = edge_rows.select("workspace_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    missing = stored(ends.join(nodes.select("workspace_id", "id"), ["workspace_id", "id"], "left_anti"))
    kept = edge_rows.dropna(subset=["workspace_id", "source_id", "target_id"])
    for side in ("source_id", "target_id"):
        kept = kept.join(missing.withColumnRenamed("id", side), ["workspace_id", side], "left_anti")
    return kept


def edge_audit(edge_rows: DataFrame) -> DataFrame:
    status = F.coalesce("validation_status", F.lit("weak"))
    return edge_rows.groupBy("workspace_id").agg(
        F.count_if(status == "accepted").alias("accepted"),
        F.count_if(status == "weak").alias("weak"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count("*").alias("total"),
    )


def number_edges(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge index and id in multigraph order: source node, first edge to the target, edge."""
    at = nodes.select("workspace_id", F.col("id").alias("source_id"), F.col("ord").alias("_source_at"))
    pair = ["workspace_id", "source_id", "target_id"]
    first = edge_rows.groupBy(*pair).agg(F.min("ord").alias("_pair_at"))
    placed = edge_rows.join(first, pair).join(at, ["workspace_id", "source_id"])
    order = [F.col("_source_at"), F.col("_pair_at"), F.col("ord")]
    helpers = ["_source_at", "_pair_at"]
    numbered = position(placed, ["workspace_id"], order, "_n", helpers=helpers).withColumn("edge_index", F.col("_n") - 1)
    name = F.concat_ws("-", "source_id", "target_id", F.col("edge_index").cast("string"))
    return numbered.withColumn("edge_id", name).drop("_n")


def node_degree(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with their degree (a self loop counts twice)."""
    ends = edge_rows.select("workspace_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    counts = ends.groupBy("workspace_id", "id").agg(F.count("*").alias("degree"))
    return nodes.join(counts, ["workspace_id", "id"], "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0).cast("bigint"))
    )


def layout(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Grid position: one column per node type, rows by degree, type and label."""
    ranked = node_degree(edge_rows, nodes).withColumn(
        "_column", W.lookup("type", V.GRAPH_COLUMNS, V.OTHER_GRAPH_COLUMN)
    )
    order = [F.desc("degree"), F.col("type"), F.col("label"), F.col("ord")]
    placed = position(ranked, ["workspace_id", "_column"], order, "_row_number")
    lowest = ranked.groupBy("workspace_id").agg(F.min("_column").alias("_lowest"))
    return placed.join(lowest, "workspace_id").select(
        "workspace_id", "id", "type", "label", "degree",
        ((F.col("_column") - F.col("_lowest")) * V.GRID_X).alias("x"),
        ((F.col("_row_number") - 1) * V.GRID_Y).alias("y"),
    )


def dominant_asset(edge_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every non-equipment node the asset it is linked to most (ties: the better ranked asset)."""
    degrees = node_degree(edge_rows, nodes)
    kinds = nodes.select("workspace_id", "id", "type")
    both = edge_rows.join(
        kinds.select("workspace_id", F.col("id").alias("source_id"), F.col("type").alias("_s")), ["workspace_id", "source_id"]
    ).join(kinds.select("workspace_id", F.col("id").alias("target_id"), F.col("type").alias("_t")), ["workspace_id", "target_id"])
    s, t = F.col("_s") == "Equipment", F.col("_t") == "Equipment"
    links = both.where(s != t).select(
        "workspace_id",
        F.when(s, F.col("target_id")).otherwise(F.col("source_id")).alias("id"),
        F.when(s, F.col("source_id")).otherwise(F.col("target_id")).alias("asset_id"),
    )
    counts = links.groupBy("workspace_id", "id", "asset_id").agg(F.count("*").alias("links"))
    ranks = degrees.where(F.col("type") == "Equipment").select(
        "workspace_id", F.col("id").alias("asset_id"), F.col("degree").alias("_degree"), F.col("label").alias("_label")
    )
    best = F.struct((-F.col("links")).alias("a"), (-F.col("_degree")).alias("b"), F.col("_label").alias("c"), F.col("asset_id").alias("d"))
    return counts.join(ranks, ["workspace_id", "asset_id"]).groupBy("workspace_id", "id").agg(
        F.min_by("asset_id", best).alias("asset_id"), F.max("links").alias("links")
    )


def filter_nodes(nodes: DataFrame, kind: str = "Core", search: str = "") -> DataFrame:
    """Type filter of the view ("Core", "All" or one type) plus label/type search."""
    from evidara.functions.text import any_contains

    if kind == "Core":
        nodes = nodes.where(~F.col("type").isin(V.CORE_EXCLUDED_TYPES))
    elif kind != "All":
        nodes = nodes.where(F.col("type") == kind)
    return nodes.where(any_contains(["label", "type"], search))


def incident_edges(edge_rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Edges that touch an asset at either end, once per asset (two equi joins, no OR join)."""
    ids = assets.select("workspace_id", "asset_id").distinct()
    outgoing = edge_rows.withColumn("asset_id", F.col("source_id")).join(ids, ["workspace_id", "asset_id"], "left_semi")
    incoming = (
        edge_rows.where(F.col("source_id") != F.col("target_id"))
        .withColumn("asset_id", F.col("target_id"))
        .join(ids, ["workspace_id", "asset_id"], "left_semi")
    )
    return outgoing.unionByName(incoming)


def neighbours(edge_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected nodes (workspace_id, id) with all nodes one edge away."""
    picked = selected.select("workspace_id", F.col("id").alias("selected_id")).distinct()
    out = edge_rows.select("workspace_id", F.col("source_id").alias("selected_id"), F.col("target_id").alias("id"))
    back = edge_rows.select("workspace_id", F.col("target_id").alias("selected_id"), F.col("source_id").alias("id"))
    found = out.unionByName(back).join(picked, ["workspace_id", "selected_id"], "left_semi")
    return found.unionByName(picked.withColumn("id", F.col("selected_id"))).select("workspace_id", "id").distinct()


def path_edges(edge_rows: DataFrame, assets: DataFrame, k: int = V.TOP_EDGES) -> DataFrame:
    """The k strongest edges per asset; equal edges keep their order."""
    order = [
        W.lookup("validation_status", V.VALIDATION_RANK, 0).desc(), F.desc("confidence"), F.desc("relation_type"), F.col("ord"),
    ]
    return top_rows(incident_edges(edge_rows, assets), ["workspace_id", "asset_id"], order, k)


def paths(edge_rows: DataFrame, nodes: DataFrame, assets: DataFrame, k: int = V.TOP_EDGES) -> DataFrame:
    """One evidence path per asset that has edges: at most k edges, their nodes, mean confidence."""
    keys = ["workspace_id", "asset_id"]
    top = path_edges(edge_rows, assets, k)
    edge = F.struct(
        "rank", "source_id", "target_id", "label", "relation_type", "confidence", "source_document", "source_page",
        "evidence_text", "validation_status", "validation_reason",
    )
    body = top.groupBy(*keys).agg(
        F.array_sort(F.collect_list(edge)).alias("edges"),
        (F.aggregate(F.array_sort(F.collect_list(F.struct("rank", "confidence"))), F.lit(0.0), lambda a, x: a + x["confidence"])
         / F.count("*")).alias("_mean"),
    )
    # Read off the grouped edges, whose exchange is the one above; columns of their own would need another.
    touched = F.flatten(F.transform("edges", lambda e: F.array(e["source_id"], e["target_id"])))
    ends = body.select(*keys, F.explode(F.array_distinct(F.concat(F.array("asset_id"), touched))).alias("id"))
    named = (
        ends.join(nodes.select("workspace_id", "id", "label", "type"), ["workspace_id", "id"])
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("id", "label", "type"))).alias("nodes"))
    )
    return body.join(named, keys, "left").select(
        *keys,
        F.concat("asset_id", F.lit(" linked evidence path")).alias("title"),
        F.concat(
            "asset_id",
            F.lit(" connects generated asset intelligence to extracted evidence, events, gaps, contradictions, and source documents."),
        ).alias("summary"),
        "nodes",
        "edges",
        W.half_even("_mean", 2).alias("confidence"),
    )


def path_evidence(path_rows: DataFrame, k: int = V.PATH_EVIDENCE) -> DataFrame:
    """Flat evidence rows, at most k per path."""
    from evidara.functions.text import display_label

    flat = path_rows.select("workspace_id", "asset_id", F.inline(F.slice("edges", 1, k)))
    described = F.concat_ws(" / ", "source_id", display_label("label"), "target_id")
    return flat.select(
        "workspace_id", "asset_id", "rank", "confidence", F.col("source_document").alias("document"),
        F.col("source_page").alias("page"), F.col("validation_reason").alias("reason"),
        F.coalesce(F.nullif("evidence_text", F.lit("")), described).alias("snippet"),
        F.col("validation_status").alias("status"),
    )


def path_of_node(path_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """The first path (by asset order) that holds each selected node."""
    held = path_rows.select(
        "workspace_id", "asset_id", F.explode(F.array_union(F.array("asset_id"), F.transform("nodes", lambda n: n["id"]))).alias("id")
    )
    wanted = selected.select("workspace_id", "id").distinct()
    return held.join(wanted, ["workspace_id", "id"], "left_semi").groupBy("workspace_id", "id").agg(
        F.min("asset_id").alias("asset_id")
    )


# -- exports -------------------------------------------------------------------
def node_json(nodes: DataFrame) -> DataFrame:
    data = F.struct("label", "type", "details")
    return nodes.select("workspace_id", "ord", F.to_json(F.struct("id", data.alias("data"))).alias("line"))


def edge_json(edge_rows: DataFrame) -> DataFrame:
    columns = [c for c in edge_rows.columns if c not in ("workspace_id", "ord")]
    return edge_rows.select("workspace_id", "ord", F.to_json(F.struct(*columns)).alias("line"))


def cypher_string(c: Column | str) -> Column:
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def cypher_relation(c: Column | str) -> Column:
    name = F.regexp_replace(F.upper(F.col(c) if isinstance(c, str) else c), "[^A-Z0-9_]+", "_")
    name = F.regexp_replace(name, r"\A_+|_+\z", "")
    return F.when(name == "", "RELATED_TO").otherwise(name)


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    """One MERGE statement per node."""
    line = F.concat(
        F.lit("MERGE (n:EvidenceNode {id: "), cypher_string("id"), F.lit("}) SET n.label = "), cypher_string("label"),
        F.lit(", n.type = "), cypher_string("type"), F.lit(", n.details_json = "), cypher_string("details"), F.lit(";"),
    )
    return nodes.select("workspace_id", "ord", line.alias("line"))


def cypher_edges(edge_rows: DataFrame) -> DataFrame:
    """One MATCH ... MERGE statement per edge."""
    texts = {
        "label": "label", "relation_type": "relation_type", "source_node": "source_id", "target_node": "target_id",
        "confidence": None, "source_document": "source_document", "source_page": None, "evidence_text": "evidence_text",
        "validation_status": "validation_status", "validation_reason": "validation_reason",
    }
    parts = []
    for name, column in texts.items():
        value = cypher_string(column) if column else F.col(name).cast("string")
        parts.append(F.concat(F.lit(f"{name}: "), value))
    line = F.concat(
        F.lit("MATCH (a:EvidenceNode {id: "), cypher_string("source_id"), F.lit("}), (b:EvidenceNode {id: "),
        cypher_string("target_id"), F.lit("}) MERGE (a)-[r:"), cypher_relation("relation_type"),
        F.lit("]->(b) SET r += {"), F.concat_ws(", ", *parts), F.lit("};"),
    )
    return edge_rows.select("workspace_id", "ord", line.alias("line"))


def stored_edges(edge_rows: DataFrame) -> DataFrame:
    """Stored edges with the defaults readers expect."""
    relation = W.first_filled("relation_type", "label")
    return edge_rows.withColumns(
        {
            "relation_type": F.coalesce(relation, F.lit("RELATED_TO")),
            "label": F.coalesce(W.first_filled("label", "relation_type"), F.lit("RELATED_TO")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "source_document": F.coalesce("source_document", F.lit("")),
            "source_page": F.coalesce(F.nullif("source_page", F.lit(0)), F.lit(1)),
            "evidence_text": F.coalesce("evidence_text", F.lit("")),
            "validation_status": W.or_default("validation_status", "weak"),
            "validation_reason": F.coalesce("validation_reason", F.lit("")),
        }
    )
