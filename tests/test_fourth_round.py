"""Cases of the fourth round of findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidara.functions import text as X
from evidara.functions import vocab as V
from evidara.functions.evidence import page_features, supported
from evidara.functions.ordering import apart, first_by, first_by_apart
from evidara.operators import graph as G
from evidara.operators import reports as R
from evidara.operators import validate
from evidara.plans import graph_queries as GQ
from evidara.plans import standins as S
from evidara.plans.registry import QUERIES, Tables

SMALL = "/root/testdata/sf0.001"


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_read_once_for_all_words_of_a_value(spark):
    rows = [
        ("pump seal leaks oil badly", "The pump has a seal; it leaks oil."), ("pump seal leaks oil badly", "pump seal"), ("Pump  SEAL", "a pump-seal"),
        ("P-1 of pump", "pump P-1"), ("P-1 of pump", "pump P-2"), ("...", "x"), ("", "x"), (None, "x"), ("x y", None), ("the of", "nothing"), ("seal seal seal seal gone", "seal"),
    ]
    judged = page_features(spark.createDataFrame(rows, "v string, text string")).select(supported("v").alias("s"))
    assert [r.s for r in judged.collect()] == [True, False, True, True, False, True, False, False, False, False, True]
    # Inside the lambda over the words only names of lambdas are left, not the making of the tokens.
    assert "array_contains(array_distinct" not in _optimized(judged)


def test_a_text_is_folded_once_for_all_terms(spark):
    df = spark.createDataFrame([("One  TWO three", ["two", "four", "ONE two", ""]), ("x", []), ("x", None), (None, ["a", ""])], "text string, terms array<string>")
    made = df.select(X.matched_terms("text", "terms").alias("m"), X.missing_terms("text", "terms").alias("g"))
    assert [tuple(r) for r in made.collect()] == [(["two", "ONE two", ""], ["four"]), ([], []), (None, None), ([""], ["a"])]
    assert "Contains(trim(regexp_replace(lower(coalesce" not in _optimized(made)


def test_given_page_features_are_not_made_again(spark):
    payload = '{"entities": [{"entity_type": "Person", "value": "marked words", "context": "marked words", "source_document": "a.txt", "source_page": 1}]}'
    unwrapped = validate.P.unwrap(spark.createDataFrame([("w", 1, payload)], "workspace_id string, batch long, content string"))
    pages = validate.feature_table(spark.createDataFrame([("w", "a.txt", 1, "other text")], "workspace_id string, filename string, page int, text string"))
    documents = spark.createDataFrame([("w", 1, "a.txt")], "workspace_id string, id long, filename string")
    marked = pages.withColumn("page_compact", F.lit("marked words"))
    assert validate.validate_payloads(unwrapped, marked, documents)["entities"].first().reject_reason is None
    assert validate.validate_payloads(unwrapped, pages, documents)["entities"].first().reject_reason == "entity_value_not_in_source_text"


def test_a_contradiction_takes_no_page_along(spark):
    item = '{"contradictions": [{"asset_id": "P-1", "evidence_a": "%s", "source_document_a": "a.txt", "source_page_a": 1, "evidence_b": "%s", "source_document_b": "%s", "source_page_b": 1}]}'
    given = [("is open", "is shut", "b.txt"), ("is open", "is open", "b.txt"), ("is shut", "is shut", "b.txt"), ("is open", "is shut", "c.txt"), ("is bare", "is bare", "d.txt"), ("is open", "is bare", "d.txt")]
    rows = [("w", i, item % (a, b, f) if i != 4 else (item % (a, b, f)).replace("a.txt", "d.txt")) for i, (a, b, f) in enumerate(given)]
    unwrapped = validate.P.unwrap(spark.createDataFrame(rows, "workspace_id string, batch long, content string"))
    pages = spark.createDataFrame([("w", "a.txt", 1, "P-1 is open"), ("w", "b.txt", 1, "P-1 is shut"), ("w", "d.txt", 1, "it is bare")], "workspace_id string, filename string, page int, text string")
    documents = pages.select("workspace_id", F.xxhash64("filename").alias("id"), "filename")
    checked = validate.validate("contradictions", validate.CANDIDATES["contradictions"](validate.P.items(unwrapped, "contradictions")), pages, documents)
    assert "page_b_tokens" not in validate.side_held(page_features(pages.withColumns({"evidence_b": F.lit("x"), "asset_id": F.lit("y")}), prefix="page_b_"), "_b").columns
    absent, no_asset = "evidence_not_in_source_text", "asset_id_not_in_source_text"
    assert {r.ord.batch: r.reject_reason for r in checked.collect()} == {0: None, 1: absent, 2: absent, 3: validate.NO_SOURCE, 4: no_asset, 5: None}


def test_accepted_records_are_judged_once(spark):
    rows = spark.createDataFrame([("w", 1, "bad"), ("w", 2, None), (None, None, None)], "workspace_id string, ord int, reject_reason string")
    kept = validate.accepted(rows.withColumn("reject_reason", F.concat("reject_reason", F.lit("!"))))
    assert kept.columns == ["workspace_id", "ord"] and sorted(map(tuple, kept.collect()), key=str) == [("w", 2), (None, None)]
    assert _optimized(kept).count("concat(") == 1


def test_rows_alone_with_their_key_do_not_travel(spark):
    rows = spark.createDataFrame([("a", None, 2, "x"), ("a", None, 1, "y"), (None, "a", 3, "z"), ("b", "k", 4, "u"), ("b", "l", 5, "v")], "k string, l string, ord int, v string")
    kept = first_by_apart(rows, ["k", "l"], ["ord"])
    assert kept.columns == rows.columns
    assert sorted(r.v for r in kept.collect()) == sorted(r.v for r in first_by(rows, ["k", "l"], ["ord"]).collect()) == ["u", "v", "y", "z"]
    alone, shared = apart(rows, ["k", "l"])
    assert {"u", "v"} <= {r.v for r in alone.collect()} and {"x", "y"} <= {r.v for r in shared.collect()}
    assert "hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()


def test_many_shared_keys_fall_back_to_the_whole_grouping(spark, monkeypatch):
    from evidara.functions import ordering

    monkeypatch.setattr(ordering, "FEW", 1)
    rows = spark.range(9).selectExpr("id % 3 AS k", "id AS ord")
    assert ordering.apart(rows, ["k"])[0] is None
    assert sorted(map(tuple, first_by_apart(rows, ["k"], ["ord"]).collect())) == [(0, 0), (1, 1), (2, 2)]


def test_relations_of_records_are_made_by_one_rule():
    made = {*V.ENTITY_EDGE_LABELS.values(), V.DEFAULT_ENTITY_EDGE, "EQUIPMENT_LOCATED_IN", "MENTIONED_IN_DOCUMENT", "EQUIPMENT_MENTIONED_IN_DOCUMENT", "EQUIPMENT_SUPPORTED_BY_DOCUMENT"}
    assert not made & {"EQUIPMENT_HAS_MAINTENANCE_EVENT", "EQUIPMENT_HAS_COMPLIANCE_GAP", "EQUIPMENT_HAS_CONTRADICTION"}


def test_repeated_records_give_one_edge(spark):
    tables = S.graph_tables(Tables(spark, SMALL))
    twice = {**tables, "events": tables["events"].unionByName(tables["events"]), "gaps": tables["gaps"].unionByName(tables["gaps"].limit(5))}
    once, doubled = G.derive_edges(tables), G.derive_edges(twice)
    assert doubled.count() == once.count() and doubled.exceptAll(once).count() == 0


def test_paths_read_their_edges_once(spark):
    t = Tables(spark, SMALL)
    made = G.paths(GQ.shown(t), GQ.nodes(t), S.assets(t))
    made.write.format("noop").mode("overwrite").save()
    assert made.where(F.size("nodes") < 2).count() == 0
    pack = R.asset_pack(S.assets(t), S.gaps(t), S.events(t), S.links(t), S.documents(t), S.contradictions(t), GQ.shown(t))
    assert _optimized(pack).count("WindowGroupLimit") == 1


def test_question_bundle_has_all_its_sections(spark):
    bundle = QUERIES["question_bundle"](spark, SMALL)
    assert set(bundle.columns) == {"query_id", "section", "rank", "label", "detail", "score"}
    sections = {r.section for r in bundle.select("section").distinct().collect()}
    assert {"citation", "confidence", "related_entity", "path_edge"} <= sections
