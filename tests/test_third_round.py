"""Cases of the third round of findings."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from evidara.functions.ordering import first_by
from evidara.operators import graph as G
from evidara.operators import scorecard as C
from evidara.plans import graph_queries as GQ
from evidara.plans import ingest_queries as I
from evidara.plans import standins as S
from evidara.plans.registry import Tables, spread


def _loads(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_one_row_group_in_many_splits_is_dealt_over_the_cores(spark, tmp_path):
    # Incompressible rows: one row group over many splits of a few bytes.
    rows = 4000
    table = pa.table({"doc_id": list(range(rows)), "text": [f"{i * 7919 % 1000003:x}" * 40 for i in range(rows)]})
    pq.write_table(table, tmp_path / "documents.parquet", row_group_size=rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scanned = spark.read.parquet(str(tmp_path / "documents.parquet"))
        cores = spark.sparkContext.defaultParallelism
        assert scanned.rdd.getNumPartitions() >= cores and len(_loads(scanned)) == 1
        read = Tables(spark, str(tmp_path)).documents
        assert max(_loads(read)) < rows / 2 and read.count() == rows
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_even_splits_are_left_as_scanned(spark):
    even = spark.range(0, 4000, 1, 16).withColumnRenamed("id", "doc_id")
    assert "Exchange hashpartitioning" not in spread(even, "doc_id")._jdf.queryExecution().toString()
    assert spread(even.where("doc_id < 0"), "doc_id").count() == 0


def test_keys_of_first_wins_rows_travel_once(spark):
    rows = spark.createDataFrame([("a", None, 2, "x"), ("a", None, 1, "y"), ("b", "k", 3, "z")], "k string, l string, ord int, v string")
    kept = first_by(rows, ["k", "l", F.lower("v")], ["ord"])
    assert sorted((r.k, r.l, r.ord, r.v) for r in kept.collect()) == [("a", None, 1, "y"), ("a", None, 2, "x"), ("b", "k", 3, "z")]
    narrow = first_by(rows, ["k", "l"], ["ord"])
    assert narrow.columns == rows.columns
    assert sorted((r.k, r.l, r.ord, r.v) for r in narrow.collect()) == [("a", None, 1, "y"), ("b", "k", 3, "z")]
    assert "struct(ord, ord" in narrow._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in first_by(rows.select("k"), ["k"], ["k"]).sort("k").collect()] == [("a",), ("b",)]


def test_edges_are_numbered_without_their_texts(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    whole, narrow = G.number_edges(GQ.shown(t), GQ.nodes(t)), G.number_edges(GQ.shown_ends(t), GQ.nodes(t))
    assert set(narrow.columns) == {*GQ.ENDS, "edge_index", "edge_id"}
    pick = ["workspace_id", "source_id", "target_id", "edge_index", "edge_id"]
    assert whole.select(*pick).exceptAll(narrow.select(*pick)).count() == 0
    assert whole.count() == narrow.count() > 0


def test_nodes_without_details_are_the_same_nodes(spark):
    tables = S.graph_tables(Tables(spark, "/root/testdata/sf0.001"))
    whole, bare = G.derive_nodes(tables), G.derive_nodes(tables, details=False)
    assert "details" not in bare.columns and whole.count() == bare.count()
    assert whole.drop("details").exceptAll(bare).count() == 0


def test_visible_edges_move_no_whole_edge(spark):
    edges = spark.createDataFrame(
        [("w", "a", "b", "1"), ("w", "a", "b", "1"), ("w", "a", "x", "2"), ("w", "x", "a", "3"), ("w", None, "a", "4"),
         ("w", "a", None, "5"), (None, "a", "b", "6"), ("v", "a", "a", "7"), ("v", "b", "a", "8")],
        "workspace_id string, source_id string, target_id string, evidence_text string",
    )
    nodes = spark.createDataFrame([("w", "a"), ("w", "a"), ("w", "b"), ("v", "a"), (None, "a"), ("w", None)], "workspace_id string, id string")
    kept = G.visible_edges(edges, nodes)
    assert kept.columns == ["workspace_id", "target_id", "source_id", "evidence_text"]
    assert sorted(r.evidence_text for r in kept.collect()) == ["1", "1", "7"]
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert G.visible_edges(edges, nodes.limit(0)).count() == 0


def test_texts_of_hits_are_cut_from_their_pages(spark, tmp_path):
    words = lambda n, k: " ".join(f"w{(i * k) % 97}" for i in range(n))
    rows = [(1, words(400, 3), "a"), (2, f" {words(10, 5)}\t\n x ", "a"), (2, words(300, 7), "a"), (3, "", "b"), (4, None, "b"), (5, words(91, 1), None), (6, words(260, 11), "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w3 w5 w11"), (2, "w7 x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = Tables(spark, str(tmp_path))
    made = GQ.matches(t)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.text) for r in made.collect())
    chunks = I.corpus(t).select("text_hash", "text").distinct()
    hits = I.lexical_hits(t, 6).join(chunks, "text_hash")
    assert got == sorted((r.query_id, r["rank"], r.text) for r in hits.collect()) and len(got) > 6


def test_references_without_terms_fetch_no_page(spark):
    metrics = spark.createDataFrame([(n, 1.0, 1.0, 1.0, 1.0) for n in (1, 2)], "query_id long, context_recall double, context_precision double, mrr double, ndcg_at_k double")
    checks = metrics.select("query_id", *[F.lit(0.5).alias(f"minimum_{c}") for c in metrics.columns[1:]])
    bare = spark.createDataFrame([(1, "f", 1), (2, "g", 2)], "query_id long, file string, page int").withColumn("terms", F.array().cast("array<string>"))
    pages = bare.select("file", "page", F.raise_error(F.col("file")).cast("string").alias("text"))
    assert [r.passed for r in C.retrieval_checks(metrics, checks, bare, pages).collect()] == [True, True]
    asked = bare.withColumn("terms", F.when(F.col("page") == 2, F.array(F.lit("absent"))).otherwise(F.col("terms")))
    made = C.retrieval_checks(metrics, checks, asked, bare.select("file", "page", F.lit("text").alias("text")))
    assert {r.query_id: r.passed for r in made.collect()} == {1: True, 2: False}
