"""Streaming forms, plan shapes, and the query registry."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidara.operators import graph as G
from evidara.plans import ingest_queries as I
from evidara.plans import standins as S
from evidara.plans import load
from evidara.plans.registry import COVERS, Tables
from evidara.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def test_ingest_stream_deduplicates_across_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = {n: str(tmp_path / n) for n in ("catalogue", "statuses", "checkpoint")}
    run = lambda: incremental.ingest_stream(spark, str(source), paths["catalogue"], paths["statuses"], paths["checkpoint"]).awaitTermination()
    (source / "a.txt").write_text("one")
    run()
    (source / "b.txt").write_text("one")
    (source / "c.txt").write_text("two")
    (source / "d.bin").write_text("x")
    run()
    rows = {r.filename: r.status for r in spark.read.parquet(paths["statuses"]).collect()}
    assert rows == {"a.txt": "uploaded", "b.txt": "duplicate", "c.txt": "uploaded", "d.bin": "failed"}
    assert spark.read.parquet(paths["catalogue"]).count() == 2


def test_breach_stream_equals_batch(spark, tmp_path):
    readings = Tables(spark, SMALL).events.select("user_id", "event_type", "value")
    readings.repartition(3).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "r"))
    counts = incremental.breach_counts(stream, ["user_id"], "value", 20.0)
    query = counts.writeStream.format("memory").queryName("breaches").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = incremental.breach_counts(readings, ["user_id"], "value", 20.0)
    assert sorted(map(tuple, spark.table("breaches").collect())) == sorted(map(tuple, batch.collect()))


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_top_rows_limit_groups_before_the_shuffle(spark):
    text = plan(G.limit_events(S.events(Tables(spark, SMALL))))
    assert text.count("WindowGroupLimit") >= 2


def test_scans_prune_columns_and_push_filters(spark):
    text = plan(entry.queries()["document_type_filter"](spark, SMALL))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text
    text = plan(entry.queries()["timeline_type_filter"](spark, SMALL))
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]


def test_no_cartesian_products(spark):
    for name in ("lexical_search", "vector_search", "mention_join", "evidence_supported", "present_terms"):
        assert "CartesianProduct" not in (text := plan(entry.queries()[name](spark, SMALL))) and "BroadcastNestedLoopJoin" not in text, name


def test_registry(spark):
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and set(load().QUERIES) == set(COVERS) <= set(queries)
    assert len(queries) >= 150
    assert entry.entry(spark).limit(1).count() == 1


def test_lexical_hits_carry_text(spark):
    t = Tables(spark, SMALL)
    hits = I.lexical_hits(t, 3)
    assert hits.groupBy("query_id").agg(F.max("rank").alias("r")).where(F.col("r") > 3).isEmpty()
