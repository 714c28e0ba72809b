"""Cases of the second round: shared paths, lost copies, dates, numbers, order, gates, stored tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from evidara import session
from evidara.functions import values as W
from evidara.operators import merge, search, store
from evidara.operators import scorecard as C
from evidara.plans.analysis import ingest_files
from evidara.streaming import incremental


def uploads(spark, rows):
    rows = [(w, o, p, len(c), bytearray(c)) for w, o, p, c in rows]
    return spark.createDataFrame(rows, "workspace_id string, ord long, path string, length long, content binary")


def test_workspaces_share_paths_and_bytes(spark):
    rows = [("a", 1, "/in/m.txt", b"first"), ("b", 1, "/in/m.txt", b"second"), ("b", 2, "/in/m.txt", b"first"), ("b", 3, "/in/n.txt", b"second")]
    out = ingest_files(uploads(spark, rows))
    docs = {(r.workspace_id, r.id): r.parsed_text for r in out["documents"].collect()}
    assert docs == {("a", 1): "first", ("b", 1): "second", ("b", 2): "first"}
    status = {(r.workspace_id, r.ord): (r.status, r.stored_id) for r in out["statuses"].collect()}
    assert status == {("a", 1): ("uploaded", 1), ("b", 1): ("uploaded", 1), ("b", 2): ("uploaded", 2), ("b", 3): ("duplicate", 1)}
    assert {(r.workspace_id, r.document_id) for r in out["chunks"].collect()} == set(docs)


def test_a_copy_of_a_file_that_failed_to_parse_is_kept(spark):
    bad = b"a,b\n1,2,3,4\n1,2\n\"open"
    out = ingest_files(uploads(spark, [("a", 1, "/in/x.csv", bad), ("a", 2, "/in/x.txt", bad), ("a", 3, "/in/y.txt", bad)]))
    status = {r.ord: (r.status, r.stored_id) for r in out["statuses"].collect()}
    assert status == {1: ("failed", None), 2: ("uploaded", 2), 3: ("duplicate", 2)}
    assert [r.id for r in out["documents"].collect()] == [2]


def test_size_gate_uses_the_reported_length(spark):
    df = uploads(spark, [("a", 1, "/in/x.txt", b"text")]).withColumn("length", F.lit(30 * 1024 * 1024).cast("long"))
    row = ingest_files(df)["statuses"].first()
    assert row.status == "failed" and row.message.startswith("File is too large")


def test_dates_keep_their_own_day(spark):
    cases = {
        "2024-01-15T02:00:00+05:30": "2024-01-15", "2024-01-15T23:30:00-05:00": "2024-01-15", "20240115": "2024-01-15", "2024-W03-1": "2024-01-15",
        "2024W031": "2024-01-15", "2024-W03": "2024-01-15", "2020-W53-7": "2021-01-03", "2021-W53-1": None, "2024-W00-1": None, "2024-1-15": None,
        "2024-01": None, "2024": None, "20241315": None, "2024-01-15T25:00": None, "2024-01-15 08:30:00.123Z": "2024-01-15", "null": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r.d: r.day for r in df.select("d", W.iso_date("d").alias("day")).collect()} == cases


def test_numbers_are_spelled_as_in_the_answers(spark):
    cases = {"0.5d": 0.0, "7.5f": 0.0, "0x1p3": 0.0, "1_0.5": 10.5, " 2.5e1 ": 25.0, ".5": 0.5, "5.": 5.0, "+3": 3.0, "inf": float("inf"), "true": 0.0, "": 0.0, "_1": 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r.d: r.x for r in df.select("d", W.as_number("d").alias("x")).collect()} == cases


def test_redaction_reaches_nested_records(spark):
    df = spark.createDataFrame([({"a": {"token": "s", "n": "1"}, "password": {"x": "y"}},)], "r map<string,map<string,string>>")
    assert df.select(W.redact_record("r", df.schema["r"].dataType).alias("r")).first().r == {"a": {"token": "[redacted]", "n": "1"}, "password": None}


def test_gaps_keep_the_place_where_they_were_first_seen(spark):
    rows = [("w", "A", "x", "Low", "Open", 0), ("w", "A", "y", "Low", "Open", 1), ("w", "A", "x", "High", "Closed", 2)]
    df = spark.createDataFrame(rows, "workspace_id string, asset_id string, gap_type string, severity string, status string, ord int")
    made = [(r.gap_type, r.severity, r.status) for r in merge.merge_gaps(df).orderBy("ord").collect()]
    assert made == [("x", "High", "Closed"), ("y", "Low", "Open")]


def test_vectors_that_point_away_are_told_apart(spark):
    vectors = spark.createDataFrame([("a", 1, [-1.0, 0.0]), ("a", 2, [-1.0, 0.9]), ("b", 3, [1.0, 0.0])], "w string, id long, embedding array<double>")
    queries = spark.createDataFrame([("a", 7, [1.0, 0.0])], "w string, query_id long, embedding array<double>")
    made = search.cosine_top_k(vectors, queries, 1, scope=["w"]).collect()
    assert [(r.w, r.query_id, r.id, r.score) for r in made] == [("a", 7, 2, 0.0)]
    assert [r.id for r in search.cosine_top_k(vectors, queries, 1).collect()] == [3]


def test_gates_without_a_metric_fail(spark):
    results = spark.createDataFrame([(1, "qa", True, {"citation_hit": 1.0}, 3.0)], "check_id int, category string, passed boolean, metrics map<string,double>, elapsed_ms double")
    gates = spark.createDataFrame([("minimum_nothing", 0.0), ("maximum_p95_check_latency_ms", 3.0), ("minimum_source_document_count", 2.0)], "name string, expected double")
    sources = spark.createDataFrame([(1.0, 1.0, 2, 1)], C.SOURCE_METRICS)
    card = C.scorecard(results, sources=sources)
    assert {r.name: r.passed for r in C.quality_gates(card, gates).collect()} == {
        "minimum_nothing": False, "maximum_p95_check_latency_ms": True, "minimum_source_document_count": True,
    }
    assert C.scorecard(results.limit(0)).first().p95_check_latency_ms == 0.0


@pytest.mark.parametrize("size", [1, 2, 37, 30_000])
def test_exact_percentile(spark, size):
    random = np.random.default_rng(size)
    values = np.where(random.random(size) < 0.4, 5.0, random.normal(5, 3, size))
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double")
    made = {r.k: r.p for r in C.exact_percentile(df, ["k"], "v", 0.95, "p").collect()}
    assert made == pytest.approx({k: np.percentile(values[k::2], 95) for k in range(min(2, size))})
    assert C.exact_percentile(df, [], "v", 0.95, "p").first().p == pytest.approx(np.percentile(values, 95))


def test_a_retried_publish_replaces_its_rows(spark, tmp_path):
    root = str(tmp_path)
    spaces = spark.createDataFrame([("a",), ("b",)], "workspace_id string")
    rows = spaces.withColumn("x", F.lit(1))
    store.open_runs(spaces, root, 1, "manual", "t0")
    assert store.current_runs(spark, root).count() == 0
    for _ in range(2):
        store.write_derived({"assets": rows}, root, 1)
        store.open_runs(spaces, root, 1, "manual", "t0", "complete")
    read = lambda: store.read_current(spark, root, "assets", rows.schema)
    assert read().count() == 2 and {r.run_id for r in store.current_runs(spark, root).collect()} == {1}
    store.clear_derived(spaces.where("workspace_id = 'a'"), root, 2, "t1")
    assert [r.workspace_id for r in read().collect()] == ["b"]
    store.truncate(spark, root, ["assets"])
    assert store.stored_counts(spark, root, ["assets"]).first().row_count == 0


def test_a_retry_without_rows_leaves_none(spark, tmp_path):
    root = str(tmp_path)
    spaces = spark.createDataFrame([("a",), ("b",)], "workspace_id string")
    both = spaces.withColumn("x", F.lit(1))
    read = lambda name: sorted(tuple(r) for r in store.read_current(spark, root, name, both.schema).collect())
    store.write_derived({"gaps": both, "assets": both}, root, 1)
    store.open_runs(spaces, root, 1, "manual", "t0", "complete")
    assert read("gaps") == read("assets") == [("a", 1), ("b", 1)]
    # The second attempt has no gap in a, and other assets.
    store.write_derived({"gaps": both.where("workspace_id = 'b'"), "assets": both.withColumn("x", F.lit(2))}, root, 1)
    assert read("gaps") == [("b", 1)] and read("assets") == [("a", 2), ("b", 2)]
    store.write_derived({"gaps": both.limit(0)}, root, 1)
    assert read("gaps") == [] and read("assets") == [("a", 2), ("b", 2)]
    # A later run that is not complete changes nothing, an attempt that no manifest names is not read.
    store.write_derived({"assets": both}, root, 2)
    store.open_runs(spaces, root, 2, "manual", "t1")
    stray = both.withColumns({"run_id": F.lit(1).cast("bigint"), "attempt": F.lit("stray")})
    stray.write.mode("append").partitionBy("workspace_id", "run_id", "attempt").parquet(f"{root}/assets")
    assert read("assets") == [("a", 2), ("b", 2)]


def test_a_catalogue_that_cannot_be_read_is_an_error(spark, tmp_path):
    assert incremental._catalogue(spark, str(tmp_path / "none"), 1).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet file")
    with pytest.raises(Exception) as fault:
        incremental._catalogue(spark, str(tmp_path / "bad"), 1).count()
    assert not (isinstance(fault.value, AnalysisException) and fault.value.getCondition() == "PATH_NOT_FOUND")


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
