"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evidara.plans import load  # noqa: E402
from evidara.session import local_session  # noqa: E402

HEADLINE = [
    "clean_text",
    "word_window_chunks",
    "content_hash_dedup",
    "evidence_batches",
    "inverse_document_frequency",
    "lexical_search",
    "vector_search",
    "evidence_supported",
    "validated_entities",
    "merged_assets",
    "merged_gaps",
    "first_wins_events",
    "threshold_breaches",
    "rising_trends",
    "latest_events_per_asset",
    "mention_join",
    "graph_edges",
    "evidence_paths",
    "stock_minimum",
    "retrieval_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{folder}/region.parquet").count()
    queries = load().QUERIES
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
