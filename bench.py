"""Headline queries at one scale: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans.catalog import QUERIES
from tidemark.session import local_session

HEADLINE = (
    "ledger_counts", "build_ledger", "nested_ledger", "build_evidence", "chunk_overlap", "dangling_evidence",
    "quality_report", "build_shots", "detect_shots", "text_track_summary", "match_boundaries", "match_regions",
    "cue_scores", "stratify", "rights_gate_denied", "adapter_outcomes", "reconcile", "read_ocr_tables",
    "export_captions_srt", "set_digest_tree",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cores, memory="16g")
    QUERIES["chunk_timeline"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cores": cores,
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
            }
        )
    )


if __name__ == "__main__":
    main()
