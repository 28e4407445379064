"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8).
Each query runs once to warm up and is then timed to the last row.
"""

from __future__ import annotations

import json
import os
import time

from probanda import build_session
from probanda.catalog import REGISTRY

HEADLINE = [
    "hybrid_search",
    "search_in_document",
    "vector_top_k",
    "sub_question_search",
    "chunk_text",
    "clean_text",
    "redact_injection",
    "compare_sources",
    "confidence",
    "context_packing",
    "validation_verdicts",
    "research_prompts",
    "session_summaries",
    "admission_limit",
    "sliding_request_counts",
    "stage_latency",
    "integrity_report",
]


def timed(spark, run, sf_dir: str) -> float:
    began = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    spark.catalog.clearCache()
    return took


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run = REGISTRY[name].run
        timed(spark, run, sf_dir)
        seconds[name] = round(timed(spark, run, sf_dir), 3)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
