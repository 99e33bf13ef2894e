"""Headline queries over the sample tables; prints one JSON line.

    BENCH_SF_DIR   folder of the tables    (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads           (default 8)
"""

from __future__ import annotations

import json
import os
import time

from lucidex.plans.catalog import QUERIES
from lucidex.session import build_session

HEADLINE = ("html_prepare", "conversion_score", "field_text", "exposure_reason", "conversion_plan", "index_line", "index_body",
            "full_index", "description_queue", "site_signals", "overall_score", "rule_narrative", "narrative_guard",
            "body_quality_rates", "instruction_shape", "description_normalise", "conflict_fingerprint",
            "relevant_changes", "rebuild_triggers")


def run(spark, name: str, folder: str) -> float:
    """Seconds to compute every row and column of a query."""
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    run(spark, "seo_posture", folder)
    times = {name: round(run(spark, name, folder), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
