"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nearby_engine.plans import load_catalog
from nearby_engine.plans.catalog import CATALOG
from nearby_engine.session import local_session

HEADLINE = [
    "office_search", "office_search_filtered", "office_count", "job_search", "job_search_filtered", "job_count",
    "company_jobs", "company_hiring", "cluster_grid", "office_match_by_distance", "role_classification",
    "text_normalized", "text_excerpts", "site_links", "public_url_policy", "greenhouse_jobs", "structured_companies",
    "merge_sightings", "merge_jobs", "source_runs", "run_states",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    load_catalog()
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    # One small job first, so that starting the engine is not booked on the first query.
    CATALOG["office_count"].plan(spark, folder).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        CATALOG[name].plan(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
