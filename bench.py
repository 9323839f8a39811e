"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is planned
and run in full once to warm up and once for the clock; results go to a sink that reads
all rows and keeps none.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from zonetide.plans.registered import REGISTRY  # noqa: E402
from zonetide.session import builder  # noqa: E402

HEADLINE = [
    "length_stats_by_tld",
    "tld_stats",
    "all_aggregates_grouping_sets",
    "usage_state",
    "resolver_fallback",
    "word_dictionary",
    "pos_index",
    "word_pos_stats",
    "word_tld_pairs",
    "enumerate_names",
    "fair_batch",
    "tld_dim_build",
    "company_corpus",
    "rank_tiers",
    "first_wins_dedupe",
    "upsert_add",
    "upsert_set",
    "upsert_keep",
    "upsert_into_current",
    "dedupe_batches",
    "run_lifecycle",
    "freshness",
    "provider_share",
    "provider_share_delta",
    "provider_latest",
    "csv_provider_explode",
    "adoption_rate",
    "modal_country",
    "registrar_market_share",
    "registrar_coverage",
    "zone_diff_daily",
    "rdap_registrar",
    "row_batches",
    "stream_upload_totals",
    "stream_run_lifecycle",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("zonetide-bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for timed in (False, True):
            start = time.perf_counter()
            REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
