"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from blocktrace.catalog import QUERIES
from blocktrace.session import local_session

HEADLINE = [
    "flagship_score_baselines", "ev4_score_predictors", "win1_rewrite_intervals", "win1_intervals_with_ties",
    "win3_build_sequences", "win5_chronological_split", "win10_rule_statistic", "agg1_parse_counters",
    "agg3_disorder_counts", "agg7_rewrite_profile", "agg8_top_share", "agg9_interval_summary", "agg14_write_rate",
    "agg15_interval_ecdf", "cln5_expand_blocks", "cln7_normalize", "src1_read_msr", "jn1_assign_predictions",
    "jn2_prediction_audit", "pl3_placement_counters", "pc1_ablation", "pc3_policy_summary",
    "ev6_linear_regression",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    # Start the JVM paths and Python workers before anything is timed.
    QUERIES["agg4_access_mix"](spark, folder).count()
    spark.catalog.clearCache()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
