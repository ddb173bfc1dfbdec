"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.catalog.registry import entries  # noqa: E402
from riskloom.session import local_session  # noqa: E402

HEADLINE = [
    "b00_feature_table", "d01_d02_velocity", "c01_line_stats", "c03_c07_user_profile", "c07_customer_medians", "c12_roc_auc",
    "f02_ks_lines", "f03_ks_moved", "i01_amount_velocity", "i03_cross_border", "i05_round_run", "i07_session_addresses",
    "h03_chunks", "h05_text_matches", "h05_nearest_vectors", "g02_isolation_forest", "g10_oversampled_counts",
    "j04_tier_windows", "f03_user_drift", "h05_term_matches",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = entries()
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start-up is not a query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cores,
    }))


if __name__ == "__main__":
    main()
