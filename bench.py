"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is timed from plan construction until its full result has been
written to the ``noop`` sink.  Fitted models and written tables are released
before each timed query, so none pays for or profits from another.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tardy.catalog import REGISTRY, release  # noqa: E402
from tardy.plans.session import build_session  # noqa: E402

HEADLINE = [
    "enriched_flights", "all_stats_grouping_sets", "top_routes", "top_taxi_out",
    "delay_day_hour", "pivot_day_hour", "row_counts", "summary_stats", "correlation_matrix",
    "speed_trend", "histogram", "kde_curve", "box_stats_by_carrier", "route_distances",
    "request_features", "distance_lookup", "merged_response", "auc_rank_sum",
    "regression_metrics", "string_index", "clean_classification",
    "label_balance", "feature_pipeline", "classification_30", "stream_merge_responses",
    "stream_fan_out",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus),
                          extra={"spark.driver.memory": "16g"})
    # warm-up (not timed): the same plans once on the smallest data set, so
    # JVM class loading and JIT compilation are not billed to the first
    # timed queries; no data of the timed scale is read or cached here.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        release()
        t0 = time.perf_counter()
        df = REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None,
                      "cpus": cpus, "n_queries": len(times)}))
    spark.stop()


if __name__ == "__main__":
    main()
