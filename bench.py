"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]
and print ONE JSON line with per-query seconds.

Each query is fully executed with the ``noop`` sink (every row computed,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "recommendations",          # R-5 flagship: profiles + inventory join
    "usage_profile_cpu_pod",    # R-1 exact percentiles, many groups
    "validate_recommendations",  # R-6
    "regression_metrics",       # V-1..V-5 one-pass scoring
    "stat_features",            # F-14..F-18 on one statistics table
    "power_transform",          # F-20
    "roc_auc",                  # V-9 rank form
    "inverse_error_vote",       # M-6 ensemble
    "rate",                     # B-2 counter rate, halo windows
    "histogram_quantile",       # B-7
    "range_eval",               # B-11 step grid as-of
    "panel_queries",            # B-15 grouping sets
    "unify_metrics",            # X-1 positional pivot
    "quality_verdict",          # G-1..G-4
    "derived_metrics",          # F-1..F-5
    "rolling",                  # F-12 incl. rolling median
    "fill_gaps",                # F-9
    "sequences",                # F-22
    "experiment_summary",       # L-6
    "strategy_report",          # L-11
    "performance_sample",       # L-3
    "seasonal_forecast",        # M-4 normal equations
    "forest_predictions",       # M-2 + M-12
    "oversample",               # F-27 exact neighbours
    "stream_profile",           # T-2
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from capstan.plans import REGISTRY
    from capstan.session import checkpoint_dir, drop_scratch, get_session

    spark = get_session(f"local[{cpus}]", app="capstan-bench", shuffle_partitions=int(cpus))
    checkpoint_dir(spark)
    # JVM / code-generation warm-up on a smaller scale factor (untimed)
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.01")
    if os.path.isdir(warm):
        for n in names:
            REGISTRY[n].build(spark, warm).write.format("noop").mode("overwrite").save()
            drop_scratch(spark)

    times: dict[str, float] = {}
    for n in names:
        t0 = time.perf_counter()
        REGISTRY[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        drop_scratch(spark)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
