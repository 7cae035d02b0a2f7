"""Headline-query benchmark.

Runs a fixed set of registered queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line.
Each query is executed in full with the ``noop`` sink (every row is
computed, nothing is collected) ``$BENCH_RUNS`` times (default 3); the
median counts, and ``cold`` has the first run of each. One run of a small
query before absorbs JVM start-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "C0_flagship_outliers_by_building_hour",
    "W3_rolling_mean_24",
    "W5_single_series_features",
    "D1_median_imputation",
    "D5_multi_column_caps",
    "A8_building_stats",
    "A21_histogram_50",
    "A23_box_stats_by_label",
    "A24_correlation_matrix",
    "A32_roc_curve",
    "J7_interval_overlay",
    "L8_stratified_split",
    "M11_evaluate_detector",
    "F23_expected_load_panel",
    "M4_isolation_forest_score",
    "M6_local_outlier_factor",
    "M12_train_evaluate_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wattlane.plans.catalog import QUERIES
    from wattlane.session import drop_staged, get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus))
    QUERIES["A1_row_column_count"][0](spark, sf_dir).collect()
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times, cold = {}, {}
    for name in HEADLINE:
        took = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        times[name], cold[name] = round(statistics.median(took), 3), round(took[0], 3)
        drop_staged(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "cold": cold, "sf": sf}))


if __name__ == "__main__":
    main()
