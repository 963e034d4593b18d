"""Headline queries, one warm-up then the median of three runs each; one JSON line on stdout.

    BENCH_SF_DIR  folder of Parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "plan_feature_matrix",        # events -> day cells -> category rows -> matrix
    "c01_latest_snapshot", "c12_ratio_sample", "c16_lookback_observations", "a01_category_counts", "a36_code_aggregates_midpoint", "b01_occurrence",
    "b07_occurrence_profile", "l01_value_stats", "l04_volatility", "l12_max_jump", "l15_value_trend_profile", "l17_percentile_vs_reference", "p09_burst",
    "q03_sequences", "k03_association", "k08_bootstrap_stability", "k12_leadtime_screen", "f04_duplicate_columns", "f10_univariate_auc",
    "m01_stratified_split", "v02_auroc_auprc", "v08_subgroup_audit", "w05_tfidf_svd", "s08_code_map_qc",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from chartline import session
    from chartline.catalog import base, load

    spark = session.build(f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, times = load(), {}
    only = sys.argv[1:]
    for name in only or HEADLINE:
        runs = []
        for i in range(4):
            t0 = time.perf_counter()
            # every result row is computed and thrown away, nothing is collected
            registry[name].run(base.Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
