"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from axonframe.plans import REGISTRY

HEADLINE = {
    "b1_threshold_stage": "active_share_by_stage", "b2_runs_burst_stats": "burst_stats", "b3_co_activity_pairs": "co_crackle", "b4_nli": "nonlinear_index",
    "b5_meta_conn": "meta_connectivity", "b6_graph_metrics": "clustering", "b7_avalanches": "avalanches", "b8_lagged_mi": "best_lag_mi", "b9_spectral": "coherence", "b10_bootstrap": "bootstrap_mean",
}
RUNS = 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["active_share_by_stage"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's compilers
    seconds = {}
    for key, name in HEADLINE.items():
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
