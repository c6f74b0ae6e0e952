"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

recall is the share of exact neighbours that the curve join finds, at the same k, with two shifts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = (
    "knn_exact_join", "knn_curve_join", "knn_gray_join", "knn_hilbert_join", "knn_classify", "knn_regress", "two_stage_forecast", "cv_metrics", "metric_r2_explained", "extract_features", "lookup_features",
    "calendar_features_orders", "zorder_key", "zorder_key_order", "split_positional", "range_partition_assign", "query_grid", "final_series",
)


def main() -> None:
    from tideline.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["union_rs"](spark, SF_DIR).collect()  # starts the JVM's and Python's workers
    times = {}
    for name in NAMES:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    exact = {(r.r_id, r.s_id) for r in QUERIES["knn_exact_join"](spark, SF_DIR).select("r_id", "s_id").collect()}
    recall = {}
    for name in ("knn_curve_join", "knn_gray_join", "knn_hilbert_join"):
        found = {(r.r_id, r.s_id) for r in QUERIES[name](spark, SF_DIR).select("r_id", "s_id").collect()}
        recall[name] = round(len(found & exact) / max(1, len(exact)), 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "recall": recall, "sf": SF_DIR}))


if __name__ == "__main__":
    main()
