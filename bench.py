"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from catalog import QUERIES
from strandframe.session import RECOMMENDED_CONF, STARTUP_CONF

HEADLINE = [
    "flagship_neighbor_errors",  # clean, encode, neighbours, errors by category
    "w2_filled_neighbors",
    "w1_neighbor_columns_in_blocks",
    "p18_sequence_complexity_5",
    "sp1_split_groups",
    "j1_align_conditions",
    "a6_spearman",
    "a17_group_performance",
    "a21_errors_by_category",
    "a22_correlations_actual",
    "a24_position_trends",
    "a28_grouped_errors",
    "a30_group_performance_by_condition",
    "a31_pooled_histogram",
    "m1_forest_fit",
    "m2_forest_uncertainty",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in (RECOMMENDED_CONF | STARTUP_CONF).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing

    names = sys.argv[1:] or HEADLINE
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
