"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from forecourt.plans.queries import QUERIES

HEADLINE = [
    "source_profile",
    "cleaning_funnel",
    "pnl",
    "margin_summary",
    "pmm_rmse",
    "pct_to_market_applied_by_make",
    "count_by_make_model",
    "skewness",
    "correlation_with_margin",
    "chart_expected_margin_histogram",
    "chart_calculated_margin_by_make",
    "chart_calculated_margin_box_by_make",
    "chart_percent_calculated_loess",
    "chart_share_by_year",
    "standardized",
    "ols_report",
    "ridge_report",
    "lasso_report",
    "elastic_net_report",
    "linear_ml_scores",
    "gbt_scores",
    "cohort_rollup",
    "best_margin_by_zip",
    "outreach_by_region",
    "days_imputed",
    "margin_from_nearest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("forecourt-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("FATAL")
    QUERIES["pnl"](spark, folder).collect()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every row is produced; none but small reports would be worth fetching.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
