"""Time the headline reports over the test tables; prints one line of JSON.

All reports are run once to warm up the JVM, then each is timed twice, its rows being fetched;
the shorter time counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from checks.queries import queries

HEADLINES = (
    "map_cumulative_cases", "map_cumulative_cases_visits", "map_cases_21d", "map_layer",
    "cases_last_24h", "summary_stats", "summary_stats_visits", "executive_summary",
    "weekly_table", "weekly_table_visits", "weekly_moving_average", "weekly_by_sex",
    "district_epicurves", "district_weekly_share",
    "top_districts", "top_districts_visits", "district_total_share", "district_reporting",
    "gender_distribution", "age_sex_distribution", "age_sex_by_name", "demographic_breakdown",
    "total_deaths", "deaths_by_district", "deaths_by_age_sex",
    "location_options", "profile_demographic_elements", "dq_multi_date_events",
    "daily_rollup", "live_epi_curve",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("caseframe-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.codegen.cache.maxEntries", "2000")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir",
                     os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="bench-"))
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    reports = queries()
    seconds = {}
    for name in HEADLINES:
        reports[name](spark, sf_dir).collect()
    for name in HEADLINES:
        times = []
        for _ in range(2):
            started = time.perf_counter()
            reports[name](spark, sf_dir).collect()
            times.append(time.perf_counter() - started)
        seconds[name] = round(min(times), 3)
        print(f"{name:32s}{seconds[name]:8.3f}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline reports, total time", "unit": "sec",
                      "value": round(sum(seconds.values()), 3), "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
