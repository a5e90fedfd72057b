"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of the tables   (default /root/testdata/sf0.1)
BENCH_CPUS     local cores            (default 8)
BENCH_RUNS     timed runs per query   (default 3, after one warm-up)
BENCH_QUERIES  comma-separated names, or "all"
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallywise.catalog import QUERIES
from tallywise.session import get_session

HEADLINE = (
    "trend", "trend_day", "kpi_summary", "top_n", "nth_ranked", "pareto", "pareto_ranges",
    "vital_few", "correlation_matrix", "histogram", "anomalies", "group_sum", "group_median",
    "group_nunique", "iqr_outliers", "column_stats", "column_profile", "duplicate_rows",
    "duplicate_rows_wide", "quality_score_full", "null_report", "distinct_counts", "date_features",
    "parse_dates", "filter_chain", "slicer_values", "literal_lookup", "drill_time", "yoy_compare",
    "forecast", "forecast_select", "insights", "recommendations", "q_op", "q_columns", "q_intents",
    "q_followup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "")
    names = tuple(QUERIES) if asked == "all" else tuple(asked.split(",")) if asked else HEADLINE
    spark = get_session(
        "tallywise-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
