"""Time headline queries: one warm run, then the median of three, written to a null sink."""

from __future__ import annotations

import json
import os
import statistics
import time

from curbflow.plans.catalog import QUERIES
from curbflow.session import local_session

HEADLINE = (
    "scan_pruned", "file_row_counts", "clean_yellow", "clean_hvfhv", "iqr_fence", "cleaning_audit",
    "sample_stratified_exact", "daily_trips", "trips_by_hour", "weekday_hour_grid",
    "avg_fare_by_zone_hour", "avg_journey_by_od", "zone_totals", "group_summary",
    "box_stats_by_hour", "route_names", "route_share", "route_metric_speed", "zone_graph_edges",
    "zone_centroids", "centroid_distance", "asof_game", "game_vs_nongame", "game_impact",
    "anova_by_hour", "kruskal_by_hour", "mann_whitney_hours", "spearman_time_distance",
    "shapiro_all", "ols_by_hour", "k_anonymise_monthly", "k_report",
)
REPEATS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:

        def run() -> float:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        run()
        seconds[name] = round(statistics.median(run() for _ in range(REPEATS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
