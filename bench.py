"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from demandloom.plans import registered
from demandloom.session import local_session

HEADLINE = (
    "fc11_naive_by_store",
    "win1_lags",
    "win2_rolling_stats",
    "win3_ewma",
    "win7_store_row_context",
    "win9_item_calendar_context",
    "win14_acf",
    "imp5_interpolate",
    "out1_flatten_outliers",
    "out2_repair_outliers",
    "jn3_sales_with_weather_inner",
    "jn8_calendar_without_fanout",
    "jn13_storm_window_by_station",
    "agg8_describe_prices",
    "agg15_kpi_block",
    "agg18_sibling_rollups",
    "agg26_box_by_weekday",
    "agg27_correlations",
    "dq2_trend",
    "dq4_pair_recent_trend",
    "ev5_two_level_summary",
    "fs2_anova",
    "fs4_subset_search",
    "fc1_seasonal_by_pair",
    "fc8_store_models",
    "xa3_importance_by_type",
    "features_by_province",
    "features_by_station",
    "xa0_sampled_contributions",
    "fs5_single_tree_importances",
    "fc7_score_and_submit",
    "fc5_ridge_by_pair",
    "cv2_scores_from_sums",
    "fc1_trend_changes",
    "fs9_stationarity",
    "jn17_positional_join",
    "fc5_boosted_with_skips",
    "fc4_boosted_test_scores",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    builders = registered()
    names = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM's compilers and the Python workers.
    builders["fc8_store_models"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        builders[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )


if __name__ == "__main__":
    main()
