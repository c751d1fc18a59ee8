"""Times the headline queries and prints one JSON line.

Every query runs twice on the whole tables; the second run is reported, because
the first one mostly measures the start of a cold JVM. Both totals are printed.
"""

from __future__ import annotations

import json
import os
import time

from rainloom.catalog import queries
from rainloom.session import local_session

HEADLINE = [
    "hourly_grid", "feature_store_build", "feature_store_incremental", "ensemble_feature_set", "feature_profile",
    "quantiles_wet", "mean_and_median", "latest_before_asof", "accuracy_hourly_view", "accuracy_by_lead_view",
    "shifted_join_lag_scores", "calendar_ffill", "contingency_by_threshold", "confusion_rollup", "auc_rollup",
    "threshold_sweep_scores", "rolling_month_split", "trailing_window_per_station", "group_fold_assign",
    "missing_period_plan", "dedupe_latest", "merge_update_matched", "json_props_decode", "columnar_json_unpack",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    every = queries()
    def timed(name: str) -> float:
        start = time.time()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - start, 3)

    first = {name: timed(name) for name in HEADLINE}
    seconds = {name: timed(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline queries, second run, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first_run_total": round(sum(first.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
