"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the threads.
Each query runs to completion with its rows discarded by the noop sink; one untimed pass over the
smallest query starts the JVM's workers first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from cohortide.session import build_session  # noqa: E402

HEADLINE = (
    "active_days", "first_touch", "explode_params", "sessionize", "session_durations",
    "session_cohort_metrics", "event_session_metrics", "event_bucket_pivot", "revenue_daily",
    "revenue_daily_pooled", "cohort_ltv", "cohort_ltv_dedup", "features_wide",
    "features_wide_joined", "features_long", "minmax_scaled", "baseline_rmse",
    "request_features", "forest_predictions", "score_requests", "stream_route",
    "stream_latest_state",
)
# Timed as well, but not part of the total, so that it stays comparable over time.
FURTHER = (
    "daily_activity", "dq_profile", "features_from_timeline", "features_from_buckets",
    "features_incremental", "sql_ltv", "suffix_shards", "prepared_requests", "ridge_path",
    "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("active_days")
    wanted = sys.argv[1:] or HEADLINE
    times = {name: run(name) for name in wanted}
    further = {} if sys.argv[1:] else {name: run(name) for name in FURTHER}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "further_queries": further,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
