"""Time the headline queries and print one JSON line.

Every query runs in full into a sink that keeps nothing; the best of two runs after one warm-up
counts, so that JVM start and code generation are not measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripflow.plans import registry  # noqa: E402
from tripflow.session import build_session  # noqa: E402

HEADLINE = ("trip_quality", "range_clean", "block_mean_resample", "over_limit_top_trips", "schema_variants", "merge_agreeing_columns",
            "row_position", "signal_gradient", "effective_sample_size", "driving_sessions", "group_folds_dealt", "group_split_70_15_15",
            "gap_filled_windows", "skill_by_horizon", "window_score", "forecast_skill", "pooled_ols", "fixed_effects_ols",
            "regression_metrics", "confusion_matrix", "select_features", "conformal_coverage", "policy_outcome", "iso_target_lookup",
            "pi_policy", "rate_limit", "takeover_log", "lag_filter", "delimited_scan", "stream_resample")


def timed(fn, spark, sf: str) -> float:
    t = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, shuffle_partitions=8, memory="12g")
    registry.load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        fn = registry.QUERIES[name]
        timed(fn, spark, sf)
        times[name] = round(min(timed(fn, spark, sf) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
