"""Headline queries in seconds: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and threads."""

import json
import os
import time

from tideline.plans.catalog import QUERIES
from tideline.session import session

HEADLINE = [
    "hop_window_stats", "hop_window_anchored", "session_gap_sessions", "interval_merge_sessions", "gap_plan", "grid_interpolate", "asof_last_value", "rolling_max",
    "label_backprojection", "greedy_spacing", "robust_thresholds", "key_moments", "band_join", "first_overlap_session", "sensor_alignment_pivot", "knn_vote",
    "majority_vote", "soft_labels", "forward_eval", "prf_metrics", "motion_basic", "motion_temporal", "key_moments_compile", "cluster_quality", "chunk_log_framing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
