"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.  Every query runs
once to warm up and once timed; a run writes the whole result to the ``noop`` sink, so nothing is cut short or collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from terralog.plans import registered
from terralog.session import local_session

HEADLINE = (
    # log
    "bag_summary", "decoded_envelopes", "typed_fixes", "topic_rates", "topic_ids", "merged_chunks", "rate_gated", "rotated_chunks",
    # positions and tiles
    "latest_view_at_click", "georeferenced_fixes", "odometry_twists", "tile_requests", "fixes_in_regions",
    # points
    "thinned_points", "inlier_points", "fused_surfels", "surfel_normals", "weighted_calibrations", "fused_points", "cloud_points",
    # meshes
    "grid_meshes", "vertex_normals", "packed_snapshots", "merged_meshes",
    # telemetry
    "payload_metrics", "publisher_stats", "health_levels", "signal_map", "latest_samples",
    # folds
    "reused_calibrations", "triangle_soup", "converted_log",
    # streams
    "stream_payload_metrics", "stream_topic_rates", "stream_stale",
)
RECORDED_RATE = 71.4  # messages per second of a recorded session


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, cold, warm = registered(), {}, {}
    for name in chosen:
        for times in (cold, warm):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    messages = spark.read.parquet(f"{folder}/events.parquet").count()
    log_seconds = messages / RECORDED_RATE
    line = {
        "metric": "headline_queries_total_seconds", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus, "event_messages": messages,
        "log_seconds_per_wall_second": {n: round(log_seconds / warm[n], 1) for n in ("bag_summary", "decoded_envelopes", "rate_gated") if n in warm},
        "settings": {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")},
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
