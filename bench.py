"""Headline timings: one JSON line on stdout. Each query is run once, whole, into a discarding sink."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "telemetry_quality",
    "frame_position_interpolation",
    "flown_path",
    "camera_gps_report",
    "capture_gates",
    "checkpoint_report",
    "fair_comparison",
    "benchmark_winners",
    "monitor_by_stage",
    "dataset_metric_means",
    "frame_windows",
    "best_frame_per_bin",
    "pixel_world_points",
    "overlap_correspondences",
    "utm_coordinates",
    "nearest_surface_distances",
    "voxel_downsample",
    "surface_raster",
    "median_hole_fill",
    "area_statistics",
    "elevation_profiles",
    "similarity_moments",
    "accumulated_transforms",
    "loop_closure_search",
    "run_summary",
    "vibration_windows_stream",
)


def main() -> None:
    from skyledger.plans import catalog
    from skyledger.session import build_session, drop_steps

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    catalog.QUERIES["checkpoint_error_statistics"](spark, sf_dir).count()  # warm the JVM
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_steps(spark)
    print(json.dumps({
        "metric": "headline_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
