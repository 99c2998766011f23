"""Typed survey tables derived from the star-schema tables.

The text of each view runs unchanged in Spark SQL and in DuckDB; double literals carry an
exponent because a plain ``1.0`` is a decimal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS = {
    "telemetry": """
        SELECT user_id AS flight_id, event_id AS sample_id,
               (event_id * 37 + user_id * 11) % 7200 / 10.0e0 AS time_s_raw,
               CAST(event_id AS DOUBLE) / 10.0e0 AS time_s,
               12.0e0 + (event_id % 997) * 0.00001e0 + (user_id % 7) * 0.001e0 + CASE WHEN event_id % 499 = 7 THEN 0.05e0 ELSE 0.0e0 END AS latitude,
               77.0e0 + (event_id % 613) * 0.00001e0 + (user_id % 5) * 0.001e0 AS longitude,
               100.0e0 + value / 10.0e0 AS altitude_m,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 50 + 1) / 20.0e0 END AS horizontal_accuracy_m,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 40 + 1) / 10.0e0 END AS vertical_accuracy_m,
               event_type AS position_source,
               CASE event_type WHEN 'click' THEN 'absolute (abs_alt)' WHEN 'view' THEN 'relative_to_takeoff'
                    ELSE NULL END AS altitude_datum,
               event_type <> 'error' AS is_recording
        FROM events""",
    "frames": """
        SELECT user_id AS flight_id, event_id AS frame_id, CAST(event_id AS DOUBLE) / 10.0e0 + 0.35e0 AS time_s,
               value AS sharpness, (event_id % 100) / 100.0e0 AS tracked_fraction,
               (event_id % 37) / 4.0e0 AS parallax_px, (event_id % 11) / 100.0e0 AS motion_fraction
        FROM events""",
    "points": """
        SELECT l_orderkey * 10 + l_linenumber AS point_id, l_suppkey % 4 AS scan_id,
               CASE WHEN l_linenumber % 2 = 1 THEN 'reconstruction' ELSE 'reference' END AS cloud,
               (l_orderkey * 7 % 2000) / 20.0e0 AS x, (l_partkey * 13 % 2000) / 20.0e0 AS y,
               l_quantity / 10.0e0 AS z, 1.0e0 + l_discount * 10.0e0 AS conf
        FROM lineitem""",
    "vibration": """
        SELECT event_id % 8 AS sensor_id, event_id AS seq, ts, sin(event_id * 0.7e0) * value / 500.0e0 AS ax,
               cos(event_id * 0.3e0) * value / 800.0e0 AS ay, sin(event_id * 0.11e0) * value / 900.0e0 AS az
        FROM events""",
    "checkpoints": """
        SELECT o_custkey % 20 AS run_id, o_orderkey AS checkpoint_id,
               (o_orderkey % 100) * 1.0e0 AS known_x_m, (o_custkey % 100) * 1.0e0 AS known_y_m, 5.0e0 AS known_z_m,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL
                    ELSE (o_orderkey % 100) + (o_custkey % 13 - 6) / 20.0e0 END AS reconstructed_x_m,
               (o_custkey % 100) + (o_orderkey % 11 - 5) / 20.0e0 AS reconstructed_y_m,
               5.0e0 + (o_orderkey % 7 - 3) / 20.0e0 AS reconstructed_z_m
        FROM orders""",
    "edges": """
        SELECT DISTINCT l_partkey % 300 AS a, l_suppkey * 3 % 300 AS b, l_quantity >= 45 AS verified
        FROM lineitem WHERE l_partkey % 300 <> l_suppkey * 3 % 300""",
    "runs": """
        SELECT o_orderkey AS run_id, o_orderpriority AS dataset, o_orderstatus AS mode,
               o_totalprice / 100.0e0 AS runtime_s, 60.0e0 + o_custkey % 400 / 10.0e0 AS registration_percent,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 30) / 20.0e0 END AS checkpoint_rmse_m,
               o_orderkey % 3 = 0 AS production_ready
        FROM orders""",
    "poses": """
        SELECT c_nationkey AS seq_id, c_custkey AS frame_id, cos(c_custkey * 0.01e0) AS qw, 0.0e0 AS qx, 0.0e0 AS qy,
               sin(c_custkey * 0.01e0) AS qz, c_acctbal / 1000.0e0 AS tx, (c_custkey % 50) / 10.0e0 AS ty,
               (c_custkey % 9) / 10.0e0 AS tz, 1.0e0 + (c_custkey % 3 - 1) / 100.0e0 AS s
        FROM customer""",
    # One 8 x 8 depth image per 64 consecutive order keys; eight images form one sequence.
    "pixels": """
        SELECT CAST(floor(o_orderkey / 512) AS BIGINT) AS seq_id, CAST(floor(o_orderkey / 64) AS BIGINT) AS frame_id,
               o_orderkey % 64 AS pixel, o_orderkey % 8 AS u, CAST(floor(o_orderkey % 64 / 8) AS BIGINT) AS v,
               CASE WHEN o_orderkey % 41 = 0 THEN 0.0e0 ELSE 4.0e0 + o_totalprice / 1000000.0e0 END AS depth,
               1.0e0 + (o_custkey % 50) / 10.0e0 AS conf, (o_custkey % 10) / 10.0e0 AS sky
        FROM orders""",
    "monitor": """
        SELECT event_id AS sample_id, user_id % 5 AS host_id, event_id * 2.0e0 AS at_s,
               CASE WHEN event_id % 13 = 0 THEN 'N/A' ELSE CAST(event_id % 101 AS STRING) END AS utilization_gpu_percent,
               CASE WHEN event_id % 17 = 0 THEN '[N/A]' ELSE CAST(1000 + event_id % 7000 AS STRING) END AS memory_used_mb,
               CASE WHEN event_id % 19 = 0 THEN '' ELSE CAST(8192 AS STRING) END AS memory_total_mb,
               CAST(40 + event_id % 45 AS STRING) AS temperature_c,
               CASE WHEN event_id % 23 = 0 THEN 'N/A' ELSE CAST(event_id % 250 AS STRING) END AS power_draw_w
        FROM events""",
    "stages": """
        SELECT event_id AS stage_id, user_id % 5 AS host_id, event_type AS category, event_id * 2.0e0 AS start_s,
               event_id * 2.0e0 + 10.0e0 + event_id % 50 AS end_s, value AS seconds
        FROM events""",
    # Flattened run reports; runs of one customer form a benchmark whose first run is the reference.
    "reports": """
        SELECT o_orderkey AS run_id, o_custkey AS benchmark_id,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_totalprice / 100.0e0 END AS runtime_s,
               80.0e0 + o_orderkey % 200 / 10.0e0 AS registration_percent, (o_orderkey % 60) / 25.0e0 AS reprojection_px,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_orderkey % 40) / 20.0e0 END AS gps_rmse_m,
               900 + o_orderkey % 5000 AS points, 450 + o_orderkey % 900 AS mesh_vertices, 480 + o_orderkey % 1000 AS mesh_faces,
               500 + o_orderkey % 3000 AS dsm_cells, 20 + o_orderkey % 60 AS registered_images,
               0.6e0 + (o_orderkey % 40) / 100.0e0 AS dsm_fraction, o_orderkey % 24 AS mesh_components,
               (o_orderkey % 5) / 2500.0e0 AS oversized_fraction, o_orderkey % 6 <> 0 AS textured,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'clip-' || CAST(o_custkey % 5 AS STRING) END AS video_id,
               100.0e0 + o_custkey % 50 + (o_orderkey % 3) / 5.0e0 AS duration_s,
               CASE WHEN o_orderkey % 2 = 0 THEN 100.0e0 + o_custkey % 50 + (o_orderkey % 7) / 7.0e0 END AS duration_b_s,
               120 AS target_frames, CASE WHEN o_orderkey % 3 = 0 THEN 120 + o_orderkey % 2 * 8 END AS target_frames_b,
               110 AS selected_frames, CASE WHEN o_orderkey % 4 = 3 THEN 110 + o_orderkey % 3 END AS selected_frames_b,
               md5(CAST(o_custkey AS STRING)) AS manifest_digest,
               '1920x' || CASE WHEN o_orderkey % 11 = 0 THEN '1088' ELSE '1080' END AS resolution,
               CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 20 END AS dense_checks, (o_orderkey % 9) / 10.0e0 AS dense_f1,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 8 END AS checkpoint_checks,
               (o_orderkey % 30) / 25.0e0 AS checkpoint_rmse_m, (o_orderkey % 30) / 20.0e0 AS checkpoint_max_m,
               CASE WHEN o_orderkey % 2 = 0 THEN 4 END AS distance_checks, (o_orderkey % 25) / 20.0e0 AS distance_rmse_m,
               (o_orderkey % 25) / 15.0e0 AS distance_max_m,
               o_orderkey % 8 <> 0 AS capture_ready, o_orderkey % 16 <> 0 AS telemetry_passed, o_orderkey % 9 <> 0 AS verified_ready,
               o_orderstatus AS device, o_orderpriority AS dataset
        FROM orders""",
}

# Drawn five-corner outlines, one per customer, over the four rasters of ``points``.
VIEWS["corners"] = " UNION ALL ".join(
    f"""SELECT c_custkey AS outline_id, c_custkey % 4 AS scan_id, {i} AS i,
        4.0e0 + c_custkey % 92 + (2.0e0 + c_custkey % 5) * {1.3 if i % 2 else 1.0}e0 * cos({i} * 1.25e0 + 0.1e0) AS x,
        4.0e0 + c_custkey * 7 % 92 + (2.0e0 + c_custkey % 5) * {1.3 if i % 2 else 1.0}e0 * sin({i} * 1.25e0 + 0.1e0) AS y,
        c_acctbal / 1000.0e0 + {i} AS z FROM customer"""
    for i in range(5)
)


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    # zone-less event times are read as UTC, so that time windows start at whole UTC hours
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for table in tables or TABLES:
        source(spark, sf_dir, table).createOrReplaceTempView(table)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One survey table as a lazy DataFrame over the parquet scan."""
    base = VIEWS[name].split("FROM ")[-1].split()[0]
    register(spark, sf_dir, base)
    return spark.sql(VIEWS[name])


def with_views(names: str, body: str) -> str:
    """The oracle text: the named views as common table expressions before ``body``."""
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    parts = [f"{n} AS ({VIEWS[n]})" for n in names.split()]
    if recursive:
        return "WITH RECURSIVE " + ", ".join(parts + [body[len("WITH RECURSIVE "):]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts + [body[5:]])
    return "WITH " + ", ".join(parts) + " " + body
