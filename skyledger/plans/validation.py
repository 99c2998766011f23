"""Registered accuracy and capture queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as tel
from ..operators import validation as ops
from . import sqltext as q
from .registry import query
from .telemetry import _ASOF, _QUALITY, frame_positions, r
from .views import view, with_views

_ERRORS = """
    er AS (SELECT run_id, checkpoint_id, reconstructed_x_m - known_x_m AS ex, reconstructed_y_m - known_y_m AS ey,
        reconstructed_z_m - known_z_m AS ez FROM checkpoints WHERE reconstructed_x_m IS NOT NULL),
    e3 AS (SELECT *, sqrt(ex * ex + ey * ey) AS h, sqrt(ex * ex + ey * ey + ez * ez) AS d FROM er)"""


@query("checkpoint_error_statistics", "G5", with_views("checkpoints", f"""WITH {_ERRORS}
    SELECT run_id, component, count(*) AS "count", round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS standard_deviation,
        round(min(e), 6) AS minimum, round(max(e), 6) AS maximum, round(quantile_cont(e, 0.5), 6) AS median,
        round(quantile_cont(e, 0.95), 6) AS p95
    FROM e3, LATERAL (VALUES ('x_signed', ex), ('y_signed', ey), ('z_signed', ez), ('horizontal', h),
        ('vertical_absolute', abs(ez)), ('three_dimensional', d)) c(component, e) GROUP BY run_id, component"""))
def checkpoint_error_statistics(spark, sf_dir):
    out = ops.error_statistics(view(spark, sf_dir, "checkpoints"), "run_id")
    return r(out, "mean standard_deviation minimum maximum median p95")


_CP = ("rmse_3d_m rmse_x_m rmse_y_m rmse_z_m rmse_horizontal_m bias_x_m bias_y_m bias_z_m maximum_3d_error_m "
       "median_3d_error_m p95_3d_error_m")


@query("checkpoint_report", "G6", with_views("checkpoints", f"""WITH {_ERRORS},
    g AS (SELECT run_id, count(*) AS checks, sqrt(avg(d * d)) AS rmse_3d_m, sqrt(avg(ex * ex)) AS rmse_x_m,
        sqrt(avg(ey * ey)) AS rmse_y_m, sqrt(avg(ez * ez)) AS rmse_z_m, sqrt(avg(h * h)) AS rmse_horizontal_m,
        avg(ex) AS bias_x_m, avg(ey) AS bias_y_m, avg(ez) AS bias_z_m, max(d) AS maximum_3d_error_m,
        quantile_cont(d, 0.5) AS median_3d_error_m, quantile_cont(d, 0.95) AS p95_3d_error_m FROM e3 GROUP BY run_id)
    SELECT run_id, checks, {q.rounded(_CP)}, checks >= 3 AND maximum_3d_error_m <= 1 AS passes_one_metre_target,
        CASE WHEN checks >= 30 THEN 'checkpoint_count_compliant' WHEN checks >= 3 THEN 'reduced_assessment'
             ELSE 'insufficient_checkpoints' END AS checkpoint_count_status FROM g"""))
def checkpoint_report(spark, sf_dir):
    return r(ops.checkpoint_report(view(spark, sf_dir, "checkpoints"), "run_id"), _CP)


# Two thirds of the known points are given on the globe, a few of those without their height.
_ON_GLOBE = """
    SELECT run_id, checkpoint_id, CASE WHEN checkpoint_id % 3 = 0 THEN known_x_m END AS known_x_m, CASE WHEN checkpoint_id % 3 = 0 THEN known_y_m END AS known_y_m,
        CASE WHEN checkpoint_id % 3 < 2 THEN known_z_m END AS known_z_m, 12.001e0 + known_y_m / 111000.0e0 AS known_latitude,
        77.002e0 + known_x_m / 108000.0e0 AS known_longitude, CASE WHEN checkpoint_id % 17 <> 1 THEN 100.0e0 + known_z_m END AS known_altitude_m,
        reconstructed_x_m, reconstructed_y_m, reconstructed_z_m FROM checkpoints"""
_KNOWN = f"""gp AS ({_ON_GLOBE}),
    gx AS (SELECT *, {", ".join(f"{e} AS x{i}" for i, e in enumerate(q.ecef('known_latitude', 'known_longitude', 'known_altitude_m')))},
        {", ".join(f"{e} AS o{i}" for i, e in enumerate(q.ecef('12.001e0', '77.002e0', '100.0e0')))} FROM gp),
    ge AS (SELECT *, {", ".join(f"{e} AS l{i}" for i, e in enumerate(q.enu_from_ecef('(x0 - o0)', '(x1 - o1)', '(x2 - o2)', '12.001e0', '77.002e0')))} FROM gx),
    kp AS (SELECT run_id, checkpoint_id, {", ".join(f"CASE WHEN checkpoint_id % 3 = 0 THEN known_{a}_m ELSE l{i} END AS k{a}, reconstructed_{a}_m AS r{a}" for i, a in enumerate("xyz"))} FROM ge),
    ke AS (SELECT *, rx - kx AS ex, ry - ky AS ey, rz - kz AS ez FROM kp WHERE kx + ky + kz + rx + ry + rz IS NOT NULL)"""


@query("geodetic_checkpoint_report", "G6 P4", with_views("checkpoints", f"""WITH {_KNOWN}
    SELECT run_id, count(*) AS checks, round(sqrt(avg(ex * ex + ey * ey + ez * ez)), 4) AS rmse_3d_m, round(avg(ex), 4) AS bias_x_m, round(avg(ey), 4) AS bias_y_m,
        round(avg(ez), 4) AS bias_z_m, round(max(sqrt(ex * ex + ey * ey + ez * ez)), 4) AS maximum_3d_error_m FROM ke GROUP BY run_id"""))
def geodetic_checkpoint_report(spark, sf_dir):
    view(spark, sf_dir, "checkpoints").createOrReplaceTempView("checkpoints")
    known = ops.geodetic_known(spark.sql(_ON_GLOBE), (12.001, 77.002, 100.0))
    out = ops.checkpoint_report(known, "run_id")
    return r(out.select("run_id", "checks", "rmse_3d_m", "bias_x_m", "bias_y_m", "bias_z_m", "maximum_3d_error_m"), "rmse_3d_m bias_x_m bias_y_m bias_z_m maximum_3d_error_m", 4)


@query("checkpoint_uncertainty", "G6", with_views("checkpoints", """
    WITH u AS (SELECT run_id, CASE WHEN checkpoint_id % 3 = 0 THEN NULL ELSE (checkpoint_id % 10) / 100.0e0 END AS a,
        (checkpoint_id % 7) / 50.0e0 AS b, CASE WHEN checkpoint_id % 4 = 0 THEN (checkpoint_id % 9) / 40.0e0 END AS v FROM checkpoints)
    SELECT run_id, component, count(*) AS "count", round(avg(x), 6) AS mean, round(max(x), 6) AS maximum
    FROM u, LATERAL (VALUES ('horizontal', coalesce(a, b)), ('vertical', v)) m(component, x) WHERE x IS NOT NULL GROUP BY run_id, component"""))
def checkpoint_uncertainty(spark, sf_dir):
    k = F.col("checkpoint_id")
    points = view(spark, sf_dir, "checkpoints").select(
        "run_id", F.when(k % 3 != 0, k % 10 / 100.0).alias("horizontal_uncertainty_m"),
        (k % 7 / 50.0).alias("horizontal_accuracy_m"), F.when(k % 4 == 0, k % 9 / 40.0).alias("survey_vertical_uncertainty_m"),
    )
    given = points.select("run_id", F.explode(ops.uncertainty_map(points)).alias("component", "x"))
    out = given.groupBy("run_id", "component").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.max("x").alias("maximum"))
    return r(out, "mean maximum")


@query("distance_report", "G7", with_views("checkpoints", """
    WITH d AS (SELECT run_id, sqrt((reconstructed_x_m - known_x_m) * (reconstructed_x_m - known_x_m)
        + (reconstructed_y_m - known_y_m) * (reconstructed_y_m - known_y_m) + (reconstructed_z_m - known_z_m) * (reconstructed_z_m - known_z_m))
        - (checkpoint_id % 5) / 10.0e0 AS e FROM checkpoints WHERE reconstructed_x_m IS NOT NULL)
    SELECT run_id, count(*) AS checks, round(sqrt(avg(e * e)), 6) AS distance_rmse_m, round(max(abs(e)), 6) AS maximum_absolute_error_m,
        max(abs(e)) <= 1 AS passes_one_metre_target FROM d GROUP BY run_id"""))
def distance_report(spark, sf_dir):
    rows = view(spark, sf_dir, "checkpoints").dropna(subset=["reconstructed_x_m"]).select(
        "run_id", *[F.col(f"known_{a}_m").alias(f"{a}1_m") for a in "xyz"],
        *[F.col(f"reconstructed_{a}_m").alias(f"{a}2_m") for a in "xyz"],
        (F.col("checkpoint_id") % 5 / 10.0).alias("known_distance_m"),
    )
    return r(ops.distance_report(rows, "run_id"), "distance_rmse_m maximum_absolute_error_m")


_CX = [f"(x{i} - o{i})" for i in range(3)]
_ECEF, _ECEF0 = q.ecef("latitude", "longitude", "altitude_m"), q.ecef("la", "lo", "al")
_E, _N, _U = q.enu_from_ecef(*_CX, "la", "lo")
_GPS = _ASOF + f""",
    o AS (SELECT flight_id, arg_min(latitude, time_s) AS la, arg_min(longitude, time_s) AS lo, arg_min(altitude_m, time_s) AS al
          FROM mixed GROUP BY flight_id),
    xyz AS (SELECT mixed.*, la, lo, {", ".join(f"{e} AS x{i}" for i, e in enumerate(_ECEF))},
        {", ".join(f"{e} AS o{i}" for i, e in enumerate(_ECEF0))} FROM mixed JOIN o USING (flight_id)),
    res AS (SELECT flight_id, frame_id, horizontal_accuracy_m AS h, vertical_accuracy_m AS v,
        (frame_id % 613) * 1.08e0 - {_E} AS e, (frame_id % 997) * 1.1e0 - {_N} AS n, (frame_id % 17) * 1.0e0 - {_U} AS u FROM xyz),
    rs AS (SELECT *, sqrt(e * e + n * n + u * u) AS d,
        CASE WHEN h > 0 AND v > 0 THEN sqrt(e / h * (e / h) + n / h * (n / h) + u / v * (u / v)) END AS s FROM res)
"""


def _residuals(spark, sf_dir):
    k = F.col("frame_id")
    cameras = view(spark, sf_dir, "frames").select(
        "flight_id", "frame_id", (k % 613 * 1.08).alias("cx"), (k % 997 * 1.1).alias("cy"), (k % 17 * 1.0).alias("cz")
    )
    return ops.camera_residuals(frame_positions(spark, sf_dir), cameras, "flight_id")


@query("camera_gps_residuals", "G8 P4 J3", with_views("telemetry frames", f"""WITH {_GPS}
    SELECT flight_id, frame_id, round(e, 4) AS east_m, round(n, 4) AS north_m, round(u, 4) AS up_m, round(d, 4) AS residual_m,
        round(s, 3) AS residual_sigma FROM rs"""))
def camera_gps_residuals(spark, sf_dir):
    out = _residuals(spark, sf_dir).select(
        "flight_id", "frame_id", "east_m", "north_m", "up_m", "residual_m", "residual_sigma"
    )
    return r(r(out, "east_m north_m up_m residual_m", 4), "residual_sigma", 3)


_GF = "rmse_m rmse_east_m rmse_north_m rmse_up_m median_m p95_m"


@query("camera_gps_report", "G8", with_views("telemetry frames", f"""WITH {_GPS},
    g AS (SELECT flight_id, count(*) AS matched_cameras, sqrt(avg(d * d)) AS rmse_m, sqrt(avg(e * e)) AS rmse_east_m,
        sqrt(avg(n * n)) AS rmse_north_m, sqrt(avg(u * u)) AS rmse_up_m, quantile_cont(d, 0.5) AS median_m,
        quantile_cont(d, 0.95) AS p95_m, quantile_cont(s, 0.5) AS median_sigma FROM rs GROUP BY flight_id)
    SELECT flight_id, matched_cameras, {q.rounded(_GF, 4)}, round(median_sigma, 3) AS median_sigma FROM g"""))
def camera_gps_report(spark, sf_dir):
    return r(r(ops.gps_report(_residuals(spark, sf_dir), "flight_id"), _GF, 4), "median_sigma", 3)


@query("frame_registration", "J3", with_views("frames", """
    SELECT flight_id, count(*) AS selected, count(*) FILTER (frame_id % 7 <> 0) AS registered,
        count(*) FILTER (frame_id % 7 = 0) AS missing, round(100 * count(*) FILTER (frame_id % 7 <> 0) / count(*), 6) AS registration_percent
    FROM frames GROUP BY flight_id"""))
def frame_registration(spark, sf_dir):
    frames = view(spark, sf_dir, "frames").withColumn("image_name", F.concat(F.lit("frame_"), F.col("frame_id").cast("string"), F.lit(".jpg")))
    cameras = frames.filter("frame_id % 7 <> 0").select("flight_id", "image_name")
    return r(ops.registration(frames, cameras, "flight_id", "image_name"), "registration_percent")


_CAP = "sharpness_median blurred_fraction poor_exposure_fraction low_overlap_fraction near_duplicate_fraction"


@query("capture_gates", "G4 G1", with_views("telemetry frames", "WITH " + _QUALITY + f""",
    tq AS (SELECT th.*, telemetry_gap_count, probable_position_jumps FROM th JOIN (SELECT sp.flight_id,
        count(*) FILTER (median_sample_gap_s > 0 AND gap > greatest(2.0e0, 5 * median_sample_gap_s)) AS telemetry_gap_count,
        count(*) FILTER (speed > position_jump_speed_threshold_mps AND dist > position_jump_distance_threshold_m) AS probable_position_jumps
        FROM sp JOIN th USING (flight_id) GROUP BY sp.flight_id) USING (flight_id)),
    rd AS (SELECT *, coalesce(CASE WHEN frame_id % 401 = 7 THEN NULL ELSE frame_id % 211 <> 3 END, false) AS seen FROM frames),
    md AS (SELECT flight_id, quantile_cont(sharpness, 0.5) FILTER (seen) AS med, arg_min(frame_id, (time_s, frame_id)) AS first_id FROM rd GROUP BY flight_id),
    fm AS (SELECT rd.*, med, frame_id <> first_id AS linked FROM rd JOIN md USING (flight_id)),
    cal AS (SELECT DISTINCT flight_id, CASE WHEN flight_id % 11 = 5 THEN NULL ELSE flight_id % 4 = 1 END AS steady,
        CASE WHEN flight_id % 7 = 2 THEN NULL WHEN flight_id % 3 = 0 THEN 18.0e0 ELSE 4.0e0 END AS readout FROM telemetry WHERE flight_id % 5 <> 0),
    sh AS (SELECT flight_id, count(*) AS frames, count(*) FILTER (NOT seen) AS unreadable_frames, coalesce(any_value(med), 0) AS sharpness_median,
        coalesce(avg(CASE WHEN sharpness < greatest(25.0e0, 0.25e0 * med) THEN 1.0e0 ELSE 0.0e0 END) FILTER (seen), 0) AS blurred_fraction,
        coalesce(avg(CASE WHEN (frame_id % 31) / 100.0e0 > 0.2e0 OR (frame_id % 29) / 100.0e0 > 0.2e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (seen), 0) AS poor_exposure_fraction,
        coalesce(avg(CASE WHEN tracked_fraction < 0.35e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (linked), 0) AS low_overlap_fraction,
        coalesce(avg(CASE WHEN parallax_px < 0.5e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (linked), 0) AS near_duplicate_fraction
        FROM fm GROUP BY flight_id),
    gt AS (SELECT sh.*, unreadable_frames = 0 AS readable_ok, cal.flight_id IS NULL OR coalesce(NOT steady, false) AS stabilisation_ok, blurred_fraction <= 0.1e0 AS blur_ok, poor_exposure_fraction <= 0.1e0 AS exposure_ok,
        low_overlap_fraction <= 0.1e0 AS overlap_ok, near_duplicate_fraction <= 0.25e0 AS parallax_ok,
        duplicate_or_reversed_timestamps = 0 AS timestamps_ok, telemetry_gap_count = 0 AND probable_position_jumps = 0 AS telemetry_ok,
        NOT (coalesce(readout, 0) > 10 AND coalesce(speed_mps_p95, 0) > 8) AS shutter_ok FROM sh JOIN tq USING (flight_id) LEFT JOIN cal USING (flight_id))
    SELECT flight_id, frames, unreadable_frames, {q.rounded(_CAP)}, readable_ok, blur_ok, exposure_ok, overlap_ok, parallax_ok, timestamps_ok, telemetry_ok,
        stabilisation_ok, shutter_ok, readable_ok AND stabilisation_ok AND blur_ok AND exposure_ok AND overlap_ok AND parallax_ok AND timestamps_ok AND telemetry_ok AND shutter_ok AS ready,
        concat_ws(' ', """ + ", ".join(f"CASE WHEN NOT {g} THEN '{t}' END" for g, t in ops.ADVICE.items()) + """) AS recommendations FROM gt"""))
def capture_gates(spark, sf_dir):
    report, _ = tel.quality(view(spark, sf_dir, "telemetry"), "flight_id", "time_s_raw", ["sample_id"])
    frames = view(spark, sf_dir, "frames").withColumn("clipped_dark", F.col("frame_id") % 31 / 100.0).withColumn(
        "clipped_bright", F.col("frame_id") % 29 / 100.0
    ).withColumn("readable", F.when(F.col("frame_id") % 401 == 7, F.lit(None)).otherwise(F.col("frame_id") % 211 != 3))
    clip = F.col("flight_id")
    calibrations = view(spark, sf_dir, "telemetry").select("flight_id").distinct().filter("flight_id % 5 <> 0").select(
        "flight_id", F.when(clip % 11 == 5, F.lit(None)).otherwise(clip % 4 == 1).alias("digital_stabilization"),
        F.when(clip % 7 == 2, F.lit(None)).when(clip % 3 == 0, 18.0).otherwise(4.0).alias("readout_ms"),
    )
    return r(ops.capture_gates(frames, report, "flight_id", calibrations), _CAP)


@query("frame_funnel", "G28", with_views("telemetry frames", """
    WITH c AS (SELECT flight_id, count(*) AS source_frames, count(*) FILTER (sample_id % 3 = 0) AS sampled_frames,
        count(*) FILTER (sample_id % 3 = 0 AND sample_id % 7 <> 0) AS processed_frames,
        count(*) FILTER (sample_id % 3 = 0 AND sample_id % 7 <> 0 AND sample_id % 5 <> 0) AS valid_depth_frames FROM telemetry GROUP BY flight_id)
    SELECT flight_id, stage, n AS frames, round(100 * n / source_frames, 6) AS percent_of_source
    FROM c, LATERAL (VALUES ('source', source_frames), ('sampled', sampled_frames), ('processed', processed_frames),
        ('valid_depth', valid_depth_frames)) s(stage, n)"""))
def frame_funnel(spark, sf_dir):
    k = F.col("sample_id")
    sampled = k % 3 == 0
    processed = sampled & (k % 7 != 0)
    counts = view(spark, sf_dir, "telemetry").groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("source"), F.count_if(sampled).alias("sampled"), F.count_if(processed).alias("processed"),
        F.count_if(processed & (k % 5 != 0)).alias("valid_depth"),
    ).withColumn("_whole", F.col("source"))
    long = counts.unpivot(["flight_id", "_whole"], ["source", "sampled", "processed", "valid_depth"], "stage", "frames")
    return r(long.withColumn("percent_of_source", 100 * F.col("frames") / F.col("_whole")).drop("_whole"), "percent_of_source")
