"""Small cases with known answers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.functions import camera, geo, text
from skyledger.operators import asof, coverage, depth, similarity, suppression, telemetry, terrain, validation, windows
from skyledger.sources import models, telemetry as src


def samples(spark, rows):
    schema = ("flight_id int, sample_id bigint, time_s double, latitude double, longitude double, altitude_m double, "
              "horizontal_accuracy_m double, vertical_accuracy_m double, altitude_datum string, position_source string")
    return spark.createDataFrame([(1, i, *map(float, r), None, None, None, None) for i, r in enumerate(rows)], schema)


def test_interpolation_at_the_middle_and_outside(spark):
    s = samples(spark, [(0, 10, 20, 100), (2, 12, 24, 120)])
    probes = spark.createDataFrame([(1, 0, 1.0), (1, 1, -5.0), (1, 2, 9.0)], "flight_id int, frame_id bigint, time_s double")
    got = {r.frame_id: (r.latitude, r.longitude, r.altitude_m) for r in asof.interpolate(
        probes, s, ["flight_id"], ["latitude", "longitude", "altitude_m"]).collect()}
    assert got == {0: (11.0, 22.0, 110.0), 1: (10.0, 20.0, 100.0), 2: (12.0, 24.0, 120.0)}


def test_subtitle_altitude_priority(spark):
    blocks = [(f"{i + 1}\n00:00:0{i},000 --> 00:00:0{i},900\n[latitude: 1.5] [longitude: 2.5] [rel_alt: 5 abs_alt: {100 + i}]",) for i in range(3)]
    got = src.parse_subtitles(spark.createDataFrame(blocks, "block string")).orderBy("time_s").collect()
    assert [(r.time_s, r.altitude_m) for r in got] == [(0.0, 100.0), (1.0, 101.0), (2.0, 102.0)]


def test_pose_clock_in_microseconds(spark):
    poses = spark.createDataFrame([(1, i, t) for i, t in enumerate((5e6, 6e6, 7e6))], "seq int, n int, raw_time double")
    clips = spark.createDataFrame([(1, 2.0)], "seq int, video_duration_s double")
    got = src.normalise_pose_times(poses, clips, "seq", "n").orderBy("n").collect()
    assert [round(r.time_s, 9) for r in got] == [0.0, 1.0, 2.0] and got[0].scale == 1e-6


def test_geodetic_round_trip(spark):
    one = spark.createDataFrame([(30.5, 114.3, 42.0)], "lat0 double, lon0 double, h0 double")
    x, y, z = geo.enu_to_ecef(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("lat0"), F.col("lon0"), F.col("h0"))
    got = geo.with_geodetic(one, x, y, z).first()
    assert np.allclose((got.lat, got.lon, got.height), (30.5, 114.3, 42.0), atol=1e-7)


def test_utm_of_a_known_place(spark):
    # the zone's central meridian on the equator is the false origin
    e, n = geo.utm(F.lit(0.0), F.lit(3.0))
    got = spark.range(1).select(e.alias("e"), n.alias("n"), geo.mgrs(F.lit(0.0), F.lit(3.0), e, n).alias("m")).first()
    assert math.isclose(got.e, 500000.0, abs_tol=1e-6) and math.isclose(got.n, 0.0, abs_tol=1e-6)
    assert got.m == "31N EA 00000 00000"


def test_fast_steady_flight_has_no_jump_and_a_teleport_one(spark):
    steady = [(i / 30, 12 + i * 1.3 / 111320, 77, 100) for i in range(120)]
    report, _ = telemetry.quality(samples(spark, steady), "flight_id", "time_s", ["sample_id"])
    assert report.first().probable_position_jumps == 0
    slow = [(i * 0.1, 12 + i * 1e-6, 77, 100) for i in range(40)] + [(4.0, 12.02, 77, 100)]
    report, events = telemetry.quality(samples(spark, slow), "flight_id", "time_s", ["sample_id"])
    assert report.first().probable_position_jumps == 1 and events.count() == 1


def test_preflight_on_repeated_times(spark):
    s = samples(spark, [(0, 1, 1, 1), (0, 1, 1, 1), (10, 1, 1, 1)])
    clips = spark.createDataFrame([(1, 10.0)], "flight_id int, video_duration_s double")
    got = telemetry.preflight(s, clips, "flight_id").first()
    assert not got.timestamps_strictly_increasing and not got.maximum_gap_at_most_5s


def test_classifier_reads_through_slow_position_updates(spark):
    rows = [(i / 60, 12 + (i // 12) * 2 / 111320, 77, 50) for i in range(1200)]
    got = telemetry.classify(samples(spark, rows), "flight_id").first()
    assert abs(got.speed_median_mps - 10) <= 1 and got.hover_fraction < 0.1


def test_climbing_orbit_is_adaptive(spark):
    rows = [(i, 12 + 100 * math.sin(i / 10) / 111320, 77 + 100 * math.cos(i / 10) / 111320, 60 * i / 120) for i in range(121)]
    got = telemetry.classify(samples(spark, rows), "flight_id").first()
    assert got.viewpoint_complexity_ratio >= 0.05 and got.recommended_keyframe_mode == "adaptive"


def test_checkpoint_errors(spark):
    rows = [(1, "a", 0.2, 0.0, 0.0), (1, "b", 0.0, 0.3, 0.0), (1, "c", 0.0, 0.0, 0.4), (1, "d", None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "run_id int, id string, reconstructed_x_m double, reconstructed_y_m double, reconstructed_z_m double")
    for a in "xyz":
        points = points.withColumn(f"known_{a}_m", F.lit(0.0))
    got = validation.checkpoint_report(points, "run_id").first()
    assert got.checks == 3 and math.isclose(got.p95_3d_error_m, 0.39) and math.isclose(got.rmse_x_m, math.sqrt(0.04 / 3))
    stats = {r.component: r for r in validation.error_statistics(points, "run_id").collect()}
    assert math.isclose(stats["three_dimensional"].standard_deviation, math.sqrt(2 / 300))


def test_uncertainty_must_not_be_negative(spark):
    bad = spark.createDataFrame([(-1.0,)], "x_uncertainty_m double")
    with pytest.raises(Exception, match="finite and not negative"):
        bad.select(validation.uncertainty_map(bad)).collect()


def test_windows_cover_all_frames(spark):
    plan = windows.window_plan(spark.createDataFrame([(1, 65), (2, 5)], "s int, n int"), "s", 16, 4).collect()
    long = sorted((r.start, r.end) for r in plan if r.s == 1)
    assert long[0][0] == 0 and long[-1][1] == 65
    assert all(a[1] - b[0] == 4 for a, b in zip(long, long[1:]))
    assert [(r.start, r.end) for r in plan if r.s == 2] == [(0, 5)]
    with pytest.raises(ValueError):
        windows.window_plan(spark.createDataFrame([(1, 5)], "s int, n int"), "s", 4, 4)


def test_point_budget_is_exact(spark):
    counts = spark.createDataFrame([(1, f, 120) for f in range(4)], "seq int, frame int, valid bigint")
    assert depth.point_budget(counts, "seq", "frame", 37).agg(F.sum("take")).first()[0] == 37


def test_bridge_keeps_the_last_good_frame(spark):
    frames = spark.createDataFrame([(1, i, float(i), 0.0, 1.0) for i in range(6)], "v int, idx bigint, time_s double, path_m double, sharpness double")
    pairs = [(1, a, b, abs(a - b) <= 2 and b != 5, 0.0) for a in range(6) for b in range(a + 1, 6)]
    links = spark.createDataFrame(pairs, "v int, a bigint, b bigint, verified boolean, motion double")
    got = coverage.bridge_selection(frames, links, "v").orderBy("idx").collect()
    assert 2 in [r.idx for r in got] and got[-1].idx == 5
    assert "unresolved_visual_break" in {r.reason for r in got}


def test_hole_filling_leaves_a_bare_corner(spark):
    grid = spark.createDataFrame([(1, 3, 3)], "g int, width bigint, height bigint")
    cells = [(1, c, r, float(c + r)) for c in range(3) for r in range(3) if (c, r) not in ((0, 0), (1, 1))]
    filled = terrain.fill_holes(spark.createDataFrame(cells, "g int, col bigint, row bigint, z double"), grid, ["g"], passes=1)
    keys = {(r.col, r.row) for r in filled.collect()}
    assert (1, 1) in keys and (0, 0) not in keys


def test_footprint_coverage_of_an_l_shape(spark):
    cells = spark.range(80 * 80).select(F.lit(1).alias("g"), (F.col("id") % 80).alias("col"), F.floor(F.col("id") / 80).alias("row"))
    shape = cells.filter("col < 40 or row < 40")
    whole = terrain.footprint_coverage(shape, ["g"], 5.0).first().fraction
    holed = terrain.footprint_coverage(shape.filter("not (col between 4 and 30 and row between 4 and 30)"), ["g"], 5.0).first().fraction
    assert whole > 0.97 and holed < 0.9


def known_pairs(spark, n=60, outliers=0):
    rng = np.random.default_rng(3)
    a = rng.uniform(-10, 10, (n, 3))
    angle, t = 0.17, np.array([0.4, -0.2, 0.7])
    r = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    b = 1.25 * a @ r.T + t
    b[:outliers] += 40.0
    return spark.createDataFrame([(1, i, *map(float, p), *map(float, q), 1.0) for i, (p, q) in enumerate(zip(a, b))],
                                 "g int, item int, x_a double, y_a double, z_a double, x_b double, y_b double, z_b double, weight double"), r, t


def check_fit(f, r, t, tolerance=1e-4):
    assert abs(f.s - 1.25) < tolerance and np.allclose(np.reshape(f.r, (3, 3)), r, atol=tolerance) and np.allclose(f.t, t, atol=tolerance)


def test_known_similarity_is_recovered(spark):
    pairs, r, t = known_pairs(spark)
    check_fit(similarity.fit(pairs, ["g"], F.col("weight")).first().fit, r, t)
    assert similarity.fit(pairs, ["g"], mode="rigid").first().fit.s == 1.0


def test_robust_fits_shed_outliers(spark):
    pairs, r, t = known_pairs(spark, 80, 8)
    trimmed = similarity.trimmed_fit(pairs, ["g"]).first()
    check_fit(trimmed.fit, r, t)
    assert trimmed.trusted and trimmed.inliers == 72
    check_fit(similarity.quantile_fit(pairs, ["g"]).first().fit, r, t)
    rows = similarity.consensus_fit(pairs, ["g"], "item", 0.5).collect()
    check_fit(rows[0].fit, r, t)
    assert {x["item"] for x in rows if not x.inlier} == set(range(8))
    check_fit(similarity.huber_fit(pairs, ["g"], 0.01, rounds=25).first().fit, r, t, 0.05)


def test_degenerate_points_give_no_fit(spark):
    pairs, _, _ = known_pairs(spark, 10)
    flat = pairs.withColumn("x_a", F.lit(1.0)).withColumn("y_a", F.lit(1.0)).withColumn("z_a", F.lit(1.0))
    assert not similarity.fit(flat, ["g"]).first().fit.ok


def test_prefix_products_do_not_depend_on_blocks(spark):
    steps = spark.range(50).select(F.lit(1).alias("s"), F.col("id").alias("k"), F.cos(F.col("id") * 0.1).alias("qw"), F.lit(0.0).alias("qx"),
                                   F.sin(F.col("id") * 0.1).alias("qy"), F.lit(0.0).alias("qz"), F.lit(1.0).alias("tx"), F.lit(0.5).alias("ty"), F.lit(0.0).alias("tz"))
    steps = steps.withColumnRenamed("s", "seq").withColumn("s", F.lit(1.01))
    a = similarity.prefix_products(steps, "seq", "k", 50).orderBy("k").toPandas().to_numpy()
    b = similarity.prefix_products(steps, "seq", "k", 7).orderBy("k").toPandas().to_numpy()
    assert np.allclose(a.astype(float), b.astype(float), atol=1e-9)


def test_quaternion_round_trip_in_all_branches(spark):
    rng = np.random.default_rng(9)
    q = rng.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q *= np.where(q[:, :1] < 0, -1, 1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in q], "w double, x double, y double, z double")
    back = camera.quaternion(camera.rotation(*[F.col(c) for c in "wxyz"]))
    got = df.select("w", "x", "y", "z", *[b.alias(f"b{i}") for i, b in enumerate(back)]).toPandas().to_numpy()
    assert np.allclose(got[:, :4], got[:, 4:], atol=1e-9)


def test_loop_suppression_by_hand(spark):
    pairs = spark.createDataFrame([(1, 100, 200, 0.9), (1, 103, 400, 0.8), (1, 150, 205, 0.7), (1, 300, 500, 0.6)], "s int, i bigint, j bigint, score double")
    got = {(r.later, r.earlier) for r in suppression.suppress_loop_pairs(pairs, "s", 10).collect()}
    assert got == {(200, 100), (500, 300)}


def test_deadlines(spark):
    d = F.greatest(F.lit(3.5), 1.5 * F.col("s") / 60)
    assert [r[0] for r in spark.createDataFrame([(600.0,), (1200.0,), (120.0,)], "s double").select(d).collect()] == [15.0, 30.0, 3.5]


def test_report_with_trailing_commas(spark):
    docs = spark.createDataFrame([('{"a": {"b": [1, 2, ], }, }',), ("not json",)], "value string")
    got = models.parse_reports(docs).select(models.first_path("bigint", "$.missing", "$.a.b[1]").alias("v")).collect()
    assert [r.v for r in got] == [2]


def test_formats(spark):
    row = spark.range(1).select(text.length(F.lit(12345.0)), text.length(F.lit(1234.0)), text.duration(F.lit(125.4)), text.percent(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("12.3 km", "1.23 km", "2:05 min", "—")
