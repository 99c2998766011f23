"""Registered telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import asof, resample
from ..operators import telemetry as ops
from ..scale import Quantile, grouped, is_hot, lag, ordered
from . import sqltext as q
from .registry import fixed_digits, query
from .views import view, with_views


def r(df, names: str, digits: int = 6):
    """Round the named columns, as the checking SQL does."""
    wanted = set(names.split())
    return df.select(*[fixed_digits(F.col(c), digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


_DIFF = f"""
    d AS (SELECT *, {{t}} - lag({{t}}) OVER w AS gap,
          {q.local_distance('lag(latitude) OVER w', 'lag(longitude) OVER w', 'lag(altitude_m) OVER w',
                            'latitude', 'longitude', 'altitude_m')} AS dist
          FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY {{order}}))
"""

_QUALITY = _DIFF.format(t="time_s_raw", order="sample_id") + """,
    sp AS (SELECT *, CASE WHEN gap > 0 THEN dist / gap END AS speed FROM d),
    st AS (SELECT flight_id, count(*) AS samples,
        arg_max(time_s_raw, sample_id) - arg_min(time_s_raw, sample_id) AS duration_s,
        count(*) FILTER (gap <= 0) AS duplicate_or_reversed_timestamps,
        coalesce(max(gap), 0) AS maximum_sample_gap_s,
        count(horizontal_accuracy_m) + count(vertical_accuracy_m) > 0 AS has_per_sample_accuracy,
        quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) AS median_sample_gap_s,
        quantile_cont(speed, 0.5) AS speed_mps_median, quantile_cont(speed, 0.95) AS speed_mps_p95,
        quantile_cont(dist, 0.95) AS distance_p95_m,
        quantile_cont(horizontal_accuracy_m, 0.5) AS horizontal_accuracy_m_median,
        quantile_cont(vertical_accuracy_m, 0.5) AS vertical_accuracy_m_median
        FROM sp GROUP BY flight_id),
    th AS (SELECT *, greatest(60.0e0, 4 * coalesce(speed_mps_p95, 0)) AS position_jump_speed_threshold_mps,
        greatest(5.0e0, 5 * coalesce(distance_p95_m, 0)) AS position_jump_distance_threshold_m FROM st)
"""

_QUALITY_FIGURES = (
    "duration_s maximum_sample_gap_s median_sample_gap_s speed_mps_median speed_mps_p95 distance_p95_m "
    "horizontal_accuracy_m_median vertical_accuracy_m_median position_jump_speed_threshold_mps "
    "position_jump_distance_threshold_m"
)


@query(
    "telemetry_quality",
    "G1",
    with_views("telemetry", "WITH " + _QUALITY + f"""
    SELECT th.flight_id, samples, duplicate_or_reversed_timestamps, has_per_sample_accuracy,
        {q.rounded(_QUALITY_FIGURES)}, telemetry_gap_count, probable_position_jumps
    FROM th JOIN (SELECT sp.flight_id,
        count(*) FILTER (median_sample_gap_s > 0 AND gap > greatest(2.0e0, 5 * median_sample_gap_s)) AS telemetry_gap_count,
        count(*) FILTER (speed > position_jump_speed_threshold_mps AND dist > position_jump_distance_threshold_m)
            AS probable_position_jumps
        FROM sp JOIN th USING (flight_id) GROUP BY sp.flight_id) c USING (flight_id)"""),
)
def telemetry_quality(spark, sf_dir):
    report, _ = ops.quality(view(spark, sf_dir, "telemetry"), "flight_id", "time_s_raw", ["sample_id"])
    return r(report, _QUALITY_FIGURES)


@query(
    "telemetry_jump_events",
    "G1",
    with_views("telemetry", "WITH " + _QUALITY + """
    SELECT flight_id, round(time_s_raw - gap, 6) AS before_time_s, round(time_s_raw, 6) AS after_time_s,
        round(dist, 6) AS distance_m, round(speed, 6) AS speed_mps
    FROM sp JOIN th USING (flight_id)
    WHERE speed > position_jump_speed_threshold_mps AND dist > position_jump_distance_threshold_m"""),
)
def telemetry_jump_events(spark, sf_dir):
    _, events = ops.quality(view(spark, sf_dir, "telemetry"), "flight_id", "time_s_raw", ["sample_id"])
    return r(events, "before_time_s after_time_s distance_m speed_mps")


_CLIPS = "SELECT flight_id, max(time_s) * (1.0e0 + (flight_id % 4) / 20.0e0) AS video_duration_s FROM telemetry GROUP BY flight_id"


@query(
    "telemetry_preflight",
    "G2 P2",
    with_views("telemetry", f"""WITH clips AS ({_CLIPS}),
    d AS (SELECT *, time_s - lag(time_s) OVER w AS gap, altitude_m - lag(altitude_m) OVER w AS climb,
          {q.haversine('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')} AS flat
          FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY time_s, sample_id)),
    g AS (SELECT flight_id,
        bool_and(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND isfinite(altitude_m)) AS coordinates_valid,
        bool_and(coalesce(gap > 0, true)) AS timestamps_strictly_increasing,
        coalesce(max(gap), 0) AS maximum_time_gap_s, min(time_s) AS first_s, max(time_s) AS last_s,
        coalesce(max(CASE WHEN gap > 0 THEN flat / gap END), 0) AS maximum_horizontal_speed_mps,
        coalesce(max(CASE WHEN gap > 0 THEN abs(climb) / gap END), 0) AS maximum_vertical_speed_mps,
        count(altitude_datum) > 0 AS altitude_datum_declared FROM d GROUP BY flight_id),
    c AS (SELECT g.*, video_duration_s, maximum_time_gap_s <= 5 AS maximum_gap_at_most_5s,
        first_s <= 1 AS starts_within_first_second,
        last_s >= 0.9e0 * video_duration_s AS covers_at_least_90_percent_of_video,
        maximum_horizontal_speed_mps <= 1000 AS horizontal_speed_below_80mps,
        maximum_vertical_speed_mps <= 500 AS vertical_speed_below_30mps FROM g JOIN clips USING (flight_id))
    SELECT flight_id, coordinates_valid, timestamps_strictly_increasing, altitude_datum_declared,
        {q.rounded('maximum_time_gap_s first_s last_s maximum_horizontal_speed_mps maximum_vertical_speed_mps video_duration_s')},
        maximum_gap_at_most_5s, starts_within_first_second, covers_at_least_90_percent_of_video,
        horizontal_speed_below_80mps, vertical_speed_below_30mps,
        coordinates_valid AND timestamps_strictly_increasing AND maximum_gap_at_most_5s AND starts_within_first_second
        AND covers_at_least_90_percent_of_video AND horizontal_speed_below_80mps AND vertical_speed_below_30mps
        AS critical_pass FROM c"""),
)
def telemetry_preflight(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    clips = samples.groupBy("flight_id").agg(
        (F.max("time_s") * (1.0 + F.first(F.col("flight_id") % 4) / 20.0)).alias("video_duration_s")
    )
    return r(
        ops.preflight(samples, clips, "flight_id"),
        "maximum_time_gap_s first_s last_s maximum_horizontal_speed_mps maximum_vertical_speed_mps video_duration_s",
    )


_CLASS_FIGURES = (
    "duration_s area_diagonal_m altitude_range_m altitude_std_m speed_median_mps speed_p95_mps "
    "hover_fraction viewpoint_complexity_ratio"
)


@query(
    "flight_classifier",
    "G3 P3 W2",
    with_views("telemetry", "WITH RECURSIVE " + q.RESAMPLED.format(gap="1.0e0") + f""",
    o AS (SELECT flight_id, latitude AS lat0, longitude AS lon0 FROM ordered_t WHERE rn = 1),
    p AS (SELECT t.*, (longitude - lon0) * (111320.0e0 * cos(radians(lat0))) AS x, (latitude - lat0) * 111320.0e0 AS y
          FROM ordered_t t JOIN o USING (flight_id)),
    shape AS (SELECT flight_id, max(time_s) - min(time_s) AS duration_s,
        sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS area_diagonal_m,
        max(altitude_m) - min(altitude_m) AS altitude_range_m, stddev_pop(altitude_m) AS altitude_std_m
        FROM p GROUP BY flight_id),
    m AS (SELECT p.flight_id, p.rn, p.time_s - lag(p.time_s) OVER w AS dt, p.x - lag(p.x) OVER w AS dx,
          p.y - lag(p.y) OVER w AS dy, p.altitude_m - lag(p.altitude_m) OVER w AS dz
          FROM p JOIN kept USING (flight_id, rn) WINDOW w AS (PARTITION BY p.flight_id ORDER BY p.rn)),
    s AS (SELECT flight_id, sqrt(dx * dx + dy * dy + dz * dz) / dt AS v,
          row_number() OVER (PARTITION BY flight_id ORDER BY sqrt(dx * dx + dy * dy + dz * dz) / dt, rn) AS k,
          count(*) OVER (PARTITION BY flight_id) AS n FROM m WHERE dt IS NOT NULL),
    a AS (SELECT flight_id, max(v) FILTER (k = floor(n / 2) + 1) AS speed_median_mps,
        max(v) FILTER (k = floor(0.95e0 * (n - 1)) + 1) AS speed_p95_mps,
        avg(CASE WHEN v < 0.5e0 THEN 1.0e0 ELSE 0.0e0 END) AS hover_fraction FROM s GROUP BY flight_id),
    j AS (SELECT shape.*, coalesce(speed_median_mps, 0) AS speed_median_mps, coalesce(speed_p95_mps, 0) AS speed_p95_mps,
        coalesce(hover_fraction, 0) AS hover_fraction,
        CASE WHEN area_diagonal_m > 1e-6 THEN altitude_range_m / area_diagonal_m ELSE 0 END AS viewpoint_complexity_ratio
        FROM shape LEFT JOIN a USING (flight_id))
    SELECT flight_id, {q.rounded(_CLASS_FIGURES)},
        CASE WHEN viewpoint_complexity_ratio >= 0.05e0 THEN 'adaptive' ELSE 'geometry' END AS recommended_keyframe_mode,
        CASE WHEN viewpoint_complexity_ratio >= 0.05e0 THEN 'verified-fast-adaptive' ELSE 'verified-fast' END AS recommended_profile,
        120 AS recommended_target_frames, 253 * area_diagonal_m / 507.0e0 > 120 AS coverage_warning FROM j"""),
)
def flight_classifier(spark, sf_dir):
    return r(ops.classify(view(spark, sf_dir, "telemetry"), "flight_id"), _CLASS_FIGURES)


_ASOF = """
    l AS (SELECT f.flight_id, f.frame_id, f.time_s AS t, s.time_s AS lt, s.latitude AS llat, s.longitude AS llon,
          s.altitude_m AS lalt, s.horizontal_accuracy_m AS lh, s.vertical_accuracy_m AS lv, s.position_source AS lp,
          s.altitude_datum AS ld
          FROM frames f ASOF LEFT JOIN telemetry s ON f.flight_id = s.flight_id AND f.time_s >= s.time_s),
    b AS (SELECT l.*, s.time_s AS rt, s.latitude AS rlat, s.longitude AS rlon, s.altitude_m AS ralt,
          s.horizontal_accuracy_m AS rh, s.vertical_accuracy_m AS rv, s.position_source AS rp, s.altitude_datum AS rd
          FROM l ASOF LEFT JOIN telemetry s ON l.flight_id = s.flight_id AND l.t < s.time_s),
    c AS (SELECT *, (t - lt) / (rt - lt) AS ratio FROM b),
    mixed AS (SELECT flight_id, frame_id, t AS time_s,
        CASE WHEN lt IS NULL THEN rlat WHEN rt IS NULL THEN llat ELSE llat + ratio * (rlat - llat) END AS latitude,
        CASE WHEN lt IS NULL THEN rlon WHEN rt IS NULL THEN llon ELSE llon + ratio * (rlon - llon) END AS longitude,
        CASE WHEN lt IS NULL THEN ralt WHEN rt IS NULL THEN lalt ELSE lalt + ratio * (ralt - lalt) END AS altitude_m,
        CASE WHEN lt IS NULL THEN rh WHEN rt IS NULL THEN lh WHEN lh IS NULL THEN rh WHEN rh IS NULL THEN lh
             ELSE lh + ratio * (rh - lh) END AS horizontal_accuracy_m,
        CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL THEN lv WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv
             ELSE lv + ratio * (rv - lv) END AS vertical_accuracy_m,
        CASE WHEN lt IS NULL THEN rp WHEN rt IS NULL THEN lp WHEN ratio < 0.5e0 THEN lp ELSE rp END AS position_source,
        CASE WHEN lt IS NULL THEN rd WHEN rt IS NULL THEN ld WHEN ratio < 0.5e0 THEN ld ELSE rd END AS altitude_datum
        FROM c WHERE lt IS NOT NULL OR rt IS NOT NULL)
"""


def frame_positions(spark, sf_dir):
    return asof.interpolate(
        view(spark, sf_dir, "frames"),
        view(spark, sf_dir, "telemetry"),
        ["flight_id"],
        linear=["latitude", "longitude", "altitude_m"],
        optional=["horizontal_accuracy_m", "vertical_accuracy_m"],
        nearest=["position_source", "altitude_datum"],
    )


@query(
    "frame_position_interpolation",
    "J1",
    with_views("telemetry frames", "WITH " + _ASOF + """
    SELECT flight_id, frame_id, round(time_s, 6) AS time_s, round(latitude, 9) AS latitude,
        round(longitude, 9) AS longitude, round(altitude_m, 6) AS altitude_m,
        round(horizontal_accuracy_m, 6) AS horizontal_accuracy_m, round(vertical_accuracy_m, 6) AS vertical_accuracy_m,
        position_source, altitude_datum FROM mixed"""),
)
def frame_position_interpolation(spark, sf_dir):
    out = r(frame_positions(spark, sf_dir), "latitude longitude", 9)
    return r(r(out, "altitude_m", 6), "time_s horizontal_accuracy_m vertical_accuracy_m")


@query(
    "frame_reference_summary",
    "G9 P22",
    with_views("telemetry frames", "WITH " + _ASOF + """,
    o AS (SELECT flight_id, count(*) AS "references", arg_min(latitude, time_s) AS la, arg_min(longitude, time_s) AS lo,
          arg_min(altitude_m, time_s) AS al FROM mixed GROUP BY flight_id),
    s AS (SELECT flight_id, quantile_cont(horizontal_accuracy_m, 0.5) AS h, quantile_cont(vertical_accuracy_m, 0.5) AS v,
          string_agg(DISTINCT position_source, ',' ORDER BY position_source) AS position_sources,
          string_agg(DISTINCT altitude_datum, '; ' ORDER BY altitude_datum) AS datums FROM telemetry GROUP BY flight_id),
    z AS (SELECT *, CASE WHEN lower(coalesce(datums, '')) LIKE '%offset%' THEN 'offset_applied'
          WHEN lower(coalesce(datums, '')) LIKE '%relative%' THEN 'relative_to_takeoff'
          WHEN lower(coalesce(datums, '')) LIKE '%abs%' THEN 'absolute' ELSE 'unknown' END AS status FROM s)
    SELECT flight_id, "references", round(la, 9) AS origin_latitude, round(lo, 9) AS origin_longitude,
        round(al, 6) AS origin_altitude_m, round(h, 6) AS horizontal_accuracy_m_median,
        round(v, 6) AS vertical_accuracy_m_median, position_sources, coalesce(datums, '') AS datums, status,
        status IN ('absolute', 'offset_applied') AS heights_are_absolute
    FROM o JOIN z USING (flight_id)"""),
)
def frame_reference_summary(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    out = ops.position_uncertainty(samples, frame_positions(spark, sf_dir), "flight_id").join(
        ops.vertical_reference(samples, "flight_id"), "flight_id"
    )
    out = r(out, "origin_latitude origin_longitude", 9)
    return r(out, "origin_altitude_m horizontal_accuracy_m_median vertical_accuracy_m_median")


_PATH = q.RESAMPLED.format(gap="1.0e0") + f""",
    coarse AS (SELECT o.* FROM ordered_t o JOIN (
        SELECT flight_id, rn FROM kept UNION SELECT flight_id, max(rn) FROM ordered_t GROUP BY flight_id) k
        USING (flight_id, rn)),
    stepped AS (SELECT flight_id, sample_id, time_s, coalesce({q.local_distance(
        'lag(latitude) OVER w', 'lag(longitude) OVER w', 'lag(altitude_m) OVER w', 'latitude', 'longitude', 'altitude_m')}, 0.0e0)
        AS step FROM coarse WINDOW w AS (PARTITION BY flight_id ORDER BY time_s, sample_id)),
    path AS (SELECT flight_id, sample_id, time_s, sum(step) OVER (PARTITION BY flight_id ORDER BY time_s, sample_id) AS path_m
             FROM stepped)
"""


@query(
    "flown_path",
    "W3 W2",
    with_views("telemetry", "WITH RECURSIVE " + _PATH + """
    SELECT flight_id, sample_id, round(time_s, 6) AS time_s, round(path_m, 4) AS path_m FROM path"""),
)
def flown_path(spark, sf_dir):
    path = resample.path_table(view(spark, sf_dir, "telemetry"), ["flight_id"])
    return r(r(path, "time_s"), "path_m", 4)


@query(
    "resampled_telemetry",
    "W2",
    with_views("telemetry", "WITH RECURSIVE " + q.RESAMPLED.format(gap="20.0e0") + """
    SELECT o.flight_id, o.sample_id, round(o.time_s, 6) AS time_s FROM ordered_t o JOIN kept USING (flight_id, rn)"""),
)
def resampled_telemetry(spark, sf_dir):
    kept = resample.greedy_resample(view(spark, sf_dir, "telemetry"), ["flight_id"], "time_s", ["sample_id"], 20.0)
    return r(kept.select("flight_id", "sample_id", "time_s"), "time_s")


def frame_distances(spark, sf_dir):
    path = resample.path_table(view(spark, sf_dir, "telemetry"), ["flight_id"])
    return asof.interpolate(view(spark, sf_dir, "frames"), path, ["flight_id"], linear=["path_m"])


_AT_PATH = _PATH + """,
    l AS (SELECT f.flight_id, f.frame_id, f.time_s AS t, s.time_s AS lt, s.path_m AS lv
          FROM frames f ASOF LEFT JOIN path s ON f.flight_id = s.flight_id AND f.time_s >= s.time_s),
    b AS (SELECT l.*, s.time_s AS rt, s.path_m AS rv
          FROM l ASOF LEFT JOIN path s ON l.flight_id = s.flight_id AND l.t < s.time_s),
    at_frame AS (SELECT flight_id, frame_id, t AS time_s, CASE WHEN lt IS NULL THEN rv WHEN rt IS NULL THEN lv
        ELSE lv + (t - lt) / (rt - lt) * (rv - lv) END AS path_m FROM b WHERE lt IS NOT NULL OR rt IS NOT NULL)
"""


@query(
    "frame_path_interpolation",
    "J2",
    with_views("telemetry frames", "WITH RECURSIVE " + _AT_PATH + """
    SELECT flight_id, frame_id, round(time_s, 6) AS time_s, round(path_m, 4) AS path_m FROM at_frame"""),
)
def frame_path_interpolation(spark, sf_dir):
    return r(r(frame_distances(spark, sf_dir), "time_s"), "path_m", 4)


@query(
    "selected_frame_gaps",
    "W1",
    with_views("telemetry frames", "WITH RECURSIVE " + _AT_PATH + """,
    g AS (SELECT flight_id, time_s - lag(time_s) OVER w AS tg, path_m - lag(path_m) OVER w AS pg
          FROM at_frame WINDOW w AS (PARTITION BY flight_id ORDER BY time_s, frame_id))
    SELECT flight_id, round(quantile_cont(tg, 0.5), 6) AS time_gap_median, round(quantile_cont(tg, 0.95), 6) AS time_gap_p95,
        round(max(tg), 6) AS time_gap_max, round(quantile_cont(pg, 0.5), 4) AS path_gap_median,
        round(quantile_cont(pg, 0.95), 4) AS path_gap_p95, round(max(pg), 4) AS path_gap_max FROM g GROUP BY flight_id"""),
)
def selected_frame_gaps(spark, sf_dir):
    at = frame_distances(spark, sf_dir)
    hot = is_hot(at, ["flight_id"])
    gaps = ordered(
        at, ["flight_id"], ["time_s", "frame_id"],
        {"_t": lag(F.col("time_s")), "_p": lag(F.col("path_m"))}, hot=hot,
    ).withColumn("tg", F.col("time_s") - F.col("_t")).withColumn("pg", F.col("path_m") - F.col("_p"))
    out = grouped(
        gaps, ["flight_id"],
        [F.max("tg").alias("time_gap_max"), F.max("pg").alias("path_gap_max")],
        [Quantile("time_gap_median", F.col("tg"), 0.5), Quantile("time_gap_p95", F.col("tg"), 0.95),
         Quantile("path_gap_median", F.col("pg"), 0.5), Quantile("path_gap_p95", F.col("pg"), 0.95)], hot=hot,
    )
    out = r(out, "time_gap_median time_gap_p95 time_gap_max")
    return r(out, "path_gap_median path_gap_p95 path_gap_max", 4)


@query(
    "sample_step_distances",
    "P1 P2 P3",
    with_views("telemetry", f"""
    SELECT flight_id, sample_id,
        round({q.local_distance('lag(latitude) OVER w', 'lag(longitude) OVER w', 'lag(altitude_m) OVER w',
                                'latitude', 'longitude', 'altitude_m')}, 5) AS local_m,
        round({q.haversine('lag(latitude) OVER w', 'lag(longitude) OVER w', 'latitude', 'longitude')}, 5) AS haversine_m,
        round((longitude - first(longitude) OVER w) * 111320.0e0 * cos(radians(first(latitude) OVER w)), 5) AS planar_east_m,
        round((latitude - first(latitude) OVER w) * 110540.0e0, 5) AS planar_north_m
    FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY time_s, sample_id)"""),
)
def sample_step_distances(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    origin = samples.groupBy("flight_id").agg(
        F.min_by(F.struct("latitude", "longitude"), F.struct("time_s", "sample_id")).alias("_o")
    )
    moved = ordered(
        samples, ["flight_id"], ["time_s", "sample_id"], {"_p": lag(F.struct(*ops.POSITION))}
    ).join(origin, "flight_id")
    p, here = F.col("_p"), [F.col(c) for c in ops.POSITION]
    east, north = geo.planar(
        F.col("latitude"), F.col("longitude"), F.col("_o")["latitude"], F.col("_o")["longitude"],
        geo.METRES_PER_DEGREE_LAT,
    )
    out = moved.select(
        "flight_id",
        "sample_id",
        geo.local_distance(p["latitude"], p["longitude"], p["altitude_m"], *here).alias("local_m"),
        geo.haversine(p["latitude"], p["longitude"], here[0], here[1]).alias("haversine_m"),
        east.alias("planar_east_m"),
        north.alias("planar_north_m"),
    )
    return r(out, "local_m haversine_m planar_east_m planar_north_m", 5)
