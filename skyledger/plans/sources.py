"""Registered source and table-assembly queries. Files are written by Spark, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import telemetry as src
from . import sqltext as q
from .registry import query
from .telemetry import r
from .views import view, with_views


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def _csv_telemetry(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    path = scratch(spark, "telemetry")
    samples.select(
        "flight_id",
        F.col("time_s").alias("Timestamp_S"),
        F.when(F.col("sample_id") % 31 != 0, F.col("latitude").cast("string")).otherwise("no fix").alias("GPS.Lat"),
        F.col("longitude").alias("gps_longitude"),
        F.col("altitude_m").alias("alt_m(MSL)"),
        F.col("horizontal_accuracy_m").alias("eph_m"),
        F.col("position_source").alias("fix_type"),
    ).write.option("header", True).csv(path)
    return src.read_csv(spark, path, keep=("flight_id",)).withColumn("flight_id", F.col("flight_id").cast("bigint"))


@query("telemetry_csv", "S1", with_views("telemetry", """
    SELECT flight_id, round(time_s, 6) AS time_s, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude,
        round(altitude_m, 6) AS altitude_m, CAST(NULL AS DOUBLE) AS yaw_deg, CAST(NULL AS DOUBLE) AS pitch_deg,
        CAST(NULL AS DOUBLE) AS roll_deg, round(horizontal_accuracy_m, 6) AS horizontal_accuracy_m,
        CAST(NULL AS DOUBLE) AS vertical_accuracy_m, position_source, 'absolute (alt_m(msl))' AS altitude_datum
    FROM telemetry WHERE sample_id % 31 <> 0"""))
def telemetry_csv(spark, sf_dir):
    return r(r(_csv_telemetry(spark, sf_dir), "latitude longitude", 9), "time_s altitude_m horizontal_accuracy_m")


@query("telemetry_loaded", "S3", with_views("telemetry", """
    WITH k AS (SELECT * FROM telemetry WHERE sample_id % 31 <> 0),
    n AS (SELECT flight_id FROM k GROUP BY flight_id HAVING count(*) >= 3)
    SELECT flight_id, round(time_s, 6) AS time_s, round(altitude_m + 12.5e0, 6) AS altitude_m,
        'absolute (alt_m(msl)) + offset 12.5 m' AS altitude_datum FROM k WHERE flight_id IN (SELECT flight_id FROM n)"""))
def telemetry_loaded(spark, sf_dir):
    out = src.load(_csv_telemetry(spark, sf_dir), "flight_id", 12.5)
    return r(out.select("flight_id", "time_s", "altitude_m", "altitude_datum"), "time_s altitude_m")


def subtitle_text(samples):
    """One subtitle block per sample, in five styles; style 4 has no position."""
    whole = F.floor(F.col("time_s")).cast("int")
    stamp = F.format_string(
        "%02d:%02d:%02d,%03d", (whole / 3600).cast("int"), (whole % 3600 / 60).cast("int"), whole % 60,
        F.rint((F.col("time_s") - whole) * 1000).cast("int"),
    )
    lat, lon, alt = [F.format_string("%.7f", F.col(c)) for c in ("latitude", "longitude", "altitude_m")]
    style = F.col("sample_id") % 5
    body = (
        F.when(style == 0, F.concat(F.lit("[latitude: "), lat, F.lit("] [longitude: "), lon,
                                    F.lit("] [rel_alt: 5.0 abs_alt: "), alt, F.lit("]")))
        .when(style == 1, F.concat(F.lit("[latitude: "), lat, F.lit("] [longtitude: "), lon, F.lit("] [rel_alt: "), alt, F.lit("]")))
        .when(style == 2, F.concat(F.lit("lat=" ), lat, F.lit(" lng="), lon, F.lit(" Altitude : "), alt))
        .when(style == 3, F.concat(F.lit("GPS ("), lat, F.lit(", "), lon, F.lit(", "), alt, F.lit(")")))
        .otherwise(F.lit("no fix"))
    )
    return F.concat(F.col("sample_id").cast("string"), F.lit("\n"), stamp, F.lit(" --> "), stamp, F.lit("\n"), body)


@query("telemetry_subtitles", "S2", with_views("telemetry", """
    SELECT sample_id, round(time_s, 3) AS time_s, round(latitude, 7) AS latitude, round(longitude, 7) AS longitude,
        round(altitude_m, 7) AS altitude_m, CASE sample_id % 5 WHEN 0 THEN 'absolute (drone abs_alt)'
        WHEN 1 THEN 'relative_to_takeoff' END AS altitude_datum FROM telemetry WHERE sample_id % 5 <> 4"""))
def telemetry_subtitles(spark, sf_dir):
    path = scratch(spark, "subtitles")
    samples = view(spark, sf_dir, "telemetry")
    samples.select(subtitle_text(samples).alias("value")).write.option("lineSep", "\n\n").text(path)
    parsed = src.read_subtitles(spark, path)
    number = F.regexp_extract("block", r"^(\d+)", 1).cast("bigint")
    out = parsed.select(number.alias("sample_id"), "time_s", "latitude", "longitude", "altitude_m", "altitude_datum")
    return r(r(out, "time_s", 3), "latitude longitude altitude_m", 7)


def _flight_record(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    raw = samples.select(
        "flight_id", "sample_id",
        F.col("time_s").cast("string").alias("OSD.flyTime [s]"),
        F.when(F.col("sample_id") % 53 == 0, "0").otherwise(F.col("latitude").cast("string")).alias("OSD.latitude"),
        F.when(F.col("sample_id") % 53 == 0, "0").otherwise(F.col("longitude").cast("string")).alias("OSD.longitude"),
        (F.col("altitude_m") * 4).cast("string").alias("OSD.altitude [ft]"),
        F.when(F.col("is_recording"), "True").otherwise("False").alias("CAMERA.isVideo"),
    )
    return src.flight_record(raw, "flight_id", "sample_id")


_ISLANDS = """
    rec AS (SELECT flight_id, sample_id, time_s AS fly_s, latitude, longitude, altitude_m * 4 * 0.3048e0 AS altitude_m, is_recording AS recording
            FROM telemetry WHERE sample_id % 53 <> 0),
    mk AS (SELECT *, CASE WHEN recording AND NOT coalesce(lag(recording) OVER w, false) THEN 1 ELSE 0 END AS nw
           FROM rec WINDOW w AS (PARTITION BY flight_id ORDER BY sample_id)),
    isl AS (SELECT *, sum(nw) OVER (PARTITION BY flight_id ORDER BY sample_id) AS island FROM mk),
    spans AS (SELECT flight_id, island, min(fly_s) AS b, max(fly_s) AS e FROM isl WHERE recording GROUP BY flight_id, island),
    clips AS (SELECT flight_id, max(e - b) AS d FROM spans GROUP BY flight_id)
"""


@query("flight_record_clip_match", "S4 W4", with_views("telemetry", "WITH " + _ISLANDS + """,
    m AS (SELECT s.flight_id, min(b) AS b, any_value(d) AS d FROM spans s JOIN clips USING (flight_id)
          WHERE abs((e - b) - d) <= greatest(3.0e0, 0.03e0 * d) GROUP BY s.flight_id HAVING count(*) = 1),
    x AS (SELECT flight_id, sample_id, fly_s - b AS time_s, latitude, longitude, altitude_m, lag(fly_s - b) OVER
          (PARTITION BY flight_id ORDER BY fly_s, sample_id) AS p FROM rec JOIN m USING (flight_id)
          WHERE fly_s - b >= -2 AND fly_s - b <= d + 2),
    y AS (SELECT * FROM x WHERE p IS NULL OR p <> time_s)
    SELECT flight_id, sample_id, round(time_s, 3) AS time_s, round(latitude, 9) AS latitude,
        round(longitude, 9) AS longitude, round(altitude_m, 5) AS altitude_m FROM y
    WHERE flight_id IN (SELECT flight_id FROM y GROUP BY flight_id HAVING count(*) >= 3)"""))
def flight_record_clip_match(spark, sf_dir):
    records = _flight_record(spark, sf_dir)
    numbered = src.islands(
        records, "flight_id", ["sample_id"], F.col("recording"),
        ~F.coalesce(F.col("_prev"), F.lit(False)), F.col("recording"), False,
    )
    clips = (
        numbered.filter("recording").groupBy("flight_id", "island")
        .agg((F.max("fly_s") - F.min("fly_s")).alias("d"))
        .groupBy("flight_id").agg(F.max("d").alias("video_duration_s"))
    )
    out = src.match_recording(records, clips, "flight_id", "sample_id")
    return r(r(r(out, "time_s", 3), "latitude longitude", 9), "altitude_m", 5)


@query("longest_recording", "S5 W4", with_views("telemetry", """
    WITH v AS (SELECT *, lag(is_recording) OVER w AS pv, lag(time_s) OVER w AS pt
               FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY sample_id)),
    i AS (SELECT *, sum(CASE WHEN is_recording AND (pv IS NULL OR NOT pv OR time_s - pt > 40) THEN 1 ELSE 0 END)
          OVER (PARTITION BY flight_id ORDER BY sample_id) AS island FROM v),
    s AS (SELECT flight_id, island, count(*) AS n, min(time_s) AS b, max(time_s) AS e FROM i WHERE is_recording
          GROUP BY flight_id, island HAVING count(*) >= 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY b - e, island) AS k,
          count(*) OVER (PARTITION BY flight_id) AS found FROM s)
    SELECT i.flight_id, i.sample_id, round(i.time_s - b, 3) AS time_s, round(altitude_m, 6) AS altitude_m,
        CASE WHEN sample_id % 3 = 0 THEN sample_id % 360 ELSE sample_id % 180 * 1.0e0 END AS yaw_deg, found AS segments_found
    FROM i JOIN k USING (flight_id, island) WHERE k.k = 1 AND n >= 5 AND is_recording"""))
def longest_recording(spark, sf_dir):
    rows = view(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", F.col("time_s").alias("fly_s"), F.col("is_recording").alias("recording"),
        "latitude", "longitude", "altitude_m",
        F.when(F.col("sample_id") % 3 != 0, F.col("sample_id") % 180).cast("double").alias("gimbal_yaw"),
        (F.col("sample_id") % 360).cast("double").alias("aircraft_yaw"),
    )
    out = src.longest_recording(rows, "flight_id", "sample_id", 40.0, 5).drop("latitude", "longitude")
    return r(r(out, "time_s", 3), "altitude_m")


@query("image_gps_assembly", "S6 U1", with_views("telemetry frames", """
    WITH g AS (SELECT flight_id, sample_id AS image_id, (sample_id * 7919) % 100003 AS gps_time,
        latitude, longitude, altitude_m FROM telemetry WHERE sample_id % 5 <> 4),
    j AS (SELECT f.flight_id, f.frame_id AS image_id, latitude, longitude, altitude_m,
        row_number() OVER (PARTITION BY f.flight_id ORDER BY gps_time, f.frame_id) AS k
        FROM frames f JOIN g ON f.flight_id = g.flight_id AND f.frame_id = g.image_id)
    SELECT flight_id, image_id, round((k - 3) / 20.0e0, 6) AS time_s, round(latitude, 7) AS latitude,
        round(longitude, 7) AS longitude, round(altitude_m, 3) AS altitude_m,
        CASE WHEN image_id % 2 = 0 THEN image_id * 1.0e0 END AS truth_x_m FROM j WHERE k > 2 AND k <= 14"""))
def image_gps_assembly(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    scaled = F.col("sample_id") % 2 == 0
    gps = samples.select(
        "flight_id", F.col("sample_id").alias("image_id"),
        (F.col("sample_id") * 7919 % 100003).alias("gps_time"),
        F.when(scaled, F.rint(F.col("latitude") * 1e7)).otherwise(F.col("latitude")).alias("lat_raw"),
        F.when(scaled, F.rint(F.col("longitude") * 1e7)).otherwise(F.col("longitude")).alias("lon_raw"),
        F.when(scaled, F.rint(F.col("altitude_m") * 1e3)).otherwise(F.col("altitude_m")).alias("alt_raw"),
        (F.lit(5) - F.when(F.col("sample_id") % 5 == 4, 3).otherwise(F.col("sample_id") % 3)).alias("fix_type"),
    )
    frames = view(spark, sf_dir, "frames").select("flight_id", F.col("frame_id").alias("image_id"))
    truth = samples.filter("sample_id % 2 = 0").select(
        "flight_id", F.col("sample_id").alias("image_id"), F.col("sample_id").cast("double").alias("truth_x_m")
    )
    out = src.assemble_by_image(frames, gps, truth, "flight_id", 2, 12, 20.0)
    return r(r(r(out, "time_s"), "latitude longitude", 7), "altitude_m", 3)


@query("pose_clock", "S7", with_views("telemetry", """
    WITH p AS (SELECT flight_id, sample_id, time_s * CASE flight_id % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6
        ELSE 1e9 END AS raw FROM telemetry),
    e AS (SELECT flight_id, arg_min(raw, sample_id) AS f, arg_max(raw, sample_id) AS l, count(*) AS n,
        CASE WHEN flight_id % 3 <> 0 THEN (max(sample_id) - min(sample_id)) / 10.0e0 * 1.02e0 END AS d FROM p GROUP BY flight_id),
    s AS (SELECT flight_id, sample_id, raw - lag(raw) OVER (PARTITION BY flight_id ORDER BY sample_id) AS step FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY step, sample_id) AS k FROM s WHERE step > 0),
    m AS (SELECT k.flight_id, max(step) FILTER (k = floor((n - 2) / 2) + 1) AS mid FROM k JOIN e USING (flight_id) GROUP BY k.flight_id),
    c AS (SELECT e.flight_id, f, CASE WHEN d > 0 AND l - f > 0 THEN (SELECT arg_min(s.v, (abs((l - f) * s.v - d), s.i))
            FROM (VALUES (1.0e0, 0), (1e-3, 1), (1e-6, 2), (1e-9, 3)) s(v, i))
          WHEN mid < 100 THEN 1.0e0 WHEN mid < 100000 THEN 1e-3 ELSE 1e-6 END AS scale
          FROM e LEFT JOIN m USING (flight_id) WHERE n >= 3)
    SELECT flight_id, sample_id, scale, round((raw - f) * scale, 6) AS time_s FROM p JOIN c USING (flight_id)"""))
def pose_clock(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    unit = F.element_at(F.array(*[F.lit(v) for v in (1.0, 1e3, 1e6, 1e9)]), (F.col("flight_id") % 4 + 1).cast("int"))
    poses = samples.select("flight_id", "sample_id", (F.col("time_s") * unit).alias("raw_time"))
    clips = samples.groupBy("flight_id").agg(
        ((F.max("sample_id") - F.min("sample_id")) / 10.0 * 1.02).alias("video_duration_s")
    ).filter("flight_id % 3 <> 0")
    out = src.normalise_pose_times(poses, clips, "flight_id", "sample_id")
    return r(out.select("flight_id", "sample_id", "scale", "time_s"), "time_s")


@query("pose_log_positions", "S8 P7", with_views("poses", """
    WITH c AS (SELECT seq_id, frame_id,
        -((qw * qw + qx * qx - qy * qy - qz * qz) * tx + 2 * (qx * qy + qz * qw) * ty + 2 * (qx * qz - qy * qw) * tz) AS x,
        -(2 * (qx * qy - qz * qw) * tx + (qw * qw - qx * qx + qy * qy - qz * qz) * ty + 2 * (qy * qz + qx * qw) * tz) AS y,
        -(2 * (qx * qz + qy * qw) * tx + 2 * (qy * qz - qx * qw) * ty + (qw * qw - qx * qx - qy * qy + qz * qz) * tz) AS z
        FROM poses)
    SELECT seq_id, frame_id, round(x - first(x) OVER w, 5) AS x_m, round(y - first(y) OVER w, 5) AS y_m,
        round(z - first(z) OVER w, 5) AS z_m FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id)"""))
def pose_log_positions(spark, sf_dir):
    poses = view(spark, sf_dir, "poses")
    log = poses.select(
        "seq_id", "frame_id",
        F.concat_ws(
            ",", *[F.col(c).cast("string") for c in ("frame_id", "tx", "ty", "tz", "qx", "qy", "qz", "qw")], F.lit("")
        ).alias("value"),
    ).unionByName(poses.select("seq_id", "frame_id", F.lit("time,x,y,z,qx,qy,qz,qw").alias("value")))
    out = src.local_pose_positions(src.numeric_rows(log), "seq_id", "frame_id", world_to_camera=True)
    return r(out.drop("raw_time"), "x_m y_m z_m", 5)


@query("geotagged_stills", "S10 P27", with_views("telemetry", """
    WITH e AS (SELECT flight_id, sample_id, 'IMG_' || CAST(sample_id AS STRING) || '.JPG' AS name,
        CAST(sample_id % 90 AS STRING) AS captured,
        (sample_id % 80 + (sample_id % 60) / 60.0e0 + (sample_id % 5900) / 100.0e0 / 3600.0e0) * CASE WHEN sample_id % 2 = 0 THEN 1 ELSE -1 END AS lat,
        (sample_id % 170 + (sample_id % 50) / 60.0e0 + (sample_id % 4900) / 100.0e0 / 3600.0e0) * CASE WHEN sample_id % 3 = 0 THEN -1 ELSE 1 END AS lon,
        CASE WHEN sample_id % 7 = 0 THEN -altitude_m ELSE altitude_m END AS alt FROM telemetry),
    k AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY captured, lower(name)) AS k,
        count(*) OVER (PARTITION BY flight_id) AS n FROM e)
    SELECT flight_id, name, captured, round(lat, 9) AS latitude, round(lon, 9) AS longitude, round(alt, 6) AS altitude_m,
        round((k - 1) / 2.0e0, 6) AS time_s FROM k WHERE n >= 10"""))
def geotagged_stills(spark, sf_dir):
    i = F.col("sample_id")
    exif = view(spark, sf_dir, "telemetry").select(
        "flight_id",
        F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".JPG")).alias("name"),
        (i % 90).cast("string").alias("captured"),
        (i % 80).alias("lat_d"), (i % 60).alias("lat_m"), (i % 5900 / 100.0).alias("lat_s"),
        F.when(i % 2 == 0, "N").otherwise("s").alias("lat_ref"),
        (i % 170).alias("lon_d"), (i % 50).alias("lon_m"), (i % 4900 / 100.0).alias("lon_s"),
        F.when(i % 3 == 0, "W").otherwise("E").alias("lon_ref"),
        F.col("altitude_m").alias("altitude"), F.when(i % 7 == 0, 1).alias("below_sea_level"),
    )
    out = src.geotags(exif, "flight_id")
    return r(r(out, "latitude longitude", 9), "altitude_m time_s")
