"""Registered streaming queries: each runs a real stream over the table's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query
from .sources import scratch
from .telemetry import r
from .views import view, with_views


CHUNK_POINTS = 1_000_000


def _stream(spark, sf_dir, name):
    """A survey view over a stream of its base table's files."""
    from .views import VIEWS, source

    base = VIEWS[name].split("FROM ")[-1].split()[0]
    feed = jobs.file_stream(spark, source(spark, sf_dir, base), f"{sf_dir}/{base}.parquet")
    feed.createOrReplaceTempView(f"_stream_{base}")
    return spark.sql(VIEWS[name].replace(f"FROM {base}", f"FROM _stream_{base}"))


def _clock(name):
    """Seconds from 0 as event times, all after the first watermark."""
    return F.timestamp_millis(((F.col(name) + jobs.DAY_S) * 1000).cast("bigint"))


_W = """
    vb AS (SELECT sensor_id, ts, ax * ax + ay * ay + az * az AS q FROM vibration),
    wn AS (SELECT sensor_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS window_start, count(*) AS samples, sqrt(avg(q)) AS rms, max(sqrt(q)) AS peak FROM vb GROUP BY ALL)"""


def _windows(spark, sf_dir):
    feed = jobs.timed(_stream(spark, sf_dir, "vibration"), "ts", "1 hour")
    # Windows still open when the source ends come out as they then stand.
    return jobs.drain_updates(jobs.vibration_windows(feed, "6 hours"), "vibration", ["sensor_id", "window_start"])


@query("vibration_windows_stream", "T1", with_views("vibration", f"WITH {_W} SELECT sensor_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, samples, round(rms, 6) AS rms, round(peak, 6) AS peak FROM wn"))
def vibration_windows_stream(spark, sf_dir):
    out = _windows(spark, sf_dir).select("sensor_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "samples", "rms", "peak")
    return r(out, "rms peak")


@query("vibration_sample_blocks", "T1", with_views("vibration", """
    WITH n AS (SELECT sensor_id, ax * ax + ay * ay + az * az AS q, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) - 1 AS k FROM vibration)
    SELECT sensor_id, CAST(floor(k / 200) AS BIGINT) AS block, count(*) AS samples, round(sqrt(avg(q)), 6) AS rms, round(max(sqrt(q)), 6) AS peak FROM n GROUP BY ALL"""))
def vibration_sample_blocks(spark, sf_dir):
    return r(jobs.sample_windows(view(spark, sf_dir, "vibration"), 200), "rms peak")


_ALARMS = """
    lv AS (SELECT sensor_id, window_start, rms >= 0.1e0 AS hi, rms < 0.09e0 AS lo FROM wn),
    tr AS (SELECT *, CASE WHEN hi AND lag(hi) OVER w AND lag(hi, 2) OVER w THEN 1 WHEN lo AND lag(lo) OVER w AND lag(lo, 2) OVER w THEN -1 END AS kind FROM lv WINDOW w AS (PARTITION BY sensor_id ORDER BY window_start)),
    kd AS (SELECT *, lag(kind) OVER (PARTITION BY sensor_id ORDER BY window_start) AS before FROM tr WHERE kind IS NOT NULL)
    SELECT sensor_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, CASE kind WHEN 1 THEN 'raised' ELSE 'cleared' END AS event FROM kd WHERE kind <> coalesce(before, -1)"""


@query("vibration_alarms_stream", "T2", with_views("vibration", f"WITH {_W}, {_ALARMS}"))
def vibration_alarms_stream(spark, sf_dir):
    path = scratch(spark, "windows")
    windows = _windows(spark, sf_dir)
    windows.write.parquet(path)
    found = jobs.drain(jobs.alarm_stream(jobs.file_stream(spark, windows, path)), "alarms")
    return found.select("sensor_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event")


@query("vibration_alarms", "T2", with_views("vibration", f"WITH {_W}, {_ALARMS}"))
def vibration_alarms(spark, sf_dir):
    samples = view(spark, sf_dir, "vibration").withColumn("ts", F.col("ts").cast("timestamp"))
    found = jobs.alarms(jobs.vibration_windows(samples, "6 hours"))
    return found.select("sensor_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event")


_CAL = with_views("vibration", """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY seq) AS k FROM vibration),
    o AS (SELECT sensor_id, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM n WHERE k <= 60 GROUP BY sensor_id)
    SELECT sensor_id, round(any_value(x), 6) AS offset_x, round(any_value(y), 6) AS offset_y, round(any_value(z), 6) AS offset_z,
        round(sqrt(avg((ax - x) * (ax - x) + (ay - y) * (ay - y) + (az - z) * (az - z))), 6) AS baseline_rms
    FROM n JOIN o USING (sensor_id) WHERE k > 60 AND k <= 110 GROUP BY sensor_id HAVING count(*) = 50""")


@query("sensor_calibration_stream", "T3", _CAL)
def sensor_calibration_stream(spark, sf_dir):
    feed = _stream(spark, sf_dir, "vibration").select("sensor_id", "seq", "ax", "ay", "az")
    return r(jobs.drain(jobs.calibration_stream(feed, 60, 50), "calibration"), "offset_x offset_y offset_z baseline_rms")


@query("sensor_calibration", "T3", _CAL)
def sensor_calibration(spark, sf_dir):
    return r(jobs.calibration(view(spark, sf_dir, "vibration"), 60, 50), "offset_x offset_y offset_z baseline_rms")


@query("sliding_windows_stream", "T4", with_views("vibration", """
    WITH vb AS (SELECT sensor_id, ts, ax * ax + ay * ay + az * az AS q FROM vibration),
    ex AS (SELECT sensor_id, q, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') - s * INTERVAL '6 hours' AS window_start FROM vb, range(2) t(s)),
    wn AS (SELECT sensor_id, window_start, count(*) AS samples, sqrt(avg(q)) AS rms FROM ex GROUP BY ALL)
    SELECT sensor_id, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, samples, round(rms, 6) AS rms FROM wn"""))
def sliding_windows_stream(spark, sf_dir):
    feed = jobs.timed(_stream(spark, sf_dir, "vibration"), "ts", "1 hour")
    out = jobs.drain_updates(jobs.vibration_windows(feed, "12 hours", "6 hours"), "sliding", ["sensor_id", "window_start"])
    return r(out.select("sensor_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "samples", "rms"), "rms")


@query("recording_sessions_stream", "T5", with_views("telemetry", """
    WITH v AS (SELECT *, lag(is_recording) OVER w AS pv, lag(time_s) OVER w AS pt FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY time_s, sample_id)),
    i AS (SELECT *, sum(CASE WHEN is_recording AND (pv IS NULL OR NOT pv OR time_s - pt > 40) THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY time_s, sample_id) AS island FROM v)
    SELECT flight_id, round(min(time_s), 6) AS start_s, round(max(time_s), 6) AS end_s, CAST(count(*) AS INT) AS rows FROM i WHERE is_recording GROUP BY flight_id, island
    HAVING count(*) >= 3"""))
def recording_sessions_stream(spark, sf_dir):
    feed = _stream(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", _clock("time_s").alias("ts"), F.col("time_s").alias("at_s"), F.col("is_recording").alias("valid")
    )
    out = jobs.drain_to_end(feed, "ts", "1 minute", lambda rows: jobs.session_stream(rows, 40.0, jobs.DAY_S), "sessions")
    return r(out, "start_s end_s")


@query("live_telemetry_defects_stream", "T6 P2", with_views("telemetry", """
    WITH d AS (SELECT flight_id, sample_id, time_s_raw - lag(time_s_raw) OVER w AS gap, abs(altitude_m - lag(altitude_m) OVER w) AS climb,
        2.0e0 * 6371008.8e0 * asin(least(1.0e0, sqrt(pow(sin((radians(latitude) - radians(lag(latitude) OVER w)) / 2), 2)
        + cos(radians(lag(latitude) OVER w)) * cos(radians(latitude)) * pow(sin(radians(longitude - lag(longitude) OVER w) / 2), 2)))) AS flat
        FROM telemetry WINDOW w AS (PARTITION BY flight_id ORDER BY sample_id))
    SELECT flight_id, sample_id, defect FROM d, LATERAL (VALUES ('duplicate_or_reversed_time', gap <= 0), ('gap_over_5s', gap > 5), ('horizontal_speed', gap > 0 AND flat / gap > 1000),
        ('vertical_speed', gap > 0 AND climb / gap > 500)) x(defect, hit) WHERE hit"""))
def live_telemetry_defects_stream(spark, sf_dir):
    feed = _stream(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", F.col("time_s_raw").alias("t"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("altitude_m").alias("alt")
    )
    return jobs.drain(jobs.defects(jobs.step_stream(feed)), "defects")


_SILENT = with_views("telemetry", """
    WITH n AS (SELECT flight_id, sample_id, time_s AS at_s, lead(time_s) OVER (PARTITION BY flight_id ORDER BY time_s, sample_id) AS nxt FROM telemetry)
    SELECT flight_id, sample_id, round(at_s, 6) AS at_s, round(at_s + 5.0e0, 6) AS silent_from_s FROM n WHERE nxt IS NULL OR nxt - at_s > 5""")


@query("telemetry_silence_stream", "T6", _SILENT)
def telemetry_silence_stream(spark, sf_dir):
    feed = _stream(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", _clock("time_s").alias("ts"), F.col("time_s").alias("at_s")
    )
    return r(jobs.drain_to_end(feed, "ts", "1 minute", lambda rows: jobs.silence_stream(rows, ahead_s=jobs.DAY_S), "silence"), "at_s silent_from_s")


@query("telemetry_silence", "T6", _SILENT)
def telemetry_silence(spark, sf_dir):
    return r(jobs.silences(view(spark, sf_dir, "telemetry").withColumn("at_s", F.col("time_s"))), "at_s silent_from_s")


@query("monitor_stages_stream", "T7 J4", with_views("monitor stages", """
    SELECT s.stage_id, count(*) AS samples, round(avg(TRY_CAST(utilization_gpu_percent AS DOUBLE)), 6) AS utilization_mean
    FROM stages s JOIN monitor m ON m.host_id = s.host_id AND m.at_s BETWEEN s.start_s AND s.end_s GROUP BY s.stage_id"""))
def monitor_stages_stream(spark, sf_dir):
    samples = _stream(spark, sf_dir, "monitor").select("sample_id", "host_id", _clock("at_s").alias("ts"), "utilization_gpu_percent")
    stages = _stream(spark, sf_dir, "stages").select("stage_id", "host_id", _clock("start_s").alias("start_ts"), _clock("end_s").alias("end_ts"))
    joined = jobs.drain(jobs.stage_samples(samples, stages, "5 minutes", "60 seconds"), "stages")
    out = joined.groupBy("stage_id").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("utilization_gpu_percent").try_cast("double")).alias("utilization_mean"))
    return r(out, "utilization_mean")


@query("deduplicated_runs_stream", "T8", "SELECT user_id AS run_id, count(*) AS requests, 1 AS started FROM events GROUP BY user_id")
def deduplicated_runs_stream(spark, sf_dir):
    from .views import source

    requests = jobs.file_stream(spark, source(spark, sf_dir, "events"), f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    started = jobs.drain(jobs.first_runs(requests, "60 days"), "runs").groupBy("run_id").agg(F.count(F.lit(1)).cast("int").alias("started"))
    asked = source(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("requests"))
    return asked.join(started, "run_id", "left")


@query("retained_tasks", "T8 W17", """
    WITH t AS (SELECT event_id AS task_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id * 7919 % 100003 AS DOUBLE) / 10 END AS finished_at FROM events)
    SELECT task_id, finished_at FROM t WHERE finished_at IS NULL UNION ALL
    SELECT * FROM (SELECT task_id, finished_at FROM t WHERE 10000 - finished_at <= 600 ORDER BY finished_at DESC, task_id LIMIT 100)""")
def retained_tasks(spark, sf_dir):
    from .views import source

    tasks = source(spark, sf_dir, "events").select(
        F.col("event_id").alias("task_id"),
        F.when(F.col("event_type") != "error", (F.col("event_id") * 7919 % 100003).cast("double") / 10).alias("finished_at"),
    )
    return jobs.retained_tasks(tasks, F.lit(10000.0), 600.0, 100)


@query("incremental_raster_stream", "T9 G18", with_views("points", """
    SELECT scan_id, CAST(floor(x / 2) AS BIGINT) AS col, CAST(floor(y / 2) AS BIGINT) AS "row", round(max(z), 6) AS z, count(*) AS n FROM points GROUP BY ALL"""))
def incremental_raster_stream(spark, sf_dir):
    path = scratch(spark, "chunks")
    points = view(spark, sf_dir, "points")
    # Three batches of files whose size does not grow with the table.
    files = max(1, -(-points.count() // (3 * CHUNK_POINTS)))
    points.repartition(3 * files, "point_id").write.parquet(path)
    feed = jobs.file_stream(spark, points, path, files_per_batch=files)
    return r(jobs.drain_updates(jobs.raster_stream(feed, "scan_id", 2.0), "raster", ["scan_id", "col", "row"]), "z")
