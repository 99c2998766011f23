"""The end of a bounded source closes what is open, and the interval join forgets what can no longer match."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skyledger.streaming import jobs


def test_last_sessions_come_out(spark, tmp_path):
    rows = [(1, k, float(k), True) for k in range(5)] + [(1, 10 + k, 100.0 + k, True) for k in range(4)] + [(2, 50, 3.0, True), (2, 51, 4.0, True)]
    rows += [(3, 60 + k, 200.0 + k, k != 4) for k in range(8)]
    table = spark.createDataFrame(rows, "flight_id long, sample_id long, at_s double, valid boolean")
    path = str(tmp_path / "rows")
    table.withColumn("ts", F.timestamp_millis((F.col("at_s") * 1000).cast("bigint") + 86_400_000)).write.parquet(path)
    feed = jobs.file_stream(spark, spark.read.parquet(path), path)
    # Times lie a day after the epoch, where the first watermark stands; timers go by seconds alone.
    got = jobs.drain_to_end(feed, "ts", "5 seconds", lambda r: jobs.session_stream(r, 2.0), "t").collect()
    assert {tuple(r) for r in got} == {(1, 0.0, 4.0, 5), (1, 100.0, 103.0, 4), (3, 200.0, 203.0, 4), (3, 205.0, 207.0, 3)}


def test_silence_is_told_without_a_following_sample(spark, tmp_path):
    path, log, out = (str(tmp_path / n) for n in ("rows", "log", "out"))
    kinds = "flight_id long, sample_id long, at_s double"

    def add(rows):
        table = spark.createDataFrame(rows, kinds).coalesce(1)
        table.withColumn("ts", F.timestamp_millis((F.col("at_s") * 1000).cast("bigint"))).write.mode("append").parquet(path)

    add([(1, k, 100.0 + k) for k in range(4)] + [(2, 20, 100.0), (2, 21, 109.0)])
    like = spark.read.parquet(path)

    def run():
        feed = jobs.file_stream(spark, like, path).withWatermark("ts", "2 seconds")
        jobs._finish(spark, jobs.silence_stream(feed).writeStream.format("parquet").option("path", out).option("checkpointLocation", log))
        return {(r["flight_id"], r["sample_id"]) for r in spark.read.schema(jobs.SILENCE).parquet(out).collect()}

    assert run() >= {(2, 20)}
    add([(3, 30, 150.0)])  # flight 1 is silent, and only others send
    assert run() == {(1, 3), (2, 20), (2, 21)}
    add([(1, 4, 160.0), (1, 5, 161.0)])
    add([(3, 31, 200.0)])
    assert run() >= {(1, 3), (1, 5), (2, 20), (2, 21), (3, 30)}
    twin = jobs.silences(spark.read.parquet(path))
    assert {(r["flight_id"], r["sample_id"]) for r in twin.collect()} == {(1, 3), (1, 5), (2, 20), (2, 21), (3, 30), (3, 31)}


def test_samples_leave_the_join_state(spark, tmp_path):
    def at(s):
        return F.timestamp_millis((F.lit(s) * 1000).cast("bigint") + F.lit(86_400_000))

    samples, stages, log, out = (str(tmp_path / n) for n in ("samples", "stages", "log", "out"))
    for batch in range(6):
        base = batch * 1000
        spark.range(100).select(
            (F.col("id") + base).alias("sample_id"), F.lit(1).cast("long").alias("host_id"), at(F.col("id") + base).alias("ts"), F.lit("5").alias("utilization_gpu_percent")
        ).coalesce(1).write.mode("append").parquet(samples)
        spark.range(10).select(
            (F.col("id") + base).alias("stage_id"), F.lit(1).cast("long").alias("host_id"), at(F.col("id") * 10 + base).alias("start_ts"), at(F.col("id") * 10 + base + 15).alias("end_ts")
        ).coalesce(1).write.mode("append").parquet(stages)
    s = jobs.file_stream(spark, spark.read.parquet(samples), samples, files_per_batch=1)
    g = jobs.file_stream(spark, spark.read.parquet(stages), stages, files_per_batch=1)
    joined = jobs.stage_samples(s, g, "30 seconds", "20 seconds")
    query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]
    assert max(held) >= 100 and held[-1] <= 120 < 600  # 660 rows came in all; the last batch's at most remain
    want = {(st + b * 1000, x + b * 1000) for b in range(6) for st in range(10) for x in range(st * 10, st * 10 + 16) if x < 100}
    assert {(r["stage_id"], r["sample_id"]) for r in spark.read.parquet(out).collect()} == want
