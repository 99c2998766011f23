"""Structured Streaming jobs for vibration, telemetry, monitor and point feeds.

Each aggregate is written once and runs on a stream or on a table. Streams write append-only
files below the shared folder, so a restart continues from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.geo import haversine
from ..scale import lag, last_known, lead, ordered, rank
from ..session import shared_folder

# The first watermark is the epoch, and a row that is not after it counts as late. Clocks that start at 0 are put a day on.
DAY_S = 86_400.0
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _finish(spark: SparkSession, writer) -> None:
    """Run a stream to the end of its source; the caller's settings are as before when it is done.

    A local run opens one state store per core, not 200.
    """
    provider, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {name: spark.conf.get(name) for name in (provider, parts)}
    spark.conf.set(provider, ROCKSDB)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set(parts, str(min(int(before[parts]), spark.sparkContext.defaultParallelism)))
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read the sink back."""
    spark = stream.sparkSession
    path, log = folder(spark, name), folder(spark, f"{name}-log")
    _finish(spark, stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode(mode))
    return spark.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, like: DataFrame, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder; a single file is picked from its parent folder."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def timed(feed: DataFrame, column: str, delay: str) -> DataFrame:
    """Cast a zone-less time, which a watermark rejects, and set the lateness bound."""
    return feed.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def vibration_windows(samples: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """RMS and peak of three-axis acceleration per sensor and time window."""
    square = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return samples.groupBy(span.alias("w"), "sensor_id").agg(
        F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(square)).alias("rms"), F.max(F.sqrt(square)).alias("peak")
    ).select("sensor_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "samples", "rms", "peak")


def sample_windows(samples: DataFrame, size: int) -> DataFrame:
    """The same figures over a fixed number of samples of each sensor's own count."""
    square = F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az")
    placed = ordered(samples, ["sensor_id"], ["seq"], {"_n": rank()})
    return placed.groupBy("sensor_id", F.floor((F.col("_n") - 1) / size).alias("block")).agg(
        F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(square)).alias("rms"), F.max(F.sqrt(square)).alias("peak")
    )


# Alarm rule of the vibration watch.
RAISE_AT, CLEAR_BELOW, IN_A_ROW = 0.100, 0.090, 3


class AlarmProcessor(StatefulProcessor):
    """Raise after enough windows in a row at the upper level, clear after enough below the lower."""

    def __init__(self, raise_at: float = RAISE_AT, clear_below: float = CLEAR_BELOW, in_a_row: int = IN_A_ROW):
        self.raise_at, self.clear_below, self.in_a_row = raise_at, clear_below, in_a_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alarm", "active boolean, high int, low int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        active, high, low = self.state.get() if self.state.exists() else (False, 0, 0)
        found = []
        for start, rms in pd.concat(list(rows)).sort_values("window_start")[["window_start", "rms"]].itertuples(index=False):
            high = high + 1 if rms >= self.raise_at else 0
            low = low + 1 if rms < self.clear_below else 0
            if not active and high >= self.in_a_row:
                active = True
                found.append((key[0], start, "raised"))
            elif active and low >= self.in_a_row:
                active = False
                found.append((key[0], start, "cleared"))
        self.state.update((active, high, low))
        yield pd.DataFrame(found, columns=["sensor_id", "window_start", "event"])

    def close(self) -> None:
        pass


def alarm_stream(windows: DataFrame, **rule) -> DataFrame:
    return windows.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=AlarmProcessor(**rule), outputStructType="sensor_id bigint, window_start timestamp, event string",
        outputMode="Append", timeMode="None",
    )


def alarms(windows: DataFrame, raise_at: float = RAISE_AT, clear_below: float = CLEAR_BELOW) -> DataFrame:
    """Table twin of ``alarm_stream`` for three windows in a row."""
    level = F.when(F.col("rms") >= raise_at, 1).when(F.col("rms") < clear_below, -1).otherwise(0)
    rows = windows.withColumn("_l", level)
    rows = ordered(rows, ["sensor_id"], ["window_start"], {"_b": lag(F.col("_l"))})
    rows = ordered(rows, ["sensor_id"], ["window_start"], {"_c": lag(F.col("_b"))})
    trio = (F.col("_l") == F.col("_b")) & (F.col("_b") == F.col("_c")) & (F.col("_l") != 0)
    rows = rows.withColumn("_kind", F.when(trio, F.col("_l")))
    rows = ordered(rows, ["sensor_id"], ["window_start"], {"_seen": last_known(F.col("_kind"))})
    rows = ordered(rows, ["sensor_id"], ["window_start"], {"_before": lag(F.col("_seen"))})
    # nothing to clear before the first alarm
    turned = F.col("_kind").isNotNull() & (F.col("_kind") != F.coalesce("_before", F.lit(-1)))
    return rows.filter(turned).select("sensor_id", "window_start", F.when(F.col("_kind") == 1, "raised").otherwise("cleared").alias("event"))


class CalibrationProcessor(StatefulProcessor):
    """Axis offsets from the first static samples, then the RMS baseline of the next ones."""

    def __init__(self, still: int = 600, base: int = 1000):
        self.still, self.base = still, base

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "n int, x double, y double, z double, q double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, x, y, z, q = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0.0)
        out = []
        for part in [pd.concat(list(rows)).sort_values("seq")]:
            for ax, ay, az in part[["ax", "ay", "az"]].itertuples(index=False):
                if n >= self.still + self.base:
                    break
                n += 1
                if n <= self.still:
                    x, y, z = x + ax, y + ay, z + az
                else:
                    q += (ax - x / self.still) ** 2 + (ay - y / self.still) ** 2 + (az - z / self.still) ** 2
                if n == self.still + self.base:
                    out.append((key[0], x / self.still, y / self.still, z / self.still, (q / self.base) ** 0.5))
        self.state.update((n, x, y, z, q))
        yield pd.DataFrame(out, columns=["sensor_id", "offset_x", "offset_y", "offset_z", "baseline_rms"])

    def close(self) -> None:
        pass


CALIBRATION = "sensor_id bigint, offset_x double, offset_y double, offset_z double, baseline_rms double"


def calibration_stream(samples: DataFrame, still: int, base: int) -> DataFrame:
    return samples.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=CalibrationProcessor(still, base), outputStructType=CALIBRATION, outputMode="Append", timeMode="None"
    )


def calibration(samples: DataFrame, still: int = 600, base: int = 1000) -> DataFrame:
    """Table twin of ``calibration_stream``."""
    placed = ordered(samples, ["sensor_id"], ["seq"], {"_n": rank()}).filter(F.col("_n") <= still + base)
    early = F.col("_n") <= still
    offsets = placed.groupBy("sensor_id").agg(
        F.count(F.lit(1)).alias("_all"), *[F.avg(F.when(early, F.col(f"a{c}"))).alias(f"offset_{c}") for c in "xyz"]
    ).filter(F.col("_all") == still + base)
    d = [F.col(f"a{c}") - F.col(f"offset_{c}") for c in "xyz"]
    return placed.join(offsets, "sensor_id").filter(~early).groupBy("sensor_id", *[f"offset_{c}" for c in "xyz"]).agg(
        F.sqrt(F.avg(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("baseline_rms")
    )


class SessionProcessor(StatefulProcessor):
    """Recording sessions: closed by an invalid row, a gap, or the watermark passing the gap."""

    def __init__(self, gap_s: float = 2.0, least: int = 3, ahead_s: float = 0.0):
        self.gap_s, self.least, self.ahead_s = gap_s, least, ahead_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "start_s double, last_s double, n int")

    def _closed(self, key, kept) -> list[tuple]:
        start, last, n = kept
        return [(key[0], start, last, n)] if n >= self.least else []

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["flight_id", "start_s", "end_s", "rows"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get() if self.state.exists() else None
        out = []
        for at, valid in pd.concat(list(rows)).sort_values(["at_s", "sample_id"])[["at_s", "valid"]].itertuples(index=False):
            if kept and (not valid or at - kept[1] > self.gap_s):
                out += self._closed(key, kept)
                kept = None
            if valid:
                kept = (kept[0], at, kept[2] + 1) if kept else (at, at, 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.state.update(kept)
            self.handle.registerTimer(int((kept[1] + self.gap_s + self.ahead_s) * 1000) + 1)
        elif self.state.exists():
            self.state.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._closed(key, self.state.get()) if self.state.exists() else []
        self.state.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def drain_to_end(feed: DataFrame, clock: str, delay: str, job, name: str) -> DataFrame:
    """Run ``job`` over a bounded ``feed`` and let its end close what is still open.

    ``feed`` is without a watermark; ``clock`` is its event time. When the source is drained the same
    query goes on from its checkpoint with one marker row, null but for a time far beyond the last,
    which moves the watermark past every timer and window. ``job`` ignores rows with null keys.
    """
    spark = feed.sparkSession
    path, log, marks = folder(spark, name), folder(spark, f"{name}-log"), folder(spark, f"{name}-end")
    empty = spark.createDataFrame([], feed.schema)
    empty.write.parquet(marks)
    ended = feed.unionByName(file_stream(spark, empty, marks)).withWatermark(clock, delay)
    out = job(ended)

    def run() -> None:
        _finish(spark, out.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).outputMode("append"))

    run()
    blank = [F.timestamp_seconds(F.lit(1 << 33)).alias(clock) if f.name == clock else F.lit(None).cast(f.dataType).alias(f.name) for f in feed.schema.fields]
    spark.range(1).select(*blank).write.mode("append").parquet(marks)
    run()
    return spark.read.schema(out.schema).parquet(path)


def session_stream(rows: DataFrame, gap_s: float = 2.0, ahead_s: float = 0.0) -> DataFrame:
    """``rows``: flight_id, sample_id, ts (watermarked, ``ahead_s`` later than at_s), at_s, valid."""
    return rows.groupBy("flight_id").transformWithStateInPandas(
        statefulProcessor=SessionProcessor(gap_s, ahead_s=ahead_s), outputStructType="flight_id bigint, start_s double, end_s double, rows int",
        outputMode="Append", timeMode="EventTime",
    )


class DefectProcessor(StatefulProcessor):
    """Compares every arriving sample with the flight's last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "sample_id bigint, t double, lat double, lon double, alt double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        part = pd.concat(list(rows)).sort_values("sample_id", ignore_index=True)
        cols = part[["sample_id", "t", "lat", "lon", "alt"]]
        before = cols.shift(1)
        if last is not None:
            before.iloc[0] = last
        self.state.update(tuple(cols.iloc[-1].tolist()))
        out = cols.assign(flight_id=key[0], **{f"p_{c}": before[c] for c in ("t", "lat", "lon", "alt")})
        yield out[["flight_id", "sample_id", "t", "lat", "lon", "alt", "p_t", "p_lat", "p_lon", "p_alt"]]

    def close(self) -> None:
        pass


STEPS = ("flight_id bigint, sample_id bigint, t double, lat double, lon double, alt double, "
         "p_t double, p_lat double, p_lon double, p_alt double")


def step_stream(samples: DataFrame) -> DataFrame:
    """Samples beside their predecessor; the defect rules then run as plain columns."""
    return samples.groupBy("flight_id").transformWithStateInPandas(
        statefulProcessor=DefectProcessor(), outputStructType=STEPS, outputMode="Append", timeMode="None"
    )


def defects(steps: DataFrame) -> DataFrame:
    gap = F.col("t") - F.col("p_t")
    flat = haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    rules: list[tuple[str, Column]] = [
        ("duplicate_or_reversed_time", gap <= 0), ("gap_over_5s", gap > 5.0),
        ("horizontal_speed", (gap > 0) & (flat / gap > 1000.0)), ("vertical_speed", (gap > 0) & (F.abs(F.col("alt") - F.col("p_alt")) / gap > 500.0)),
    ]
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return steps.filter("p_t is not null").select("flight_id", "sample_id", F.explode(names).alias("defect"))


SILENCE = "flight_id bigint, sample_id bigint, at_s double, silent_from_s double"


class SilenceProcessor(StatefulProcessor):
    """An alarm when a flight sends nothing for longer than ``limit_s``, by an event-time timer and not by the next sample."""

    def __init__(self, limit_s: float = 5.0, ahead_s: float = 0.0):
        self.limit_s, self.ahead_s = limit_s, ahead_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "sample_id bigint, at_s double")

    def _frame(self, key, ids, times) -> pd.DataFrame:
        times = pd.Series(times, dtype="float64")
        return pd.DataFrame({"flight_id": key[0], "sample_id": pd.Series(ids, dtype="int64"), "at_s": times, "silent_from_s": times + self.limit_s})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        # A key's rows come in several parts, in no order: only all of them give the next sample of each.
        part = pd.concat([p[["sample_id", "at_s"]] for p in rows]).dropna().sort_values(["at_s", "sample_id"])
        ids, times = part["sample_id"].tolist(), part["at_s"].tolist()
        if last is not None:
            ids, times = [last[0], *ids], [last[1], *times]
        if times:
            line = pd.DataFrame({"id": ids, "t": times})
            quiet = line[line["t"].shift(-1) - line["t"] > self.limit_s]
            yield self._frame(key, quiet["id"].tolist(), quiet["t"].tolist())
            latest = line["t"].idxmax() if line["t"].iloc[-1] < line["t"].max() else len(line) - 1
            last = (int(line["id"].iloc[latest]), float(line["t"].iloc[latest]))
        if last is not None:
            self.state.update(last)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last[1] + self.limit_s + self.ahead_s) * 1000) + 1)
        yield self._frame(key, [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            sample, at = self.state.get()
            self.state.clear()  # the next sample begins anew, so a silence is told once
            yield self._frame(key, [sample], [at])
        else:
            yield self._frame(key, [], [])

    def close(self) -> None:
        pass


def silence_stream(samples: DataFrame, limit_s: float = 5.0, ahead_s: float = 0.0) -> DataFrame:
    """``samples``: flight_id, sample_id, ts (watermarked, ``ahead_s`` later than at_s), at_s. One row per silence, of the sample before it."""
    return samples.groupBy("flight_id").transformWithStateInPandas(
        statefulProcessor=SilenceProcessor(limit_s, ahead_s), outputStructType=SILENCE, outputMode="Append", timeMode="EventTime"
    )


def silences(samples: DataFrame, limit_s: float = 5.0) -> DataFrame:
    """Table twin of ``silence_stream`` for a source that has ended: the last sample of a flight is followed by silence."""
    nxt = ordered(samples, ["flight_id"], ["at_s", "sample_id"], {"_next": lead(F.col("at_s"))})
    quiet = nxt.filter(F.col("_next").isNull() | (F.col("_next") - F.col("at_s") > limit_s))
    return quiet.select("flight_id", "sample_id", "at_s", (F.col("at_s") + limit_s).alias("silent_from_s"))


def stage_samples(samples: DataFrame, stages: DataFrame, delay: str, longest: str) -> DataFrame:
    """Stream-stream interval join of samples and the stages that ran, each reported at its end.

    Both states are bounded: a stage leaves once the samples' watermark has passed its end, a
    sample once the stages' watermark is ``longest`` beyond it, as no stage that long ago can still
    end. Of a stage longer than that the samples of its last ``longest`` are joined.
    """
    # Both sides carry the slice of time they lie in, so that a sample meets the stages of its slice alone. A stage is
    # in every slice of its last ``longest`` (two, at most), a sample in one: no pair comes twice.
    width = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {longest})")
    slice_of = lambda t: F.floor(F.unix_micros(t) / width)
    s = samples.withWatermark("ts", delay).withColumn("_slice", slice_of(F.col("ts")))
    g = stages.select(F.col("host_id").alias("_host"), "stage_id", "start_ts", "end_ts").withWatermark("end_ts", delay)
    since = F.greatest("start_ts", F.col("end_ts") - F.expr(f"INTERVAL {longest}"))
    g = g.filter("start_ts <= end_ts").withColumn("_at", F.explode(F.sequence(slice_of(since), slice_of(F.col("end_ts")))))
    within = (F.col("host_id") == F.col("_host")) & (F.col("_slice") == F.col("_at")) & (F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))
    return s.join(g, within & (F.col("end_ts") <= F.col("ts") + F.expr(f"INTERVAL {longest}"))).select("stage_id", "sample_id", "utilization_gpu_percent")


def first_runs(requests: DataFrame, delay: str) -> DataFrame:
    """A run already asked for within the lateness bound is not started again."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id"])


def retained_tasks(tasks: DataFrame, now: Column, keep_s: float, most: int) -> DataFrame:
    """Unfinished tasks, and finished ones neither expired nor beyond the newest ``most``."""
    fresh = tasks.filter(F.col("finished_at").isNull() | (now - F.col("finished_at") <= keep_s))
    open_tasks = fresh.filter("finished_at is null")
    newest = fresh.filter("finished_at is not null").orderBy(F.col("finished_at").desc(), "task_id").limit(most)
    return open_tasks.unionByName(newest)


def raster_stream(points: DataFrame, by: str, res: float) -> DataFrame:
    return points.groupBy(by, F.floor(F.col("x") / res).alias("col"), F.floor(F.col("y") / res).alias("row")).agg(
        F.max("z").alias("z"), F.count(F.lit(1)).alias("n")
    )


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Keep the latest state of every key: each batch overwrites only its own folder, so a retry is harmless."""
    spark = stream.sparkSession
    path, log = folder(spark, name), folder(spark, f"{name}-log")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _finish(spark, stream.writeStream.foreachBatch(put).option("checkpointLocation", log).outputMode("update"))
    rest = [c for c in stream.columns if c not in keys]
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
