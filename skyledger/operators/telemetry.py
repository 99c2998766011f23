"""Telemetry quality, preflight checks and flight classification, one row per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import METRES_PER_DEGREE, haversine, local_distance
from ..scale import Quantile, grouped, is_hot, lag, ordered, rank
from .resample import greedy_resample

POSITION = ["latitude", "longitude", "altitude_m"]


def steps(samples: DataFrame, key: str, time: str, order: list[str], hot: bool) -> DataFrame:
    """Each sample with its gap and 3-D distance from the previous one."""
    out = ordered(samples, [key], order, {"_prev": lag(F.struct(F.col(time).alias("t"), *POSITION))}, hot=hot)
    p = F.col("_prev")
    return out.withColumn("gap_s", F.col(time) - p["t"]).withColumn(
        "distance_m",
        local_distance(p["latitude"], p["longitude"], p["altitude_m"], *[F.col(c) for c in POSITION]),
    ).withColumn("speed_mps", F.when(F.col("gap_s") > 0, F.col("distance_m") / F.col("gap_s")))


def quality(samples: DataFrame, key: str, time: str, order: list[str], hot: bool | None = None):
    """(per-flight report, probable jump events)."""
    if hot is None:
        hot = is_hot(samples, [key])
    diff = steps(samples, key, time, order, hot)
    positive = F.when(F.col("gap_s") > 0, F.col("gap_s"))
    stats = grouped(
        diff,
        [key],
        [
            F.count(F.lit(1)).alias("samples"),
            (F.max_by(time, F.struct(*order)) - F.min_by(time, F.struct(*order))).alias("duration_s"),
            F.count_if(F.col("gap_s") <= 0).alias("duplicate_or_reversed_timestamps"),
            F.coalesce(F.max("gap_s"), F.lit(0.0)).alias("maximum_sample_gap_s"),
            (F.count("horizontal_accuracy_m") + F.count("vertical_accuracy_m") > 0).alias("has_per_sample_accuracy"),
        ],
        [
            Quantile("median_sample_gap_s", positive, 0.5),
            Quantile("speed_mps_median", F.col("speed_mps"), 0.5),
            Quantile("speed_mps_p95", F.col("speed_mps"), 0.95),
            Quantile("distance_p95_m", F.col("distance_m"), 0.95),
            Quantile("horizontal_accuracy_m_median", F.col("horizontal_accuracy_m"), 0.5),
            Quantile("vertical_accuracy_m_median", F.col("vertical_accuracy_m"), 0.5),
        ],
        hot=hot,
    ).withColumn(
        "position_jump_speed_threshold_mps",
        F.greatest(F.lit(60.0), 4.0 * F.coalesce("speed_mps_p95", F.lit(0.0))),
    ).withColumn(
        "position_jump_distance_threshold_m",
        F.greatest(F.lit(5.0), 5.0 * F.coalesce("distance_p95_m", F.lit(0.0))),
    )
    limits = stats.select(
        key,
        "median_sample_gap_s",
        "position_jump_speed_threshold_mps",
        "position_jump_distance_threshold_m",
    )
    tested = diff.join(limits, key).withColumn(
        "is_jump",
        (F.col("speed_mps") > F.col("position_jump_speed_threshold_mps"))
        & (F.col("distance_m") > F.col("position_jump_distance_threshold_m")),
    )
    wide = (F.col("median_sample_gap_s") > 0) & (
        F.col("gap_s") > F.greatest(F.lit(2.0), 5.0 * F.col("median_sample_gap_s"))
    )
    counts = tested.groupBy(key).agg(
        F.count_if(wide).alias("telemetry_gap_count"),
        F.count_if("is_jump").alias("probable_position_jumps"),
    )
    events = tested.filter("is_jump").select(
        key,
        F.col("_prev")["t"].alias("before_time_s"),
        F.col(time).alias("after_time_s"),
        "distance_m",
        "speed_mps",
    )
    return stats.join(counts, key), events


def preflight(samples: DataFrame, clips: DataFrame, key: str, hot: bool | None = None) -> DataFrame:
    """Named defect checks per flight; ``clips`` gives each flight's video length."""
    if hot is None:
        hot = is_hot(samples, [key])
    order = ["time_s", "sample_id"]
    diff = ordered(samples, [key], order, {"_prev": lag(F.struct(F.col("time_s").alias("t"), *POSITION))}, hot=hot)
    p, gap = F.col("_prev"), F.col("gap_s")
    diff = diff.withColumn("gap_s", F.col("time_s") - p["t"])
    flat = haversine(p["latitude"], p["longitude"], F.col("latitude"), F.col("longitude"))
    valid = (
        F.col("latitude").between(-90, 90)
        & F.col("longitude").between(-180, 180)
        & F.col("altitude_m").isNotNull()
        & ~F.isnan("altitude_m")
        & (F.abs("altitude_m") != float("inf"))
    )
    out = diff.groupBy(key).agg(
        F.every(F.coalesce(valid, F.lit(False))).alias("coordinates_valid"),
        F.every(F.coalesce(gap > 0, F.lit(True))).alias("timestamps_strictly_increasing"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("maximum_time_gap_s"),
        F.min("time_s").alias("first_s"),
        F.max("time_s").alias("last_s"),
        F.coalesce(F.max(F.when(gap > 0, flat / gap)), F.lit(0.0)).alias("maximum_horizontal_speed_mps"),
        F.coalesce(
            F.max(F.when(gap > 0, F.abs(F.col("altitude_m") - p["altitude_m"]) / gap)), F.lit(0.0)
        ).alias("maximum_vertical_speed_mps"),
        F.max("altitude_datum").isNotNull().alias("altitude_datum_declared"),
    ).join(clips, key)
    checks = {
        "maximum_gap_at_most_5s": F.col("maximum_time_gap_s") <= 5.0,
        "starts_within_first_second": F.col("first_s") <= 1.0,
        "covers_at_least_90_percent_of_video": F.col("last_s") >= 0.9 * F.col("video_duration_s"),
        # The limits the rules really test, whatever their names say.
        "horizontal_speed_below_80mps": F.col("maximum_horizontal_speed_mps") <= 1000.0,
        "vertical_speed_below_30mps": F.col("maximum_vertical_speed_mps") <= 500.0,
    }
    out = out.select("*", *[c.alias(n) for n, c in checks.items()])
    every = F.col("coordinates_valid") & F.col("timestamps_strictly_increasing")
    for n in checks:
        every = every & F.col(n)
    return out.withColumn("critical_pass", every)


def classify(samples: DataFrame, key: str, hot: bool | None = None) -> DataFrame:
    """Footprint, altitude and speed figures and the recommended keyframe mode."""
    if hot is None:
        hot = is_hot(samples, [key])
    at = F.struct("time_s", "sample_id")
    origin = samples.groupBy(key).agg(
        F.min_by("latitude", at).alias("_lat0"), F.min_by("longitude", at).alias("_lon0")
    )
    placed = samples.join(origin, key)
    x = (F.col("longitude") - F.col("_lon0")) * (METRES_PER_DEGREE * F.cos(F.radians("_lat0")))
    y = (F.col("latitude") - F.col("_lat0")) * METRES_PER_DEGREE
    placed = placed.withColumn("x_m", x).withColumn("y_m", y)
    shape = placed.groupBy(key).agg(
        (F.max("time_s") - F.min("time_s")).alias("duration_s"),
        F.sqrt(
            (F.max("x_m") - F.min("x_m")) * (F.max("x_m") - F.min("x_m"))
            + (F.max("y_m") - F.min("y_m")) * (F.max("y_m") - F.min("y_m"))
        ).alias("area_diagonal_m"),
        (F.max("altitude_m") - F.min("altitude_m")).alias("altitude_range_m"),
        F.stddev_pop("altitude_m").alias("altitude_std_m"),
    )
    kept = greedy_resample(placed, [key], "time_s", ["sample_id"], 1.0, hot=hot)
    moved = ordered(
        kept, [key], ["time_s", "sample_id"],
        {"_prev": lag(F.struct("time_s", "x_m", "y_m", "altitude_m"))}, hot=hot,
    ).filter("_prev is not null")
    p = F.col("_prev")
    dx, dy, dz = F.col("x_m") - p["x_m"], F.col("y_m") - p["y_m"], F.col("altitude_m") - p["altitude_m"]
    moved = moved.withColumn(
        "speed", F.sqrt(dx * dx + dy * dy + dz * dz) / (F.col("time_s") - p["time_s"])
    )
    totals = moved.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(F.col("speed") < 0.5, 1.0).otherwise(0.0)).alias("hover_fraction"),
    )
    # Percentiles pick an element of the sorted speeds; they do not interpolate.
    ranked = ordered(moved.select(key, "speed", "sample_id"), [key], ["speed", "sample_id"], {"_r": rank()}, hot=hot)
    picked = (
        ranked.join(totals, key)
        .groupBy(key)
        .agg(
            F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("speed"))).alias("speed_median_mps"),
            F.max(F.when(F.col("_r") == F.floor(0.95 * (F.col("_n") - 1)) + 1, F.col("speed"))).alias("speed_p95_mps"),
            F.first("hover_fraction").alias("hover_fraction"),
        )
    )
    out = shape.join(picked, key, "left").fillna(0.0, ["speed_median_mps", "speed_p95_mps", "hover_fraction"])
    ratio = F.when(F.col("area_diagonal_m") > 1e-6, F.col("altitude_range_m") / F.col("area_diagonal_m")).otherwise(0.0)
    adaptive = F.col("viewpoint_complexity_ratio") >= 0.05
    return (
        out.withColumn("viewpoint_complexity_ratio", ratio)
        .withColumn("recommended_keyframe_mode", F.when(adaptive, "adaptive").otherwise("geometry"))
        .withColumn("recommended_profile", F.when(adaptive, "verified-fast-adaptive").otherwise("verified-fast"))
        .withColumn("recommended_target_frames", F.lit(120))
        .withColumn("coverage_warning", 253 * F.col("area_diagonal_m") / 507.0 > 120)
    )


# Words in a datum text that tell the height reference.
RELATIVE_HINTS = "rel|takeoff|take_off|agl|above_ground|height_above"
ABSOLUTE_HINTS = "abs|msl|amsl|sea|ellips|wgs|egm|geoid|hae"


def vertical_reference(samples: DataFrame, key: str) -> DataFrame:
    """Whether a flight's heights are true elevations, from the distinct datum texts."""
    # distinct first: a flight has few datum texts however many samples it has
    datums = samples.select(key, "altitude_datum").distinct().groupBy(key).agg(
        F.array_sort(F.collect_set("altitude_datum")).alias("_d")
    )
    text = F.lower(F.array_join("_d", " "))
    every_absolute = (F.size("_d") > 0) & F.forall("_d", lambda d: F.lower(d).rlike(ABSOLUTE_HINTS))
    status = (
        F.when(text.contains("offset"), "offset_applied")
        .when(text.contains("relative"), "relative_to_takeoff")
        .when(every_absolute, "absolute")
        .otherwise("unknown")
    )
    return datums.select(key, F.array_join("_d", "; ").alias("datums"), status.alias("status")).withColumn(
        "heights_are_absolute", F.col("status").isin("absolute", "offset_applied")
    )


def altitude_column_datum(column: F.Column | str):
    """Datum told by the name of the altitude column that was read."""
    name = F.lower(F.trim(column))
    return F.when(name.rlike(RELATIVE_HINTS), "relative_to_takeoff").when(
        name.rlike(ABSOLUTE_HINTS), F.concat(F.lit("absolute ("), name, F.lit(")"))
    )


def position_uncertainty(samples: DataFrame, references: DataFrame, key: str, hot: bool | None = None) -> DataFrame:
    """Median accuracies, distinct sources and the first frame reference as origin."""
    med = grouped(
        samples, [key], [],
        [Quantile("horizontal_accuracy_m_median", F.col("horizontal_accuracy_m"), 0.5),
         Quantile("vertical_accuracy_m_median", F.col("vertical_accuracy_m"), 0.5)], hot=hot,
    )
    sources = samples.select(key, "position_source").distinct().groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("position_source")), ",").alias("position_sources")
    )
    at = F.struct("time_s", "frame_id")
    origin = references.groupBy(key).agg(
        F.count(F.lit(1)).alias("references"),
        F.min_by("latitude", at).alias("origin_latitude"),
        F.min_by("longitude", at).alias("origin_longitude"),
        F.min_by("altitude_m", at).alias("origin_altitude_m"),
    )
    return origin.join(med, key).join(sources, key)
