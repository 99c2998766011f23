"""Accuracy reports: checkpoints, distances, camera-against-GPS residuals, capture gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import gates
from ..functions.geo import enu
from ..scale import Quantile, grouped, is_hot


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def rms(v: Column) -> Column:
    return F.sqrt(F.avg(v * v))


def geodetic_known(points: DataFrame, origin: tuple[float, float, float]) -> DataFrame:
    """Fill blank known coordinates from ``known_latitude``, ``known_longitude``, ``known_altitude_m``, local to ``origin``.

    A point with all three local coordinates keeps them; one with neither form stays blank and
    is left out by measured_checkpoints().
    """
    local = [F.col(f"known_{a}_m") for a in "xyz"]
    whole = local[0].isNotNull() & local[1].isNotNull() & local[2].isNotNull()
    place = [F.col(f"known_{c}") for c in ("latitude", "longitude", "altitude_m")]
    found = enu(*place, *map(F.lit, origin))
    return points.withColumns({f"known_{a}_m": F.when(whole, v).otherwise(e) for a, v, e in zip("xyz", local, found)})


def measured_checkpoints(points: DataFrame) -> DataFrame:
    """Signed, horizontal and 3-D errors; rows with a blank coordinate are left out."""
    needed = [f"{side}_{a}_m" for side in ("known", "reconstructed") for a in "xyz"]
    out = points.dropna(subset=needed)
    for a in "xyz":
        out = out.withColumn(f"e{a}", F.col(f"reconstructed_{a}_m") - F.col(f"known_{a}_m"))
    return out.withColumn("horizontal", norm(F.col("ex"), F.col("ey"))).withColumn(
        "three_dimensional", norm(F.col("ex"), F.col("ey"), F.col("ez"))
    )


def error_statistics(points: DataFrame, key: str) -> DataFrame:
    """Population statistics per error component, long."""
    errors = measured_checkpoints(points).withColumn("vertical_absolute", F.abs("ez"))
    long = errors.select(
        key, F.col("ex").alias("x_signed"), F.col("ey").alias("y_signed"), F.col("ez").alias("z_signed"),
        "horizontal", "vertical_absolute", "three_dimensional",
    ).unpivot([key], ["x_signed", "y_signed", "z_signed", "horizontal", "vertical_absolute", "three_dimensional"], "component", "e")
    e = F.col("e")
    return grouped(
        long, [key, "component"],
        [F.count(e).alias("count"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("standard_deviation"),
         F.min(e).alias("minimum"), F.max(e).alias("maximum")],
        [Quantile("median", e, 0.5), Quantile("p95", e, 0.95)],
    )


def checkpoint_report(points: DataFrame, key: str) -> DataFrame:
    e = {a: F.col(f"e{a}") for a in "xyz"}
    out = grouped(
        measured_checkpoints(points), [key],
        [
            F.count(F.lit(1)).alias("checks"),
            rms(F.col("three_dimensional")).alias("rmse_3d_m"),
            *[rms(e[a]).alias(f"rmse_{a}_m") for a in "xyz"],
            rms(F.col("horizontal")).alias("rmse_horizontal_m"),
            *[F.avg(e[a]).alias(f"bias_{a}_m") for a in "xyz"],
            F.max("three_dimensional").alias("maximum_3d_error_m"),
        ],
        [Quantile("median_3d_error_m", F.col("three_dimensional"), 0.5),
         Quantile("p95_3d_error_m", F.col("three_dimensional"), 0.95)],
    )
    n = F.col("checks")
    return out.withColumn(
        "passes_one_metre_target", (n >= 3) & (F.col("maximum_3d_error_m") <= 1.0)
    ).withColumn(
        "checkpoint_count_status",
        F.when(n >= 30, "checkpoint_count_compliant").when(n >= 3, "reduced_assessment").otherwise("insufficient_checkpoints"),
    )


# Accepted survey uncertainty columns.
UNCERTAINTY_ALIASES = {
    "x": ("x_uncertainty_m", "uncertainty_x_m", "checkpoint_x_uncertainty_m", "survey_x_uncertainty_m"),
    "y": ("y_uncertainty_m", "uncertainty_y_m", "checkpoint_y_uncertainty_m", "survey_y_uncertainty_m"),
    "z": ("z_uncertainty_m", "uncertainty_z_m", "checkpoint_z_uncertainty_m", "survey_z_uncertainty_m"),
    "horizontal": ("horizontal_uncertainty_m", "checkpoint_horizontal_uncertainty_m",
                   "survey_horizontal_uncertainty_m", "horizontal_accuracy_m"),
    "vertical": ("vertical_uncertainty_m", "checkpoint_vertical_uncertainty_m",
                 "survey_vertical_uncertainty_m", "vertical_accuracy_m"),
}


def uncertainty_map(points: DataFrame) -> Column:
    """Per-row map of the uncertainty values given; a value must be finite and not negative."""
    entries = []
    for component, names in UNCERTAINTY_ALIASES.items():
        present = [F.col(n).cast("double") for n in names if n in points.columns]
        if present:
            v = F.coalesce(*present)
            bad = F.isnan(v) | (v < 0) | (v == float("inf"))
            v = F.when(bad, F.raise_error(F.lit(f"uncertainty {component} must be finite and not negative")).cast("double")).otherwise(v)
            entries.append(F.when(v.isNotNull(), F.struct(F.lit(component).alias("k"), v.alias("v"))))
    if not entries:
        return F.create_map().cast("map<string,double>")
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def distance_report(rows: DataFrame, key: str) -> DataFrame:
    measured = norm(*[F.col(f"{a}2_m") - F.col(f"{a}1_m") for a in "xyz"])
    e = rows.withColumn("_e", measured - F.col("known_distance_m"))
    return e.groupBy(key).agg(
        F.count("_e").alias("checks"), rms(F.col("_e")).alias("distance_rmse_m"),
        F.max(F.abs("_e")).alias("maximum_absolute_error_m"),
        gates.surely(F.max(F.abs("_e")) <= 1.0).alias("passes_one_metre_target"),
    )


def camera_residuals(references: DataFrame, cameras: DataFrame, key: str) -> DataFrame:
    """Per-camera residual against its interpolated fix in the first reference's ENU frame."""
    origin = references.groupBy(key).agg(
        F.min_by(F.struct("latitude", "longitude", "altitude_m"), F.struct("time_s", "frame_id")).alias("_o")
    )
    o = F.col("_o")
    both = references.join(cameras, [key, "frame_id"]).join(origin, key)
    e, n, u = enu(
        F.col("latitude"), F.col("longitude"), F.col("altitude_m"), o["latitude"], o["longitude"], o["altitude_m"]
    )
    out = both.withColumn("east_m", F.col("cx") - e).withColumn("north_m", F.col("cy") - n).withColumn("up_m", F.col("cz") - u)
    h, v = F.col("horizontal_accuracy_m"), F.col("vertical_accuracy_m")
    sigma = norm(F.col("east_m") / h, F.col("north_m") / h, F.col("up_m") / v)
    return out.withColumn("residual_m", norm(F.col("east_m"), F.col("north_m"), F.col("up_m"))).withColumn(
        "residual_sigma", F.when((h > 0) & (v > 0), sigma)
    )


def gps_report(residuals: DataFrame, key: str) -> DataFrame:
    return grouped(
        residuals, [key],
        [
            F.count(F.lit(1)).alias("matched_cameras"), rms(F.col("residual_m")).alias("rmse_m"),
            rms(F.col("east_m")).alias("rmse_east_m"), rms(F.col("north_m")).alias("rmse_north_m"),
            rms(F.col("up_m")).alias("rmse_up_m"),
        ],
        [Quantile("median_m", F.col("residual_m"), 0.5), Quantile("p95_m", F.col("residual_m"), 0.95),
         Quantile("median_sigma", F.col("residual_sigma"), 0.5)],
    )


# Advice for each failed capture gate.
ADVICE = {
    "readable_ok": "Repair or extract again the frames that cannot be read.",
    "blur_ok": "Use a faster shutter, slower flight, and calmer conditions.",
    "exposure_ok": "Avoid clipped shadows/highlights and keep exposure consistent.",
    "overlap_ok": "Increase overlap or sampling rate; target about 80% forward and 70% side overlap.",
    "parallax_ok": "Reduce redundant frames or increase the geometry baseline between anchors.",
    "telemetry_ok": "Repair telemetry timing/position outliers or use RTK/PPK before reconstruction.",
    "stabilisation_ok": "Disable digital stabilization so that the camera model stays fixed.",
    "shutter_ok": "Reduce flight speed/yaw rate or use a global-shutter camera.",
}


def capture_gates(frames: DataFrame, telemetry: DataFrame, key: str, calibrations: DataFrame | None = None) -> DataFrame:
    """Share of blurred, clipped, weakly linked and near-duplicate frames, gated with telemetry and calibration.

    ``readable`` of a frame is fail-closed: null is unreadable. Unreadable frames fail their clip
    and have no part in blur and exposure. ``calibrations`` (key, digital_stabilization, readout_ms)
    has at most one row a clip; a clip without one passes both of its gates, one whose
    stabilisation is unknown does not.
    """
    readable = gates.surely(F.col("readable"))
    seen = frames.withColumn("_seen", readable)
    hot = is_hot(frames, [key])
    median = grouped(seen, [key], [F.min_by("frame_id", F.struct("time_s", "frame_id")).alias("_first")],
                     [Quantile("sharpness_median", F.when(F.col("_seen"), F.col("sharpness")), 0.5)], hot=hot)
    linked = F.col("frame_id") != F.col("_first")  # the first frame has no pair before it

    def share(condition: Column, over: Column) -> Column:
        return F.coalesce(F.avg(F.when(over, F.when(condition, 1.0).otherwise(0.0))), F.lit(0.0))

    shares = seen.join(median, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(~F.col("_seen")).alias("unreadable_frames"),
        F.coalesce(F.first("sharpness_median"), F.lit(0.0)).alias("sharpness_median"),
        share(F.col("sharpness") < F.greatest(F.lit(25.0), 0.25 * F.col("sharpness_median")), F.col("_seen")).alias("blurred_fraction"),
        share((F.col("clipped_dark") > 0.2) | (F.col("clipped_bright") > 0.2), F.col("_seen")).alias("poor_exposure_fraction"),
        share(F.col("tracked_fraction") < 0.35, linked).alias("low_overlap_fraction"),
        share(F.col("parallax_px") < 0.5, linked).alias("near_duplicate_fraction"),
    )
    out = shares.join(
        telemetry.select(key, "duplicate_or_reversed_timestamps", "telemetry_gap_count", "probable_position_jumps", "speed_mps_p95"), key
    )
    if calibrations is None:
        out = out.withColumn("_calibrated", F.lit(False)).withColumn("_stable", F.lit(None).cast("boolean")).withColumn("_readout", F.lit(0.0))
    else:
        told = calibrations.select(
            key, F.lit(True).alias("_calibrated"), F.col("digital_stabilization").alias("_stable"), F.col("readout_ms").alias("_readout")
        )
        out = out.join(told, key, "left")
    rules = {
        "readable_ok": F.col("unreadable_frames") == 0,
        "blur_ok": F.col("blurred_fraction") <= 0.10,
        "exposure_ok": F.col("poor_exposure_fraction") <= 0.10,
        "overlap_ok": F.col("low_overlap_fraction") <= 0.10,
        "parallax_ok": F.col("near_duplicate_fraction") <= 0.25,
        "timestamps_ok": F.col("duplicate_or_reversed_timestamps") == 0,
        "telemetry_ok": (F.col("telemetry_gap_count") == 0) & (F.col("probable_position_jumps") == 0),
        "stabilisation_ok": ~gates.surely(F.col("_calibrated")) | gates.surely(~F.col("_stable")),
        "shutter_ok": ~((F.coalesce("_readout", F.lit(0.0)) > 10) & (F.coalesce("speed_mps_p95", F.lit(0.0)) > 8)),
    }
    advice = F.array_join(F.array_compact(F.array(*[F.when(~gates.surely(rules[g]), F.lit(t)) for g, t in ADVICE.items()])), " ")
    return out.select(
        key, "frames", "unreadable_frames", "sharpness_median", "blurred_fraction", "poor_exposure_fraction", "low_overlap_fraction",
        "near_duplicate_fraction", *[c.alias(n) for n, c in rules.items()],
        gates.all_known_true(list(rules.values())).alias("ready"), advice.alias("recommendations"),
    )


def registration(frames: DataFrame, cameras: DataFrame, key: str, name: str) -> DataFrame:
    """Selected, registered and missing counts per key."""
    seen = cameras.select(key, name).distinct()
    flagged = frames.join(seen.withColumn("_in", F.lit(1)), [key, name], "left")
    return flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("selected"), F.count("_in").alias("registered"),
        F.count_if(F.col("_in").isNull()).alias("missing"),
        (100.0 * F.count("_in") / F.count(F.lit(1))).alias("registration_percent"),
    )
