"""Depth-frame pixels: world points, statistics, thresholds, budgets and overlap pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import camera
from ..functions.text import finite
from ..scale import Quantile, grouped, ordered, rank


def explode_frames(frames: DataFrame) -> DataFrame:
    """Pixels of ``depth_frames`` rows (flattened depth and conf arrays with h and w)."""
    keep = [c for c in frames.columns if c not in ("depth", "conf")]
    cells = frames.select(*keep, F.posexplode(F.arrays_zip("depth", "conf")).alias("pixel", "_z"))
    return cells.select(
        *keep, "pixel", (F.col("pixel") % F.col("w")).alias("u"), F.floor(F.col("pixel") / F.col("w")).alias("v"),
        F.col("_z.depth").alias("depth"), F.col("_z.conf").alias("conf"),
    )


def check_pose_counts(frames: DataFrame, poses: DataFrame, key: str, frame: str) -> DataFrame:
    """Sequences whose frames and poses do not match one to one."""
    both = frames.select(key, frame, F.lit(1).alias("_f")).join(
        poses.select(key, frame, F.lit(1).alias("_p")), [key, frame], "full"
    )
    return both.groupBy(key).agg(
        F.count_if(F.col("_p").isNull()).alias("frames_without_pose"), F.count_if(F.col("_f").isNull()).alias("poses_without_frame")
    ).filter("frames_without_pose + poses_without_frame > 0")


def valid() -> Column:
    d, c = F.col("depth"), F.col("conf")
    return finite(d) & (d > 0) & finite(c)


def strided(stride: int) -> Column:
    return (F.col("u") % stride == 0) & (F.col("v") % stride == 0)


def world_points(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """World x, y, z of valid pixels; ``pixels`` carries a camera-to-world quaternion and position."""
    q = [F.col(f"q{c}") for c in "wxyz"]
    x, y, z = camera.back_project(
        F.col("u"), F.col("v"), F.col("depth"), fx, fy, cx, cy, camera.rotation(*q), [F.col(f"t{c}") for c in "xyz"]
    )
    return pixels.filter(valid()).select("*", x.alias("x"), y.alias("y"), z.alias("z"))


def run_statistics(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Valid share and confidence figures."""
    good = finite(F.col("depth")) & (F.col("depth") > 0)
    conf = F.when(finite(F.col("conf")), F.col("conf"))
    return grouped(
        pixels, keys,
        [F.count(F.lit(1)).alias("pixels"), F.count_if(good).alias("valid_depth_pixels"),
         (100.0 * F.avg(F.when(good, 1.0).otherwise(0.0))).alias("valid_depth_percentage"), F.avg(conf).alias("mean_confidence")],
        [Quantile("median_confidence", conf, 0.5)],
    )


def confidence_threshold(pixels: DataFrame, keys: list[str], base: float, low: float, high: float, sky: float = 0.3) -> DataFrame:
    """Base threshold held between two confidence quantiles of non-sky pixels, when over ten exist."""
    open_sky = F.when(F.col("sky") < sky, F.col("conf"))
    out = grouped(pixels, keys, [F.count(open_sky).alias("_n")], [Quantile("_lo", open_sky, low), Quantile("_hi", open_sky, high)])
    bounded = F.least(F.greatest(F.lit(base), F.col("_lo")), F.col("_hi"))
    return out.select(*keys, F.col("_n").alias("non_sky_pixels"), F.when(F.col("_n") > 10, bounded).otherwise(F.lit(base)).alias("threshold"))


def normalised_inverse_depth(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """One minus the clipped 2-98 percentile position of 1/depth, per frame."""
    inv = F.when(F.col("depth") > 0, 1.0 / F.col("depth"))
    span = grouped(pixels, keys, [F.count(inv).alias("_n")], [Quantile("_lo", inv, 0.02), Quantile("_hi", inv, 0.98)])
    few = F.col("_n") <= 10
    span = span.select(*keys, F.when(few, 0.0).otherwise(F.col("_lo")).alias("_lo"), F.when(few, 0.0).otherwise(F.col("_hi")).alias("_hi"))
    same = F.col("_lo") == F.col("_hi")
    lo, hi = F.when(same, F.col("_lo") - 1e-6).otherwise(F.col("_lo")), F.when(same, F.col("_hi") + 1e-6).otherwise(F.col("_hi"))
    place = (F.coalesce(inv, F.lit(0.0)) - lo) / (hi - lo)
    return pixels.join(span, keys).withColumn("shade", 1.0 - F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def metric_scale(depth: Column, fx, fy) -> Column:
    return depth * ((fx + fy) / 2.0 / 300.0)


def alignment_mask(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels fit for depth alignment, and depth with the sky pushed to its far value."""
    middle = grouped(pixels, keys, [], [Quantile("_median", F.col("conf"), 0.5)])
    clear = F.col("sky") < 0.3
    fit = (F.col("conf") >= F.col("_median")) & clear & (F.col("metric_depth") > 1e-2) & (F.col("depth") > 1e-3)
    return pixels.join(middle, keys).select(
        *pixels.columns, fit.alias("fit"), F.when(clear, F.col("depth")).otherwise(200.0).alias("filled_depth"),
        F.when(clear, F.col("conf")).otherwise(1.0).alias("filled_conf"),
    )


def point_budget(counts: DataFrame, key: str, frame: str, budget: int) -> DataFrame:
    """Largest-remainder shares of a point budget over the frames of each key."""
    totals = counts.groupBy(key).agg(F.sum("valid").alias("_total"))
    share = F.col("valid") * (F.least(F.lit(budget), F.col("_total")) / F.col("_total"))
    shared = counts.join(totals, key).withColumn("_share", share).withColumn("_take", F.floor("_share"))
    left = shared.groupBy(key).agg((F.least(F.lit(budget), F.first("_total")) - F.sum("_take")).alias("_left"))
    ranked = ordered(
        shared.withColumn("_down", F.col("_take") - F.col("_share")), [key], ["_down", frame], {"_place": rank()}
    )
    extra = F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0)
    return ranked.join(left, key).select(key, frame, "valid", (F.col("_take") + extra).alias("take"))


def stride_to_budget(pixels: DataFrame, budget: DataFrame, key: str, frame: str) -> DataFrame:
    """Valid pixels at the truncated even positions that meet each frame's share."""
    placed = ordered(pixels.filter(valid()), [key, frame], ["pixel"], {"_place": rank()}).join(budget, [key, frame])
    n, k, i = F.col("valid"), F.col("take"), F.col("_place") - 1
    # position i is picked when some whole j satisfies floor(j (n - 1) / (k - 1)) = i
    j = F.ceil(i * (k - 1) / (n - 1))
    step = (n - 1) / (k - 1)
    hit = (j < k) & (F.floor(j * step) == i)
    picked = (k >= n) | F.when(k == 1, i == 0).otherwise(hit)
    return placed.filter((k > 0) & picked).drop("_place", "valid", "take")


def overlap_pairs(points: DataFrame, keys: list[str], min_conf_share: float | None = None) -> DataFrame:
    """The same frame and pixel seen from adjacent windows, weighted by both confidences."""
    if min_conf_share is not None:
        middle = grouped(points, [keys[0], "chunk"], [], [Quantile("_median", F.col("conf"), 0.5)])
        points = points.join(middle, [keys[0], "chunk"])
    a = points.select(*keys, F.col("chunk").alias("chunk_a"), *[F.col(c).alias(f"{c}_a") for c in ("x", "y", "z", "conf")],
                      *([F.col("_median").alias("_ma")] if min_conf_share is not None else []))
    b = points.select(*keys, (F.col("chunk") - 1).alias("chunk_a"), *[F.col(c).alias(f"{c}_b") for c in ("x", "y", "z", "conf")],
                      *([F.col("_median").alias("_mb")] if min_conf_share is not None else []))
    pairs = a.join(b, [*keys, "chunk_a"]).filter((F.col("conf_a") > 0) & (F.col("conf_b") > 0))
    if min_conf_share is not None:
        floor = min_conf_share * F.least("_ma", "_mb")
        pairs = pairs.filter((F.col("conf_a") > floor) & (F.col("conf_b") > floor)).drop("_ma", "_mb")
    return pairs.withColumn("weight", F.sqrt(F.sqrt("conf_a") * F.sqrt("conf_b")))
