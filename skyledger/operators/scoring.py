"""Surface scores, voxel thinning, outlier limits and crops of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import Quantile, grouped
from ..session import cut_lineage
from .neighbors import mean_neighbour_distance, nearest_distance


def both_ways(points: DataFrame, by: list[str], a: str = "reconstruction", b: str = "reference") -> DataFrame:
    """Nearest distances in both directions, tagged ``forward`` and ``reverse``, in one join; nothing else of a point travels."""
    pair = points.filter(F.col("cloud").isin(a, b)).select(*by, "cloud", "x", "y", "z")
    forward = F.col("cloud") == a
    sources = pair.withColumn("direction", F.when(forward, "forward").otherwise("reverse")).drop("cloud")
    targets = pair.withColumn("direction", F.when(forward, "reverse").otherwise("forward")).drop("cloud")
    return cut_lineage(nearest_distance(sources, targets, [*by, "direction"]).select(*by, "direction", "distance"))


def distance_summary(distances: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("distance")
    return grouped(
        distances.filter(d.isNotNull()), keys,
        [F.count(d).alias("samples"), F.avg(d).alias("mean_m"), F.sqrt(F.avg(d * d)).alias("rmse_m"), F.max(d).alias("maximum_m")],
        [Quantile("median_m", d, 0.5), Quantile("p95_m", d, 0.95)],
    )


def threshold_scores(distances: DataFrame, by: list[str], thresholds: list[float], strict: bool = False) -> DataFrame:
    """Precision, recall and F1 per threshold; one aggregate over the distances."""
    def hit(t: float) -> Column:
        inside = F.col("distance") < t if strict else F.col("distance") <= t
        return F.when(inside, 1.0).otherwise(0.0)

    forward, reverse = F.col("direction") == "forward", F.col("direction") == "reverse"
    wide = distances.groupBy(*by).agg(*[
        F.struct(
            F.lit(t).alias("threshold_m"),
            F.avg(F.when(forward, hit(t))).alias("precision"), F.avg(F.when(reverse, hit(t))).alias("recall"),
        ).alias(f"_t{i}")
        for i, t in enumerate(thresholds)
    ])
    rows = wide.select(*by, F.explode(F.array(*[F.col(f"_t{i}") for i in range(len(thresholds))])).alias("_t")).select(*by, "_t.*")
    p, q = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + q > 0, 2.0 * p * q / (p + q)).otherwise(0.0))


def reconstruction_score(distances: DataFrame, by: list[str], threshold: float, cap: float | None = None) -> DataFrame:
    """Accuracy, completeness, their mean, and F-score under a strict threshold."""
    d = F.col("distance")
    used = d if cap is None else F.when(d < cap, d)
    forward, reverse = F.col("direction") == "forward", F.col("direction") == "reverse"
    near = F.when(d < threshold, 1.0).otherwise(0.0)
    out = distances.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(forward, used)), F.lit(float("inf"))).alias("accuracy"),
        F.coalesce(F.avg(F.when(reverse, used)), F.lit(float("inf"))).alias("completeness"),
        F.coalesce(F.avg(F.when(forward, near)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.when(reverse, near)), F.lit(0.0)).alias("recall"),
    )
    p, q = F.col("precision"), F.col("recall")
    return out.withColumn("overall", (F.col("accuracy") + F.col("completeness")) / 2).withColumn(
        "fscore", F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    )


def voxel_means(points: DataFrame, by: list[str], size: float) -> DataFrame:
    """One mean point per voxel, on a grid starting half a voxel below each group's minimum.

    Coordinates are summed as whole nanometres, so the mean is the same in whatever order
    tasks deliver the rows; float sums would differ in the last digit from one read to the next.
    """
    corner = points.groupBy(*by).agg(*[(F.min(d) - size / 2).alias(f"_o_{d}") for d in ("x", "y", "z")])
    cells = [F.floor((F.col(d) - F.col(f"_o_{d}")) / size).alias(f"v{d}") for d in ("x", "y", "z")]
    return points.join(corner, by).groupBy(*by, *cells).agg(
        *[(F.sum(F.rint(F.col(d) * 1e9).cast("bigint")) / F.count(F.lit(1)) / 1e9).alias(d) for d in ("x", "y", "z")],
        F.count(F.lit(1)).alias("points"),
    )


def outlier_limits(points: DataFrame, by: list[str], neighbours: int = 12, multiplier: float = 4.0) -> DataFrame:
    """Points with their mean neighbour distance, the group's limit and whether they stay."""
    d = F.col("mean_distance")
    measured = cut_lineage(mean_neighbour_distance(points, by, neighbours))  # read four times below
    middle = grouped(measured, by, [F.count(F.lit(1)).alias("_n")], [Quantile("median_m", d, 0.5), Quantile("_far", d, 0.995)])
    joined = measured.join(middle, by)
    spread = grouped(joined, by, [], [Quantile("_mad", F.abs(d - F.col("median_m")), 0.5)])
    limits = middle.join(spread, by)
    sigma = 1.4826 * F.col("_mad")
    limits = limits.withColumn(
        "_limit", F.when(sigma <= 2.220446049250313e-16, F.col("_far")).otherwise(F.col("median_m") + multiplier * sigma)
    )
    kept = measured.join(limits, by).groupBy(*by).agg(F.count_if(d <= F.col("_limit")).alias("_kept"))
    limits = limits.join(kept, by)
    few = F.col("_kept") < F.greatest(F.lit(32), F.floor(0.5 * F.col("_n")))
    skip = F.col("_n") < max(32, neighbours + 2)
    limits = limits.select(*by, "median_m", F.when(skip, F.lit(None)).when(few, F.col("_far")).otherwise(F.col("_limit")).alias("limit_m"))
    return measured.join(limits, by).withColumn("keep", F.col("limit_m").isNull() | (d <= F.col("limit_m")))


def crop_to_box(points: DataFrame, box_of: DataFrame, by: list[str], margin: float) -> DataFrame:
    """Points inside the axis-aligned bounds of another cloud, with a margin."""
    box = box_of.groupBy(*by).agg(*[f(d).alias(f"_{n}_{d}") for d in ("x", "y", "z") for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for d in ("x", "y", "z"):
        inside = inside & (F.col(d) >= F.col(f"_lo_{d}") - margin) & (F.col(d) <= F.col(f"_hi_{d}") + margin)
    return points.join(box, by).filter(inside).select(*points.columns)


def crop_to_mask(points: DataFrame, mask: DataFrame, by: list[str], low: tuple, high: tuple, cell: float, patch: float) -> DataFrame:
    """Points in the padded box whose voxel (half-even rounded) is in the observation mask."""
    inside = F.lit(True)
    keys = []
    for d, lo, hi in zip(("x", "y", "z"), low, high):
        inside = inside & (F.col(d) >= lo - patch) & (F.col(d) < hi + patch * 2)
        keys.append(F.rint((F.col(d) - lo) / cell).cast("bigint").alias(f"v{d}"))
    return points.filter(inside).select("*", *keys).join(mask, [*by, "vx", "vy", "vz"], "left_semi").select(*points.columns)


def above_plane(plane: tuple[float, float, float, float]) -> Column:
    a, b, c, d = plane
    return a * F.col("x") + b * F.col("y") + c * F.col("z") + d > 0


def confident(points: DataFrame, by: list[str], coefficient: float) -> DataFrame:
    """Points whose confidence reaches a share of their group's mean confidence."""
    level = points.groupBy(*by).agg((coefficient * F.avg("conf")).alias("_level"))
    return points.join(level, by).filter((F.col("conf") >= F.col("_level")) & (F.col("conf") > 1e-5)).drop("_level")


def reset_background(conf: Column, r: Column, g: Column, b: Column) -> Column:
    """Confidence one on black or white background pixels."""
    black = (r < 16) & (g < 16) & (b < 16)
    white = (r >= 240) & (g >= 240) & (b >= 240)
    return F.when(black | white, F.lit(1.0)).otherwise(conf)
