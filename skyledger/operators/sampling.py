"""Exact-size seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..scale import ordered, running_sum
from .asof import last_before


def draw(seed: str, *items: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), *items))


def exact_sample(rows: DataFrame, by: list[str], items: list[str], count: int, seed: str) -> DataFrame:
    """``count`` rows per key without replacement, the same for the same seed.

    The rank limit lets Spark cut each partition to ``count`` rows before the shuffle.
    """
    w = W.partitionBy(*by).orderBy(draw(seed, *by, *items), *items)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= count).drop("_r")


def surface_sample(faces: DataFrame, by: str, count: int, seed: int) -> DataFrame:
    """Area-weighted points on triangles with corner structs ``_a``, ``_b``, ``_c``.

    Draws fall on the running area of each mesh and find their face by an as-of lookup.
    """
    def cross(p: str, q: str):
        u = {k: F.col(p)[k] - F.col("_a")[k] for k in "xyz"}
        v = {k: F.col(q)[k] - F.col("_a")[k] for k in "xyz"}
        return [u[i] * v[j] - u[j] * v[i] for i, j in (("y", "z"), ("z", "x"), ("x", "y"))]

    c = cross("_b", "_c")
    area = 0.5 * F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
    sized = faces.withColumn("_area", area).filter(F.col("_area") > 2.220446049250313e-16)
    upto = ordered(sized, [by], ["face_id"], {"_upto": running_sum(F.col("_area"))}).withColumn("_from", F.col("_upto") - F.col("_area"))
    totals = sized.groupBy(by).agg(F.sum("_area").alias("_total"))

    def uniform(tag: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), by, "draw"), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    draws = totals.select(by, "_total", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw")).withColumn("_at", uniform(0) * F.col("_total"))
    hit = last_before(draws, upto, [by], "_at", ["draw"], "_from", ["face_id", "_a", "_b", "_c"])
    first, second = F.sqrt(uniform(1)), uniform(2)
    point = [
        ((1 - first) * F.col("_a")[k] + first * (1 - second) * F.col("_b")[k] + first * second * F.col("_c")[k]).alias(k) for k in "xyz"
    ]
    return hit.select(by, "draw", "face_id", *point)
