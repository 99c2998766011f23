"""Skew-safe ordered scans and exact quantiles.

One flight, sensor or raster may hold a third of all rows. Window functions and exact
percentiles put one group in one task, so each helper first measures the largest group
(one map-side-combined count). Groups up to ``MAX_GROUP_ROWS`` take the plain Spark
operator; larger ones are range-partitioned on (key, order), which splits any group, and
the parts are stitched with one carry row per part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from .session import cut_lineage

MAX_GROUP_ROWS = 2_000_000
PART_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def is_hot(df: DataFrame, keys: list[str]) -> bool:
    return largest_group(df, keys) > MAX_GROUP_ROWS


@dataclass(frozen=True)
class Ordered:
    """One ordered output: lag, lead, total, peak, known, upcoming or rank."""

    kind: str
    value: Column | None = None


def lag(value: Column) -> Ordered:
    return Ordered("lag", value)


def lead(value: Column) -> Ordered:
    return Ordered("lead", value)


def running_sum(value: Column) -> Ordered:
    return Ordered("total", value)


def running_max(value: Column) -> Ordered:
    return Ordered("peak", value)


def last_known(value: Column) -> Ordered:
    """Latest non-null value up to and including this row."""
    return Ordered("known", value)


def next_known(value: Column) -> Ordered:
    """Earliest non-null value from this row on."""
    return Ordered("upcoming", value)


def rank() -> Ordered:
    return Ordered("rank")


def _local(spec: Ordered, keys: list[str], order: list[str]) -> Column:
    forward = W.partitionBy(*keys).orderBy(*order)
    so_far = forward.rowsBetween(W.unboundedPreceding, 0)
    if spec.kind == "lag":
        return F.lag(spec.value).over(forward)
    if spec.kind == "lead":
        return F.lead(spec.value).over(forward)
    if spec.kind == "total":
        return F.sum(spec.value).over(so_far)
    if spec.kind == "peak":
        return F.max(spec.value).over(so_far)
    if spec.kind == "known":
        return F.last(spec.value, ignorenulls=True).over(so_far)
    if spec.kind == "upcoming":
        # A descending running frame is linear; an unbounded-following frame is quadratic.
        back = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        return F.last(spec.value, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    return F.row_number().over(forward)


def _part_summary(spec: Ordered, order: list[str]) -> Column:
    position = F.struct(*order)
    boxed = None if spec.value is None else F.struct(spec.value.alias("v"))
    if spec.kind == "lag":
        return F.max_by(boxed, position)
    if spec.kind == "lead":
        return F.min_by(boxed, position)
    if spec.kind == "total":
        return F.struct(F.sum(spec.value).alias("v"))
    if spec.kind == "peak":
        return F.struct(F.max(spec.value).alias("v"))
    if spec.kind == "known":
        return F.max_by(boxed, F.when(spec.value.isNotNull(), position))
    if spec.kind == "upcoming":
        return F.min_by(boxed, F.when(spec.value.isNotNull(), position))
    return F.struct(F.count(F.lit(1)).cast("int").alias("v"))


def _carry(spec: Ordered, name: str, keys: list[str]) -> Column:
    parts = W.partitionBy(*keys).orderBy("_part")
    before = parts.rowsBetween(W.unboundedPreceding, -1)
    value = F.col(name)["v"]
    if spec.kind == "lag":
        return F.lag(value).over(parts)
    if spec.kind == "lead":
        return F.lead(value).over(parts)
    if spec.kind in ("total", "rank"):
        return F.sum(value).over(before)
    if spec.kind == "peak":
        return F.max(value).over(before)
    if spec.kind == "known":
        return F.last(value, ignorenulls=True).over(before)
    back = W.partitionBy(*keys).orderBy(F.col("_part").desc())
    return F.last(value, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: dict[str, Ordered],
    hot: bool | None = None,
    part_rows: int | None = None,
) -> DataFrame:
    """Add ordered columns per key. ``order`` must be unique per key."""
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        return df.select("*", *[_local(s, keys, order).alias(n) for n, s in outputs.items()])
    rows = df.count()
    parts = max(2, math.ceil(rows / (part_rows or PART_ROWS)))
    # The written copy fixes the part of every row for both reads below.
    split = cut_lineage(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    summary = split.groupBy("_part", *keys).agg(
        *[_part_summary(s, order).alias(n) for n, s in outputs.items()]
    )
    # Only keys that span parts need a carry: at most two rows per part, so a bounded broadcast.
    spanning = summary.withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy(*keys))).filter("_parts > 1")
    carries = spanning.select(
        F.col("_part").alias("_c_part"),
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[_carry(s, n, keys).alias(f"_c_{n}") for n, s in outputs.items()],
    )
    local = split.select(
        "*",
        *[_local(s, ["_part", *keys], order).alias(n) for n, s in outputs.items()],
        F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)).alias("_from_start"),
        F.row_number()
        .over(W.partitionBy("_part", *keys).orderBy(*[F.col(c).desc() for c in order]))
        .alias("_from_end"),
    )
    on = F.col("_part") == F.col("_c_part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    joined = local.join(F.broadcast(carries), on, "left")
    stitched = []
    for name, spec in outputs.items():
        here, before = F.col(name), F.col(f"_c_{name}")
        if spec.kind == "lag":
            stitched.append(F.when(F.col("_from_start") == 1, before).otherwise(here).alias(name))
        elif spec.kind == "lead":
            stitched.append(F.when(F.col("_from_end") == 1, before).otherwise(here).alias(name))
        elif spec.kind in ("total", "rank"):
            stitched.append(
                F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0))).alias(name)
            )
        elif spec.kind == "peak":
            stitched.append(F.greatest(here, before).alias(name))
        else:
            stitched.append(F.coalesce(here, before).alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *stitched)


@dataclass(frozen=True)
class Quantile:
    name: str
    value: Column
    q: float


def grouped(
    df: DataFrame,
    keys: list[str],
    aggregates: list[Column],
    quantiles: list[Quantile],
    hot: bool | None = None,
) -> DataFrame:
    """Aggregate with exact linear-interpolated quantiles, also for groups too big for one task."""
    if not keys:
        whole = df.withColumn("_whole", F.lit(1))
        return grouped(whole, ["_whole"], aggregates, quantiles, hot).drop("_whole")
    if hot is None:
        hot = is_hot(df, keys)
    if not hot:
        return df.groupBy(*keys).agg(
            *aggregates, *[F.percentile(q.value, F.lit(q.q)).alias(q.name) for q in quantiles]
        )
    result = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    by_value: dict[str, list[Quantile]] = {}
    columns: dict[str, Column] = {}
    for q in quantiles:
        by_value.setdefault(str(q.value), []).append(q)
        columns[str(q.value)] = q.value
    for text, wanted in by_value.items():
        part = _split_quantiles(df, keys, columns[text], wanted)
        renamed = part.select(*[F.col(k).alias(f"_q_{k}") for k in keys], *[w.name for w in wanted])
        on = [F.col(k).eqNullSafe(F.col(f"_q_{k}")) for k in keys]
        result = result.join(renamed, on, "left").drop(*[f"_q_{k}" for k in keys])
    return result


def _split_quantiles(df: DataFrame, keys: list[str], value: Column, wanted: list[Quantile]) -> DataFrame:
    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .filter("_v is not null")
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = ordered(counts, keys, ["_v"], {"_upto": running_sum(F.col("_n"))}, hot=True)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    renamed = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_total")
    ranked = upto.join(renamed, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys])
    picks = []
    for w in wanted:
        spot = F.lit(w.q) * (F.col("_total") - 1)
        picks.append(F.min(F.when(F.col("_upto") > F.floor(spot), F.col("_v"))).alias(f"_lo_{w.name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(spot), F.col("_v"))).alias(f"_hi_{w.name}"))
    ends = ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *picks)
    return ends.select(
        *keys,
        *[
            (
                F.col(f"_lo_{w.name}")
                + (F.col(f"_hi_{w.name}") - F.col(f"_lo_{w.name}"))
                * (F.lit(w.q) * (F.col("_total") - 1) - F.floor(F.lit(w.q) * (F.col("_total") - 1)))
            ).alias(w.name)
            for w in wanted
        ],
    )
