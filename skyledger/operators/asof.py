"""As-of interpolation: each probe time gets values mixed from its bracketing samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scale import last_known, next_known, ordered, running_sum


def interpolate(
    probes: DataFrame,
    samples: DataFrame,
    keys: list[str],
    linear: list[str],
    optional: list[str] | None = None,
    nearest: list[str] | None = None,
    probe_time: str = "time_s",
    probe_id: str = "frame_id",
    sample_time: str = "time_s",
    sample_id: str = "sample_id",
    hot: bool | None = None,
) -> DataFrame:
    """One row per probe with interpolated columns.

    Samples and probes are merged on the timeline, so one shuffle on the key (or a range
    partition for a huge key) replaces a theta join. A sample at the probe time is the left
    neighbour; times outside the samples take the end sample as it is.
    """
    optional, nearest = optional or [], nearest or []
    fields = linear + optional + nearest
    kinds = dict(samples.dtypes)
    merged_samples = samples.select(
        *keys,
        F.col(sample_time).cast("double").alias("_t"),
        F.lit(0).alias("_kind"),
        F.col(sample_id).cast("bigint").alias("_id"),
        F.struct(F.col(sample_time).cast("double").alias("t"), *fields).alias("_sample"),
    )
    shape = dict(merged_samples.dtypes)["_sample"]
    merged_probes = probes.select(
        *keys,
        F.col(probe_time).cast("double").alias("_t"),
        F.lit(1).alias("_kind"),
        F.col(probe_id).cast("bigint").alias("_id"),
        F.lit(None).cast(shape).alias("_sample"),
    )
    line = ordered(
        merged_samples.unionByName(merged_probes),
        keys,
        ["_t", "_kind", "_id"],
        {
            "_left": last_known(F.col("_sample")),
            "_right": next_known(F.col("_sample")),
            "_seen": running_sum(1 - F.col("_kind")),
        },
        hot=hot,
    ).filter("_kind = 1")
    left, right = F.col("_left"), F.col("_right")
    at_first = (F.col("_seen") == 1) & (left["t"] == F.col("_t"))
    clamp_left = right.isNull() | at_first
    ratio = (F.col("_t") - left["t"]) / (right["t"] - left["t"])
    line = line.withColumn("_ratio", F.when(~(left.isNull() | clamp_left), ratio))
    out = []
    for name in linear + optional:
        a, b = left[name], right[name]
        mixed = a + F.col("_ratio") * (b - a)
        if name in optional:
            mixed = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(mixed)
        out.append(F.when(left.isNull(), b).when(clamp_left, a).otherwise(mixed).alias(name))
    for name in nearest:
        a, b = left[name], right[name]
        side = F.when(F.col("_ratio") < 0.5, a).otherwise(b)
        out.append(F.when(left.isNull(), b).when(clamp_left, a).otherwise(side).cast(kinds[name]).alias(name))
    return line.filter(left.isNotNull() | right.isNotNull()).select(
        *keys, F.col("_id").alias(probe_id), F.col("_t").alias(probe_time), *out
    )


def last_before(
    probes: DataFrame,
    table: DataFrame,
    keys: list[str],
    probe_at: str,
    probe_id: list[str],
    table_at: str,
    fields: list[str],
    hot: bool | None = None,
) -> DataFrame:
    """Each probe with ``fields`` of the last table row at or before it (null when none)."""
    left = table.select(
        *keys, F.col(table_at).cast("double").alias("_t"), F.lit(0).alias("_kind"),
        F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_probe"),
        F.struct(*fields).alias("_row"),
    )
    right = probes.select(
        *keys, F.col(probe_at).cast("double").alias("_t"), F.lit(1).alias("_kind"),
        F.struct(*probes.columns).alias("_probe"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
    )
    ties = {f"_tie_{i}": F.col("_probe")[c] for i, c in enumerate(probe_id)}
    line = left.unionByName(right).withColumns(ties)
    found = ordered(line, keys, ["_t", "_kind", *ties], {"_last": last_known(F.col("_row"))}, hot=hot)
    return found.filter("_kind = 1").select("_probe.*", *[F.col("_last")[f].alias(f) for f in fields])
