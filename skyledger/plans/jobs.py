"""Named dataset jobs and scene-parallel runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Loader = Callable[[SparkSession, str], DataFrame]
Job = Callable[[DataFrame], DataFrame]
DATASETS: dict[str, tuple[Loader, dict[str, Job]]] = {}


def dataset(name: str, loader: Loader, **jobs: Job) -> None:
    if name in DATASETS:
        raise ValueError(f"dataset {name} is already known")
    DATASETS[name] = (loader, jobs)


def evaluate(spark: SparkSession, location: str, name: str, job: str) -> DataFrame:
    """Run one metric job of a named dataset."""
    if name not in DATASETS:
        raise KeyError(f"unknown dataset {name}; known: {sorted(DATASETS)}")
    loader, jobs = DATASETS[name]
    return jobs[job](loader(spark, location))


def per_scene(rows: DataFrame, keys: list[str], metrics: dict[str, Column], errors: dict[str, Column] | None = None) -> DataFrame:
    """One row per scene and metric; a scene to which one of the ``errors`` applies gives one row with the first such text.

    Metrics are aggregates over a scene's rows, errors are conditions over aggregates, so scenes of
    any size combine on the map side and a failing one does not stop the others. A null
    condition counts as a failure.
    """
    failed = F.lit(None).cast("string")
    for text, condition in reversed((errors or {}).items()):
        failed = F.when(F.coalesce(condition, F.lit(True)), F.lit(text)).otherwise(failed)
    wide = rows.groupBy(*keys).agg(*[m.cast("double").alias(f"_m{i}") for i, m in enumerate(metrics.values())], failed.alias("error"))
    good = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_m{i}").alias("value")) for i, n in enumerate(metrics)])
    bad = F.array(F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value")))
    return wide.select(*keys, F.inline(F.when(F.col("error").isNull(), good).otherwise(bad)), "error")
