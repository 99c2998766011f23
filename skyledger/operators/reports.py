"""Run comparison, ranking and gates over flattened run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import gates, text

METRICS = (
    "runtime_s", "registration_percent", "reprojection_px", "gps_rmse_m", "points", "dsm_fraction", "mesh_components",
)


def with_reference(runs: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Each run beside the first run of its benchmark, as ``ref_*`` columns.

    The reference is one row per benchmark, found by a map-side combined minimum.
    """
    first = runs.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c).alias(f"ref_{c}") for c in columns]), order).alias("_ref")
    )
    return runs.join(first, key).select(*runs.columns, "_ref.*")


def metric_changes(paired: DataFrame, *keep: str) -> DataFrame:
    """Long rows of before, after, delta and percent change per metric."""
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("metric"), F.col(f"ref_{m}").cast("double").alias("before"), F.col(m).cast("double").alias("after")
        )
        for m in METRICS
    ]))
    long = paired.select(*keep, cells.alias("_c")).select(*keep, "_c.*")
    delta = F.col("after") - F.col("before")
    return long.withColumn("delta", delta).withColumn(
        "change_percent", F.when(F.col("before") != 0, 100.0 * delta / F.col("before"))
    )


def guardrails() -> dict[str, Column]:
    """Three-valued candidate-against-reference rules."""

    def pair(m: str):
        return F.col(f"ref_{m}"), F.col(m)

    return {
        "runtime_improved": F.col("runtime_s") < F.col("ref_runtime_s"),
        "registration_drop_at_most_1_point": gates.within_delta(*pair("registration_percent"), lower=-1.0),
        "reprojection_increase_at_most_0_03_px": gates.within_delta(*pair("reprojection_px"), upper=0.03),
        "gps_rmse_increase_at_most_0_15_m": gates.within_delta(*pair("gps_rmse_m"), upper=0.15),
        "point_count_retains_75_percent": gates.retains_ratio(*pair("points"), 0.75),
        "dsm_coverage_retains_95_percent": gates.retains_ratio(*pair("dsm_fraction"), 0.95),
        "mesh_components_increase_at_most_3": gates.within_delta(*pair("mesh_components"), upper=3.0),
    }


def conflicts() -> Column:
    """Comma-joined codes of report places that disagree; missing places are ignored."""

    def differing(*columns: str) -> Column:
        return F.size(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in columns])))) > 1

    duration = F.col("duration_b_s").isNotNull() & ~gates.same_duration(F.col("duration_s"), F.col("duration_b_s"))
    return gates.reasons([
        (differing("selected_frames", "selected_frames_b"), "selected_frame_count_conflict"),
        (duration, "video_duration_conflict"),
        (differing("target_frames", "target_frames_b"), "target_frame_count_conflict"),
    ])


def surface_evidence(runs: DataFrame) -> DataFrame:
    """Preferred valid evidence: dense geometry, then checkpoints, then distances."""
    dense = F.col("dense_checks") > 0
    points = F.col("checkpoint_checks") >= 3
    distances = F.col("distance_checks") > 0
    ordered = [("dense_reference_geometry", dense, "dense_checks", None, None),
               ("surveyed_checkpoints", points, "checkpoint_checks", "checkpoint_rmse_m", "checkpoint_max_m"),
               ("independent_distances", distances, "distance_checks", "distance_rmse_m", "distance_max_m")]
    # Without any valid evidence the first one present is reported as invalid.
    rank = F.coalesce(
        *[F.when(gates.surely(ok), F.lit(i)) for i, (_, ok, *_) in enumerate(ordered)],
        *[F.when(F.col(c).isNotNull(), F.lit(i)) for i, (_, _, c, *_) in enumerate(ordered)],
    )

    def pick(values):
        out = F.lit(None)
        for i, v in enumerate(values):
            out = F.when(rank == i, v).otherwise(out)
        return out

    return runs.select(
        "*",
        pick([F.lit(n) for n, *_ in ordered]).alias("evidence_type"),
        pick([F.col(c) for _, _, c, *_ in ordered]).alias("evidence_checks"),
        gates.surely(pick([gates.surely(ok) for _, ok, *_ in ordered])).alias("evidence_valid"),
        pick([F.col(r) if r else F.lit(None).cast("double") for *_, r, _ in ordered]).alias("evidence_rmse_m"),
        pick([F.col(m) if m else F.lit(None).cast("double") for *_, m in ordered]).alias("evidence_max_m"),
    )


def fairness() -> dict[str, Column]:
    """Gates of a fair comparison; anything unknown fails."""

    def same(c: str) -> Column:
        return gates.same_value(F.col(f"ref_{c}"), F.col(c))

    same_set = (
        F.col("ref_evidence_valid") & F.col("evidence_valid") & same("evidence_type") & same("evidence_checks")
    )
    return {
        "baseline_metadata_consistent": F.col("ref_conflict_codes") == "",
        "candidate_metadata_consistent": F.col("conflict_codes") == "",
        "same_video_identity": same("video_id"),
        "same_video_duration": gates.same_duration(F.col("ref_duration_s"), F.col("duration_s")),
        "same_target_frame_count": same("target_frames"),
        "same_selected_frame_count": same("selected_frames"),
        "same_selected_frame_manifest": same("manifest_digest"),
        "same_frame_resolution": same("resolution"),
        "baseline_has_independent_surface_evidence": F.col("ref_evidence_valid"),
        "candidate_has_independent_surface_evidence": F.col("evidence_valid"),
        "same_independent_surface_evidence_set": gates.surely(same_set),
    }


def surface_quality(same_set: Column) -> Column:
    """Failing surface-quality gates for a candidate beside its reference."""
    points = gates.failing({
        "candidate_passes_one_metre_surface_target": F.col("evidence_max_m") <= 1.0,
        "surface_rmse_not_materially_worse": gates.not_materially_higher(F.col("ref_evidence_rmse_m"), F.col("evidence_rmse_m")),
        "surface_maximum_error_not_materially_worse": gates.not_materially_higher(
            F.col("ref_evidence_max_m"), F.col("evidence_max_m")
        ),
    })
    dense = gates.failing({
        "dense_f1_at_all_thresholds_not_materially_worse": F.col("dense_f1") + gates.F1_TOLERANCE >= F.col("ref_dense_f1"),
    })
    return (
        F.when(~gates.surely(same_set), "same_surface_evidence_for_quality")
        .when(F.col("evidence_type") == "dense_reference_geometry", dense)
        .otherwise(points)
    )


# Floors below which a product counts as empty, and their growth per registered image.
GEOMETRY_FLOORS = {
    "points": (1000, 20, "point_cloud_is_substantive"),
    "mesh_vertices": (500, 10, "mesh_vertices_are_substantive"),
    "mesh_faces": (500, 15, "mesh_faces_are_substantive"),
    "dsm_cells": (500, 10, "dsm_has_substantive_valid_area"),
}


def substantive() -> dict[str, Column]:
    return {
        name: gates.at_least(F.col(c).cast("double"), F.greatest(F.lit(floor), F.col("registered_images") * growth))
        for c, (floor, growth, name) in GEOMETRY_FLOORS.items()
    }


def production_gates() -> dict[str, Column]:
    return {
        "capture_quality_passed": F.col("capture_ready"),
        "registration_at_least_90_percent": gates.at_least(F.col("registration_percent"), 90),
        "reprojection_error_at_most_2px": gates.at_most(F.col("reprojection_px"), 2),
        "dsm_coverage_at_least_75_percent": gates.surely(F.col("dsm_fraction") >= 0.75),
        "mesh_has_at_most_20_components": gates.surely(F.col("mesh_components").between(1, 20)),
        "mesh_has_at_most_0_1_percent_oversized_faces": gates.surely(F.col("oversized_fraction") <= 0.001),
        "mesh_is_textured": gates.surely(F.col("textured")),
        "processing_under_15_minutes": gates.surely(F.col("runtime_s") < 900),
        "independent_surface_accuracy_at_most_1m": gates.surely(F.col("evidence_valid") & (F.col("evidence_max_m") <= 1.0)),
    }


def summary_rows(runs: DataFrame, *keep: str) -> DataFrame:
    """Label, value and grade rows; unmeasured figures give no row."""
    regs, px = F.col("registration_percent"), F.col("reprojection_px")
    cells = [
        ("Processing time", F.col("runtime_s"), text.duration(F.col("runtime_s")), F.lit("info")),
        ("Video frames used", regs,
         F.concat(F.col("registered_images").cast("string"), F.lit(" · "), F.format_string("%.1f%%", regs)),
         text.grade(regs, 90, 70)),
        ("Reprojection error", px, F.format_string("%.2f px", px), text.grade(px, 1, 2, False)),
        ("Ground coverage", F.col("dsm_fraction"), text.percent(F.col("dsm_fraction")), text.grade(F.col("dsm_fraction"), 0.75, 0.5)),
        ("Offset vs drone GPS", F.col("gps_rmse_m"), F.format_string("%.2f m", F.col("gps_rmse_m")),
         text.grade(F.col("gps_rmse_m"), 1, 3, False)),
        ("Points in cloud", F.col("points").cast("double"), F.format_number("points", 0), F.lit("info")),
    ]
    rows = F.array(*[
        F.when(text.finite(v), F.struct(F.lit(label).alias("label"), shown.alias("value"), chip.alias("chip")))
        for label, v, shown, chip in cells
    ])
    return runs.select(*keep, F.explode(F.array_compact(rows)).alias("_r")).select(*keep, "_r.*")


def interval_members(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Points inside closed intervals of the same key, by an equi-join on time buckets.

    Each interval is listed in the buckets it touches, so no theta join is planned and a hot
    key spreads over its buckets.
    """
    cells = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    listed = intervals.withColumn("_bucket", F.explode(cells))
    return points.withColumn("_bucket", F.floor(F.col(at) / bucket)).join(listed, [key, "_bucket"]).filter(
        (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    ).drop("_bucket")


def measured(column: str) -> Column:
    """Number in a monitor cell; ``N/A`` and blanks are missing."""
    return F.col(column).try_cast("double")
