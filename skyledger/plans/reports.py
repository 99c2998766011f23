"""Registered report, comparison and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..operators import reports as ops
from .registry import query
from .scalars import terminal_state
from .sqltext import rounded
from .telemetry import r
from .views import view, with_views

_REF = "ref AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY benchmark_id ORDER BY run_id) = 1)"
_LONG = ", ".join(f"('{m}', CAST(b.{m} AS DOUBLE), CAST(a.{m} AS DOUBLE))" for m in ops.METRICS)


def _paired(spark, sf_dir, columns):
    return ops.with_reference(view(spark, sf_dir, "reports"), "benchmark_id", "run_id", list(columns))


@query("run_metric_changes", "J17 G38", with_views("reports", f"""WITH {_REF}
    SELECT a.run_id, m.metric, round(m.b, 6) AS "before", round(m.a, 6) AS "after", round(m.a - m.b, 6) AS delta,
        round(CASE WHEN m.b <> 0 THEN 100 * (m.a - m.b) / m.b END, 6) AS change_percent
    FROM reports a JOIN ref b USING (benchmark_id), LATERAL (VALUES {_LONG}) m(metric, b, a)"""))
def run_metric_changes(spark, sf_dir):
    return r(ops.metric_changes(_paired(spark, sf_dir, ops.METRICS), "run_id"), "before after delta change_percent")


@query("run_guardrails", "G38", with_views("reports", f"""WITH {_REF},
    g AS (SELECT a.run_id, a.runtime_s < b.runtime_s AS runtime_improved,
        a.registration_percent - b.registration_percent >= -1 AS registration_drop_at_most_1_point,
        a.reprojection_px - b.reprojection_px <= 0.03e0 AS reprojection_increase_at_most_0_03_px,
        a.gps_rmse_m - b.gps_rmse_m <= 0.15e0 AS gps_rmse_increase_at_most_0_15_m,
        CASE WHEN b.points > 0 THEN a.points >= 0.75e0 * b.points END AS point_count_retains_75_percent,
        CASE WHEN b.dsm_fraction > 0 THEN a.dsm_fraction >= 0.95e0 * b.dsm_fraction END AS dsm_coverage_retains_95_percent,
        a.mesh_components - b.mesh_components <= 3 AS mesh_components_increase_at_most_3,
        round(CASE WHEN a.runtime_s > 0 THEN b.runtime_s / a.runtime_s END, 6) AS speedup
        FROM reports a JOIN ref b USING (benchmark_id))
    SELECT *, coalesce(runtime_improved, false) AND coalesce(registration_drop_at_most_1_point, false)
        AND coalesce(reprojection_increase_at_most_0_03_px, false) AND coalesce(gps_rmse_increase_at_most_0_15_m, false)
        AND coalesce(point_count_retains_75_percent, false) AND coalesce(dsm_coverage_retains_95_percent, false)
        AND coalesce(mesh_components_increase_at_most_3, false) AS passes FROM g"""))
def run_guardrails(spark, sf_dir):
    rails = ops.guardrails()
    speedup = F.when(F.col("runtime_s") > 0, F.col("ref_runtime_s") / F.col("runtime_s"))
    out = _paired(spark, sf_dir, ops.METRICS).select(
        "run_id", *[c.alias(n) for n, c in rails.items()], speedup.alias("speedup"),
        gates.all_known_true(list(rails.values())).alias("passes"),
    )
    return r(out, "speedup")


_EVIDENCE = """
    cf AS (SELECT *, concat_ws(',', CASE WHEN selected_frames <> selected_frames_b THEN 'selected_frame_count_conflict' END,
            CASE WHEN NOT (abs(duration_s - duration_b_s) <= greatest(1e-4 * greatest(duration_s, duration_b_s), 0.5e0)) THEN 'video_duration_conflict' END,
            CASE WHEN target_frames <> target_frames_b THEN 'target_frame_count_conflict' END) AS conflict_codes FROM reports),
    rk AS (SELECT *, CASE WHEN dense_checks > 0 THEN 0 WHEN checkpoint_checks >= 3 THEN 1 WHEN distance_checks > 0 THEN 2 END AS ok,
        CASE WHEN dense_checks IS NOT NULL THEN 0 WHEN checkpoint_checks IS NOT NULL THEN 1 WHEN distance_checks IS NOT NULL THEN 2 END AS have FROM cf),
    ev AS (SELECT *, CASE coalesce(ok, have) WHEN 0 THEN 'dense_reference_geometry' WHEN 1 THEN 'surveyed_checkpoints'
            WHEN 2 THEN 'independent_distances' END AS evidence_type,
        CASE coalesce(ok, have) WHEN 0 THEN dense_checks WHEN 1 THEN checkpoint_checks WHEN 2 THEN distance_checks END AS evidence_checks,
        ok IS NOT NULL AS evidence_valid,
        CASE coalesce(ok, have) WHEN 1 THEN checkpoint_rmse_m WHEN 2 THEN distance_rmse_m END AS evidence_rmse_m,
        CASE coalesce(ok, have) WHEN 1 THEN checkpoint_max_m WHEN 2 THEN distance_max_m END AS evidence_max_m FROM rk),
    ref AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY benchmark_id ORDER BY run_id) = 1)
"""
_SAME_SET = ("coalesce(a.evidence_valid AND b.evidence_valid AND a.evidence_type = b.evidence_type "
             "AND a.evidence_checks = b.evidence_checks, false)")
_FAIR = [
    ("baseline_has_independent_surface_evidence", "b.evidence_valid"),
    ("baseline_metadata_consistent", "b.conflict_codes = ''"),
    ("candidate_has_independent_surface_evidence", "a.evidence_valid"),
    ("candidate_metadata_consistent", "a.conflict_codes = ''"),
    ("same_frame_resolution", "a.resolution = b.resolution"),
    ("same_independent_surface_evidence_set", _SAME_SET),
    ("same_selected_frame_count", "a.selected_frames = b.selected_frames"),
    ("same_selected_frame_manifest", "a.manifest_digest = b.manifest_digest"),
    ("same_target_frame_count", "a.target_frames = b.target_frames"),
    ("same_video_duration", "abs(a.duration_s - b.duration_s) <= greatest(1e-4 * greatest(a.duration_s, b.duration_s), 0.5e0)"),
    ("same_video_identity", "a.video_id = b.video_id"),
]
_FAIR_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _FAIR) + ")"


def _limit_sql(m):
    return f"coalesce(a.{m} <= b.{m} + greatest(0.02e0, abs(b.{m}) * 0.05e0) + 1e-12, false)"


_SURFACE_SQL = f"""CASE WHEN NOT {_SAME_SET} THEN 'same_surface_evidence_for_quality'
    WHEN a.evidence_type = 'dense_reference_geometry' THEN
        CASE WHEN a.dense_f1 + 0.02e0 >= b.dense_f1 THEN '' ELSE 'dense_f1_at_all_thresholds_not_materially_worse' END
    ELSE concat_ws(',', CASE WHEN NOT coalesce(a.evidence_max_m <= 1, false) THEN 'candidate_passes_one_metre_surface_target' END,
        CASE WHEN NOT {_limit_sql('evidence_max_m')} THEN 'surface_maximum_error_not_materially_worse' END,
        CASE WHEN NOT {_limit_sql('evidence_rmse_m')} THEN 'surface_rmse_not_materially_worse' END) END"""

_COMPARED = [
    "video_id", "duration_s", "target_frames", "selected_frames", "manifest_digest", "resolution", "dense_f1",
    "evidence_type", "evidence_checks", "evidence_valid", "evidence_rmse_m", "evidence_max_m", "conflict_codes",
]


def _evidenced(spark, sf_dir):
    return ops.surface_evidence(view(spark, sf_dir, "reports").withColumn("conflict_codes", ops.conflicts()))


def _compared(spark, sf_dir):
    paired = ops.with_reference(_evidenced(spark, sf_dir), "benchmark_id", "run_id", _COMPARED)
    fair = ops.fairness()
    return paired.withColumn("fair_failures", gates.failing(fair)).withColumn(
        "surface_failures", ops.surface_quality(fair["same_independent_surface_evidence_set"])
    )


@query("report_conflicts", "G35", with_views("reports", f"WITH {_EVIDENCE} SELECT run_id, conflict_codes, conflict_codes = '' AS consistent FROM ev"))
def report_conflicts(spark, sf_dir):
    return view(spark, sf_dir, "reports").select(
        "run_id", ops.conflicts().alias("conflict_codes"), (ops.conflicts() == "").alias("consistent")
    )


@query("surface_evidence", "G36", with_views("reports", f"""WITH {_EVIDENCE}
    SELECT run_id, evidence_type, CAST(evidence_checks AS BIGINT) AS evidence_checks, evidence_valid,
        {rounded('evidence_rmse_m evidence_max_m')} FROM ev"""))
def surface_evidence(spark, sf_dir):
    out = _evidenced(spark, sf_dir).select(
        "run_id", "evidence_type", F.col("evidence_checks").cast("bigint").alias("evidence_checks"), "evidence_valid",
        "evidence_rmse_m", "evidence_max_m",
    )
    return r(out, "evidence_rmse_m evidence_max_m")


@query("fair_comparison", "G37", with_views("reports", f"""WITH {_EVIDENCE}
    SELECT a.run_id, {_FAIR_SQL} AS fair_failures, {_SURFACE_SQL} AS surface_failures
    FROM ev a JOIN ref b USING (benchmark_id)"""))
def fair_comparison(spark, sf_dir):
    return _compared(spark, sf_dir).select("run_id", "fair_failures", "surface_failures")


_RANKED = f"""{_EVIDENCE},
    fc AS (SELECT a.run_id, a.benchmark_id, a.runtime_s, concat_ws(',', CASE WHEN NOT a.verified_ready THEN 'not_production_ready' END,
        CASE WHEN a.runtime_s IS NULL THEN 'missing_valid_runtime' END, nullif({_FAIR_SQL}, ''), nullif({_SURFACE_SQL}, '')) AS exclusion_reasons
        FROM ev a JOIN ref b USING (benchmark_id))"""


def _ranked(spark, sf_dir):
    why = F.array_join(F.array_compact(F.array(
        F.when(~F.col("verified_ready"), "not_production_ready"),
        F.when(F.col("runtime_s").isNull(), "missing_valid_runtime"),
        F.nullif("fair_failures", F.lit("")), F.nullif("surface_failures", F.lit("")),
    )), ",")
    return _compared(spark, sf_dir).select("run_id", "benchmark_id", "runtime_s", why.alias("exclusion_reasons"))


@query("benchmark_exclusions", "G39", with_views("reports", f"""WITH {_RANKED}
    SELECT run_id, benchmark_id, exclusion_reasons, exclusion_reasons = '' AS eligible FROM fc"""))
def benchmark_exclusions(spark, sf_dir):
    return _ranked(spark, sf_dir).select(
        "run_id", "benchmark_id", "exclusion_reasons", (F.col("exclusion_reasons") == "").alias("eligible")
    )


@query("benchmark_winners", "G39 W17", with_views("reports", f"""WITH {_RANKED}
    SELECT benchmark_id, min(run_id) AS reference_run, count(*) AS runs, count(*) FILTER (exclusion_reasons = '') AS eligible_runs,
        arg_min(run_id, (runtime_s, run_id)) FILTER (exclusion_reasons = '') AS winner FROM fc GROUP BY benchmark_id"""))
def benchmark_winners(spark, sf_dir):
    eligible = F.col("exclusion_reasons") == ""
    return _ranked(spark, sf_dir).groupBy("benchmark_id").agg(
        F.min("run_id").alias("reference_run"), F.count(F.lit(1)).alias("runs"), F.count_if(eligible).alias("eligible_runs"),
        F.min_by("run_id", F.when(eligible, F.struct("runtime_s", "run_id"))).alias("winner"),
    )


@query("requirement_scorecard", "G40", with_views("reports", """
    WITH s AS (SELECT *, greatest(3.5e0, 1.5e0 * duration_s / 60) AS deadline,
        CASE WHEN checkpoint_checks >= 3 THEN checkpoint_rmse_m <= 1 END AS accuracy FROM reports)
    SELECT run_id, runtime_s < deadline * 60 AS runtime_pass, accuracy AS accuracy_pass, CAST(NULL AS BOOLEAN) AS coverage_pass,
        textured AS formats_pass, round(deadline, 6) AS deadline_minutes, false AS production_ready,
        concat_ws(',', CASE WHEN NOT textured THEN 'all_formats' END, 'entire_visible_scene',
            CASE WHEN NOT coalesce(runtime_s < deadline * 60, false) THEN 'runtime' END,
            CASE WHEN NOT coalesce(accuracy, false) THEN 'spatial_accuracy' END) AS unmet FROM s"""))
def requirement_scorecard(spark, sf_dir):
    deadline = F.greatest(F.lit(3.5), 1.5 * F.col("duration_s") / 60)
    checks = {
        "runtime": F.col("runtime_s") < deadline * 60,
        "spatial_accuracy": F.when(F.col("checkpoint_checks") >= 3, F.col("checkpoint_rmse_m") <= 1.0),
        # No proxy proves that the whole visible scene is covered, so this stays unknown.
        "entire_visible_scene": F.lit(None).cast("boolean"),
        "all_formats": F.col("textured"),
    }
    out = view(spark, sf_dir, "reports").select(
        "run_id", checks["runtime"].alias("runtime_pass"), checks["spatial_accuracy"].alias("accuracy_pass"),
        checks["entire_visible_scene"].alias("coverage_pass"), checks["all_formats"].alias("formats_pass"),
        deadline.alias("deadline_minutes"), gates.all_known_true(list(checks.values())).alias("production_ready"),
        gates.failing(checks).alias("unmet"),
    )
    return r(out, "deadline_minutes")


@query("output_verification", "G41 P30", with_views("reports", f"""WITH {_EVIDENCE},
    v AS (SELECT *, points >= greatest(1000, registered_images * 20) AS point_cloud_is_substantive,
        mesh_vertices >= greatest(500, registered_images * 10) AS mesh_vertices_are_substantive,
        mesh_faces >= greatest(500, registered_images * 15) AS mesh_faces_are_substantive,
        dsm_cells >= greatest(500, registered_images * 10) AS dsm_has_substantive_valid_area,
        coalesce(runtime_s < 900, false) AS fast,
        concat_ws(',', CASE WHEN NOT capture_ready THEN 'capture_quality_passed' END,
            CASE WHEN NOT dsm_fraction >= 0.75e0 THEN 'dsm_coverage_at_least_75_percent' END,
            CASE WHEN NOT coalesce(evidence_valid AND evidence_max_m <= 1, false) THEN 'independent_surface_accuracy_at_most_1m' END,
            CASE WHEN NOT oversized_fraction <= 0.001e0 THEN 'mesh_has_at_most_0_1_percent_oversized_faces' END,
            CASE WHEN NOT mesh_components BETWEEN 1 AND 20 THEN 'mesh_has_at_most_20_components' END,
            CASE WHEN NOT textured THEN 'mesh_is_textured' END,
            CASE WHEN NOT coalesce(runtime_s < 900, false) THEN 'processing_under_15_minutes' END,
            CASE WHEN NOT registration_percent >= 90 THEN 'registration_at_least_90_percent' END,
            CASE WHEN NOT reprojection_px <= 2 THEN 'reprojection_error_at_most_2px' END) AS failing_gates FROM ev),
    w AS (SELECT *, point_cloud_is_substantive AND mesh_vertices_are_substantive AND mesh_faces_are_substantive
        AND dsm_has_substantive_valid_area AS substantive FROM v),
    x AS (SELECT *, substantive AND failing_gates = '' AS production_ready FROM w)
    SELECT run_id, point_cloud_is_substantive, mesh_vertices_are_substantive, mesh_faces_are_substantive,
        dsm_has_substantive_valid_area, failing_gates, production_ready,
        CASE WHEN NOT telemetry_passed THEN 'TELEMETRY_INVALID' WHEN NOT capture_ready THEN 'INSUFFICIENT_CAPTURE'
             WHEN NOT substantive THEN 'FAILED' WHEN NOT fast OR NOT production_ready THEN 'PARTIAL_VALID' ELSE 'COMPLETE' END AS state FROM x"""))
def output_verification(spark, sf_dir):
    solid, production = ops.substantive(), ops.production_gates()
    whole = gates.all_known_true(list(solid.values()))
    ready = whole & gates.all_known_true(list(production.values()))
    state, _ = terminal_state(
        F.col("telemetry_passed"), F.col("capture_ready"), F.lit(True), whole, ready,
        production["processing_under_15_minutes"], F.lit(False),
    )
    return _evidenced(spark, sf_dir).select(
        "run_id", *[c.alias(n) for n, c in solid.items()], gates.failing(production).alias("failing_gates"),
        ready.alias("production_ready"), state.alias("state"),
    )


@query("quality_summary", "G42 P21", with_views("reports", """
    WITH l AS (SELECT r.run_id, m.* FROM reports r, LATERAL (VALUES
        ('Processing time', runtime_s, printf('%d:%02d min', CAST(floor(floor(runtime_s + 0.5e0) / 60) AS BIGINT), CAST(floor(runtime_s + 0.5e0) AS BIGINT) % 60), 'info'),
        ('Video frames used', registration_percent, CAST(registered_images AS STRING) || ' · ' || printf('%.1f%%', registration_percent),
            CASE WHEN registration_percent >= 90 THEN 'good' WHEN registration_percent >= 70 THEN 'warn' ELSE 'bad' END),
        ('Reprojection error', reprojection_px, printf('%.2f px', reprojection_px),
            CASE WHEN reprojection_px <= 1 THEN 'good' WHEN reprojection_px <= 2 THEN 'warn' ELSE 'bad' END),
        ('Ground coverage', dsm_fraction, printf('%.1f%%', dsm_fraction * 100),
            CASE WHEN dsm_fraction >= 0.75e0 THEN 'good' WHEN dsm_fraction >= 0.5e0 THEN 'warn' ELSE 'bad' END),
        ('Offset vs drone GPS', gps_rmse_m, printf('%.2f m', gps_rmse_m),
            CASE WHEN gps_rmse_m <= 1 THEN 'good' WHEN gps_rmse_m <= 3 THEN 'warn' ELSE 'bad' END),
        ('Points in cloud', CAST(points AS DOUBLE), format('{:,}', CAST(points AS BIGINT)), 'info')) m("label", v, "value", chip))
    SELECT run_id, "label", "value", chip FROM l WHERE v IS NOT NULL"""))
def quality_summary(spark, sf_dir):
    return ops.summary_rows(view(spark, sf_dir, "reports"), "run_id")


@query("runtime_scaling_fit", "G29", with_views("reports", """
    SELECT dataset, count(runtime_s) AS runs, round(CASE WHEN count(DISTINCT points) FILTER (runtime_s IS NOT NULL) >= 2
            THEN regr_slope(runtime_s / 60, points) END, 8) AS minutes_per_frame,
        round(regr_intercept(runtime_s / 60, points), 6) AS base_minutes,
        round(regr_slope(runtime_s / 60, duration_s), 6) AS minutes_per_second FROM reports GROUP BY dataset"""))
def runtime_scaling_fit(spark, sf_dir):
    y, x = F.col("runtime_s") / 60, F.col("points").cast("double")
    # distinct x is tested by its range, which needs no distinct shuffle
    spread = F.max(F.when(y.isNotNull(), x)) > F.min(F.when(y.isNotNull(), x))
    out = view(spark, sf_dir, "reports").groupBy("dataset").agg(
        F.count("runtime_s").alias("runs"), F.when(spread, F.regr_slope(y, x)).alias("minutes_per_frame"),
        F.regr_intercept(y, x).alias("base_minutes"), F.regr_slope(y, F.col("duration_s")).alias("minutes_per_second"),
    )
    return r(r(out, "minutes_per_frame", 8), "base_minutes minutes_per_second")


# Ledger categories of the staged run table.
CATEGORIES = ("click", "error", "purchase", "signup", "view")


@query("stage_ledger", "G30", with_views("stages", """
    SELECT host_id, {0}, round(({1}) / 60, 6) AS accounted_minutes,
        round((coalesce(sum(seconds) FILTER (category = 'click'), 0) + coalesce(sum(seconds) FILTER (category = 'purchase'), 0)
            + coalesce(sum(seconds) FILTER (category = 'view'), 0)) / 60, 6) AS release_minutes
    FROM stages GROUP BY host_id""".format(
        ", ".join(f"round(coalesce(sum(seconds) FILTER (category = '{c}'), 0), 6) AS {c}_s" for c in CATEGORIES),
        " + ".join(f"coalesce(sum(seconds) FILTER (category = '{c}'), 0)" for c in CATEGORIES))))
def stage_ledger(spark, sf_dir):
    wide = view(spark, sf_dir, "stages").groupBy("host_id").pivot("category", list(CATEGORIES)).sum("seconds").fillna(0.0)
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    release = F.col("click") + F.col("purchase") + F.col("view")
    out = wide.select(
        "host_id", *[F.col(c).alias(f"{c}_s") for c in CATEGORIES], (total / 60).alias("accounted_minutes"),
        (release / 60).alias("release_minutes"),
    )
    return r(out, " ".join(f"{c}_s" for c in CATEGORIES) + " accounted_minutes release_minutes")


@query("time_breakdown", "G30", with_views("stages", """
    WITH t AS (SELECT host_id, category AS step, sum(seconds) AS seconds FROM stages GROUP BY host_id, category),
    w AS (SELECT host_id, max(end_s) - min(start_s) AS total FROM stages GROUP BY host_id),
    a AS (SELECT * FROM t UNION ALL SELECT w.host_id, 'unaccounted', greatest(0, total - s) FROM w JOIN
          (SELECT host_id, sum(seconds) AS s FROM t GROUP BY host_id) USING (host_id))
    SELECT host_id, step, round(a.seconds, 6) AS seconds, round(100 * a.seconds / total, 6) AS share_percent,
        row_number() OVER (PARTITION BY host_id ORDER BY a.seconds DESC, step) AS place FROM a JOIN w USING (host_id)"""))
def time_breakdown(spark, sf_dir):
    from pyspark.sql import Window as W

    stages = view(spark, sf_dir, "stages")
    steps = stages.groupBy("host_id", F.col("category").alias("step")).agg(F.sum("seconds").alias("seconds"))
    wall = stages.groupBy("host_id").agg((F.max("end_s") - F.min("start_s")).alias("total"), F.sum("seconds").alias("_s"))
    rest = wall.select("host_id", F.lit("unaccounted").alias("step"), F.greatest(F.lit(0.0), F.col("total") - F.col("_s")).alias("seconds"))
    # a host has a handful of step names, so the ranking window is small
    place = F.row_number().over(W.partitionBy("host_id").orderBy(F.col("seconds").desc(), "step"))
    out = steps.unionByName(rest).join(wall, "host_id").select(
        "host_id", "step", "seconds", (100 * F.col("seconds") / F.col("total")).alias("share_percent"), place.alias("place")
    )
    return r(out, "seconds share_percent")


_FIELDS = ("utilization_gpu_percent", "memory_used_mb", "memory_total_mb", "temperature_c", "power_draw_w")


@query("monitor_summary", "G31", with_views("monitor", """
    SELECT host_id, field, round(avg(TRY_CAST(v AS DOUBLE)), 6) AS mean, max(TRY_CAST(v AS DOUBLE)) AS maximum,
        count(TRY_CAST(v AS DOUBLE)) AS readings, count(*) AS samples
    FROM monitor m, LATERAL (VALUES {}) x(field, v) GROUP BY host_id, field""".format(", ".join(f"('{f}', m.{f})" for f in _FIELDS))))
def monitor_summary(spark, sf_dir):
    long = view(spark, sf_dir, "monitor").unpivot(["host_id"], list(_FIELDS), "field", "v")
    number = ops.measured("v")
    out = long.groupBy("host_id", "field").agg(
        F.avg(number).alias("mean"), F.max(number).alias("maximum"), F.count(number).alias("readings"),
        F.count(F.lit(1)).alias("samples"),
    )
    return r(out, "mean")


@query("monitor_by_stage", "J4", with_views("monitor stages", """
    SELECT s.stage_id, count(m.sample_id) AS samples, round(avg(TRY_CAST(utilization_gpu_percent AS DOUBLE)), 6) AS utilization_mean,
        max(TRY_CAST(utilization_gpu_percent AS DOUBLE)) AS utilization_max, max(TRY_CAST(memory_used_mb AS DOUBLE)) AS memory_max_mb
    FROM stages s LEFT JOIN monitor m ON m.host_id = s.host_id AND m.at_s BETWEEN s.start_s AND s.end_s GROUP BY s.stage_id"""))
def monitor_by_stage(spark, sf_dir):
    stages = view(spark, sf_dir, "stages")
    inside = ops.interval_members(view(spark, sf_dir, "monitor"), stages, "host_id", "at_s", "start_s", "end_s", 60.0)
    figures = inside.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(ops.measured("utilization_gpu_percent")).alias("utilization_mean"),
        F.max(ops.measured("utilization_gpu_percent")).alias("utilization_max"),
        F.max(ops.measured("memory_used_mb")).alias("memory_max_mb"),
    )
    return r(stages.select("stage_id").join(figures, "stage_id", "left").fillna(0, ["samples"]), "utilization_mean")


_NAMED = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


@query("dataset_metric_means", "G33", with_views("runs", """
    WITH l AS (SELECT dataset, mode, m.* FROM runs r, LATERAL (VALUES ('runtime_s', runtime_s), ('registration_percent', registration_percent),
        ('checkpoint_rmse_m', checkpoint_rmse_m)) m(metric, v)),
    a AS (SELECT dataset, mode, metric, avg(v) AS mean, count(v) AS scenes FROM l GROUP BY dataset, mode, metric)
    SELECT dataset, mode, metric, round(mean, 6) AS mean, scenes FROM a
    UNION ALL SELECT 'AVERAGE', mode, metric, round(avg(mean), 6), CAST(sum(scenes) AS BIGINT) FROM a
    WHERE metric <> 'checkpoint_rmse_m' OR dataset IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') GROUP BY mode, metric"""))
def dataset_metric_means(spark, sf_dir):
    long = view(spark, sf_dir, "runs").unpivot(
        ["dataset", "mode"], ["runtime_s", "registration_percent", "checkpoint_rmse_m"], "metric", "v"
    )
    means = long.groupBy("dataset", "mode", "metric").agg(F.avg("v").alias("mean"), F.count("v").alias("scenes"))
    # accuracy averages leave one dataset out, as the summary table does
    counted = (F.col("metric") != "checkpoint_rmse_m") | F.col("dataset").isin(*_NAMED)
    overall = means.filter(counted).groupBy("mode", "metric").agg(F.avg("mean").alias("mean"), F.sum("scenes").alias("scenes"))
    return r(means.unionByName(overall.withColumn("dataset", F.lit("AVERAGE"))), "mean")


@query("run_metric_alignment", "J18 U4", with_views("runs", """
    WITH l AS (SELECT dataset, mode AS label, m.* FROM runs r, LATERAL (VALUES ('runtime_s', runtime_s), ('registration_percent', registration_percent),
        ('checkpoint_rmse_m', checkpoint_rmse_m)) m(metric, v)),
    a AS (SELECT dataset, label, metric, avg(v) AS v FROM l WHERE NOT (label = 'P' AND metric = 'runtime_s') AND NOT (label = 'F' AND dataset = '2-HIGH')
          GROUP BY dataset, label, metric),
    p AS (SELECT dataset, metric, max(v) FILTER (label = 'F') AS run_f, max(v) FILTER (label = 'O') AS run_o,
        max(v) FILTER (label = 'P') AS run_p, max(v) AS hi, min(v) AS lo FROM a GROUP BY dataset, metric)
    SELECT dataset, metric, round(run_f, 6) AS run_f, round(run_o, 6) AS run_o, round(run_p, 6) AS run_p,
        round(CASE metric WHEN 'registration_percent' THEN hi ELSE lo END, 6) AS best,
        round(CASE metric WHEN 'registration_percent' THEN lo ELSE hi END, 6) AS worst FROM p"""))
def run_metric_alignment(spark, sf_dir):
    long = view(spark, sf_dir, "runs").unpivot(
        ["dataset", "mode"], ["runtime_s", "registration_percent", "checkpoint_rmse_m"], "metric", "v"
    )
    skip = ((F.col("mode") == "P") & (F.col("metric") == "runtime_s")) | ((F.col("mode") == "F") & (F.col("dataset") == "2-HIGH"))
    # pivot over the run labels: every key and metric of any run, missing as null
    wide = long.filter(~skip).groupBy("dataset", "metric").pivot("mode", ["F", "O", "P"]).agg(F.avg("v"))
    high = F.greatest("F", "O", "P")
    low = F.least("F", "O", "P")
    up = F.col("metric") == "registration_percent"
    out = wide.select(
        "dataset", "metric", F.col("F").alias("run_f"), F.col("O").alias("run_o"), F.col("P").alias("run_p"),
        F.when(up, high).otherwise(low).alias("best"), F.when(up, low).otherwise(high).alias("worst"),
    )
    return r(out, "run_f run_o run_p best worst")


@query("demo_enrichment", "J20", with_views("runs reports", """
    SELECT p.run_id, round(coalesce(m.runtime_s, p.runtime_s), 6) AS processing_time, round(coalesce(m.gps_rmse_m, 0.5e0), 6) AS confidence,
        CAST(floor(p.registration_percent) AS BIGINT) AS preview_frames, m.points AS benchmark_frames
    FROM runs p LEFT JOIN (SELECT * FROM reports WHERE run_id % 3 <> 1) m USING (run_id)"""))
def demo_enrichment(spark, sf_dir):
    measured = view(spark, sf_dir, "reports").filter("run_id % 3 <> 1").select(
        "run_id", F.col("runtime_s").alias("_runtime"), "gps_rmse_m", "points"
    )
    out = view(spark, sf_dir, "runs").join(measured, "run_id", "left").select(
        "run_id", F.coalesce("_runtime", "runtime_s").alias("processing_time"),
        F.coalesce("gps_rmse_m", F.lit(0.5)).alias("confidence"),
        F.floor("registration_percent").alias("preview_frames"), F.col("points").alias("benchmark_frames"),
    )
    return r(out, "processing_time confidence")
