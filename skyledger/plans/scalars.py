"""Registered scalar, text and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text
from .registry import query
from .telemetry import r
from .views import source, view, with_views


@query("height_labels", "P20", """
    WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0e0 ELSE o_custkey / 10.0e0 - 20 END AS alt,
        (o_orderkey % 40) - 30.0e0 AS ground, (o_orderkey % 90) * 1.0e0 AS up,
        CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS abs_known FROM orders),
    a AS (SELECT *, alt IS NULL OR alt = 0 OR alt + ground < 0 AS above FROM p)
    SELECT k, above AS above_ground, round(CASE WHEN above THEN up - ground ELSE alt + up END, 6) AS height_m,
        CASE WHEN above THEN 'Height above ground' WHEN abs_known THEN 'Elevation'
             WHEN NOT abs_known THEN 'Height (telemetry datum)' ELSE 'Height' END AS label FROM a""")
def height_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    p = source(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.when(k % 5 == 1, 0.0).when(k % 5 > 1, F.col("o_custkey") / 10.0 - 20).alias("alt"),
        (k % 40 - 30.0).alias("ground"), (k % 90).cast("double").alias("up"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("abs_known"),
    )
    above = F.col("alt").isNull() | (F.col("alt") == 0) | (F.col("alt") + F.col("ground") < 0)
    p = p.withColumn("above_ground", above)
    label = (
        F.when(F.col("above_ground"), "Height above ground").when(F.col("abs_known"), "Elevation")
        .when(~F.col("abs_known"), "Height (telemetry datum)").otherwise("Height")
    )
    h = F.when(F.col("above_ground"), F.col("up") - F.col("ground")).otherwise(F.col("alt") + F.col("up"))
    return r(p.select("k", "above_ground", h.alias("height_m"), label.alias("label")), "height_m")


_SIZES = "(o_totalprice - 900) * (o_orderkey % 7) / 16.0e0"


@query("measure_formats", "P21", f"""
    WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {_SIZES} + 0.001e0 END AS m FROM orders),
    q AS (SELECT *, m / 1000000.0e0 AS x, CAST(floor(m / 100 + 0.5e0) AS BIGINT) AS sec FROM p)
    SELECT k, CASE WHEN m IS NULL THEN '—' WHEN m >= 10000 THEN printf('%.1f km', m / 1000) WHEN m >= 1000
            THEN printf('%.2f km', m / 1000) WHEN m >= 100 THEN printf('%.1f m', m) ELSE printf('%.2f m', m) END AS length_text,
        CASE WHEN m IS NULL THEN '—' WHEN m >= 1e6 THEN printf('%.3f km²', m / 1e6) WHEN m >= 1e5 THEN printf('%.2f ha', m / 1e4)
            WHEN m >= 100 THEN format('{{:,}} m²', CAST(floor(m + 0.5e0) AS BIGINT)) ELSE printf('%.1f m²', m) END AS area_text,
        CASE WHEN m IS NULL THEN '—' WHEN m * 10 >= 1e6 THEN printf('%.2f million m³', m * 10 / 1e6)
            ELSE format('{{:,}} m³', CAST(floor(m * 10 + 0.5e0) AS BIGINT)) END AS volume_text,
        CASE WHEN m IS NULL THEN '—' ELSE printf('%.1f%%', x * 100) END AS percent_text,
        CASE WHEN m IS NULL THEN '—' ELSE printf('%.1f%% (%.1f°)', x * 100, atan(x) / (pi() / 180)) END AS slope_text,
        CASE WHEN m IS NULL THEN '—' ELSE printf('%d:%02d min', CAST(floor(sec / 60) AS BIGINT), sec % 60) END AS duration_text,
        CASE WHEN m IS NULL THEN 'info' WHEN x >= 0.1e0 THEN 'good' WHEN x >= 0.05e0 THEN 'warn' ELSE 'bad' END AS chip,
        CASE WHEN m IS NULL THEN 'info' WHEN x <= 0.05e0 THEN 'good' WHEN x <= 0.1e0 THEN 'warn' ELSE 'bad' END AS low_chip
    FROM q""")
def measure_formats(spark, sf_dir):
    k = F.col("o_orderkey")
    m = F.when(k % 50 != 0, (F.col("o_totalprice") - 900) * (k % 7) / 16.0 + 0.001)
    p = source(spark, sf_dir, "orders").select(k.alias("k"), m.alias("m"))
    m, x = F.col("m"), F.col("m") / 1000000.0
    return p.select(
        "k", text.length(m).alias("length_text"), text.area(m).alias("area_text"),
        text.volume(m * 10).alias("volume_text"), text.percent(x).alias("percent_text"),
        text.slope(x).alias("slope_text"), text.duration(m / 100.0).alias("duration_text"),
        text.grade(x, 0.1, 0.05).alias("chip"), text.grade(x, 0.05, 0.1, False).alias("low_chip"),
    )


@query("identity_values", "P23", """
    WITH p AS (SELECT o_orderkey AS k, CASE o_orderkey % 2 WHEN 0 THEN 'set\\clip/frame_' ELSE ' clip/sub/frame_' END
        || CAST(o_orderkey AS STRING) || '.jpg' AS path,
        CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS STRING) || '.0' WHEN 1 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END AS frame,
        CASE o_orderkey % 4 WHEN 0 THEN ' SHA256:' || upper(md5(o_orderpriority)) WHEN 1 THEN '  ' ELSE md5(o_orderpriority) END AS dig,
        CASE o_orderkey % 3 WHEN 0 THEN '1920x1080' WHEN 1 THEN ' 1280 X ' || CAST(o_custkey AS STRING) || ' ' ELSE 'wide' END AS res,
        CASE o_orderkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25' WHEN 2 THEN '0/0' ELSE 'vfr' END AS rate FROM orders)
    SELECT k, 'frame_' || CAST(k AS STRING) || '.jpg' AS file_name,
        CASE k % 3 WHEN 2 THEN 'n/a' ELSE regexp_replace(frame, '\\.0$', '') END AS frame_text,
        CASE k % 4 WHEN 1 THEN NULL ELSE regexp_extract(lower(dig), '[0-9a-f]{32}$') END AS digest,
        CASE k % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1280 END AS width,
        CASE k % 3 WHEN 0 THEN 1080 WHEN 1 THEN CAST(regexp_extract(res, 'X (\\d+)', 1) AS INT) END AS height,
        round(CASE k % 4 WHEN 0 THEN 30000.0e0 / 1001 WHEN 1 THEN 25.0e0 END, 6) AS fps FROM p""")
def identity_values(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    p = source(spark, sf_dir, "orders").select(
        k.alias("k"),
        F.concat(F.when(k % 2 == 0, "set\\clip/frame_").otherwise(" clip/sub/frame_"), k.cast("string"), F.lit(".jpg")).alias("path"),
        F.when(k % 3 == 0, F.concat(c, F.lit(".0"))).when(k % 3 == 1, c).otherwise("n/a").alias("frame"),
        F.when(k % 4 == 0, F.concat(F.lit(" SHA256:"), F.upper(F.md5("o_orderpriority")))).when(k % 4 == 1, "  ")
        .otherwise(F.md5("o_orderpriority")).alias("dig"),
        F.when(k % 3 == 0, "1920x1080").when(k % 3 == 1, F.concat(F.lit(" 1280 X "), c, F.lit(" "))).otherwise("wide").alias("res"),
        F.when(k % 4 == 0, "30000/1001").when(k % 4 == 1, "25").when(k % 4 == 2, "0/0").otherwise("vfr").alias("rate"),
    )
    width, height = text.resolution(F.col("res"))
    out = p.select(
        "k", text.file_name(F.col("path")).alias("file_name"), text.integer_text(F.col("frame")).alias("frame_text"),
        text.digest(F.col("dig")).alias("digest"), width.alias("width"), height.alias("height"),
        text.frame_rate(F.col("rate")).alias("fps"),
    )
    return r(out, "fps")


@query("option_triplets", "P25", """
    WITH p AS (SELECT o_orderkey AS k, CAST(o_custkey AS STRING) AS c, CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' none'
        WHEN 2 THEN '-12' WHEN 3 THEN '1.5e-3' WHEN 4 THEN 'http://a:80' ELSE 'fast' END AS v FROM orders)
    SELECT k, 'resize' AS fn, 'width' AS "key", c AS "value", 'int' AS value_type FROM p
    UNION ALL SELECT k, 'export', 'mode', v, CASE k % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'none' WHEN 2 THEN 'int'
        WHEN 3 THEN 'float' ELSE 'string' END FROM p""")
def option_triplets(spark, sf_dir):
    k = F.col("o_orderkey")
    v = (
        F.when(k % 6 == 0, "True").when(k % 6 == 1, " none").when(k % 6 == 2, "-12").when(k % 6 == 3, "1.5e-3")
        .when(k % 6 == 4, "http://a:80").otherwise("fast")
    )
    line = F.concat(F.lit("resize:width:"), F.col("o_custkey").cast("string"), F.lit(",,export:mode:"), v)
    return text.triplets(source(spark, sf_dir, "orders").select(k.alias("k"), line.alias("line")), "line", "k")


@query("closed_comparisons", "P26", with_views("checkpoints", """
    WITH p AS (SELECT checkpoint_id AS k, reconstructed_x_m AS b, CASE WHEN checkpoint_id % 4 = 0 THEN NULL
        ELSE reconstructed_y_m END AS a FROM checkpoints)
    SELECT k, coalesce(a >= 50, false) AS at_least, coalesce(a <= 50, false) AS at_most,
        coalesce(a <= b + greatest(0.02e0, abs(b) * 0.05e0) + 1e-12, false) AS not_higher,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a - b >= -1 END AS drop_ok,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL AND b > 0 THEN a >= 0.75e0 * b END AS retained,
        coalesce(a > 0 AND b > 0 AND abs(a - b) <= greatest(1e-4 * greatest(abs(a), abs(b)), 0.5e0), false) AS same_length
    FROM p"""))
def closed_comparisons(spark, sf_dir):
    p = view(spark, sf_dir, "checkpoints").select(
        F.col("checkpoint_id").alias("k"), F.col("reconstructed_x_m").alias("b"),
        F.when(F.col("checkpoint_id") % 4 != 0, F.col("reconstructed_y_m")).alias("a"),
    )
    a, b = F.col("a"), F.col("b")
    return p.select(
        "k", gates.at_least(a, 50).alias("at_least"), gates.at_most(a, 50).alias("at_most"),
        gates.not_materially_higher(b, a).alias("not_higher"), gates.within_delta(b, a, lower=-1.0).alias("drop_ok"),
        gates.retains_ratio(b, a, 0.75).alias("retained"), gates.same_duration(a, b).alias("same_length"),
    )


@query("degrees_minutes_seconds", "P27", with_views("telemetry", """
    WITH p AS (SELECT sample_id, latitude + sample_id / 1000.0e0 AS v FROM telemetry),
    d AS (SELECT *, floor(abs(v)) AS d, (abs(v) - floor(abs(v))) * 60.0e0 AS rest FROM p)
    SELECT sample_id, CAST(d AS BIGINT) AS deg, CAST(floor(rest) AS BIGINT) AS minutes,
        CAST(round_even((rest - floor(rest)) * 60.0e0 * 1000000.0e0, 0) AS BIGINT) AS micro_seconds,
        round(-(d + floor(rest) / 60.0e0 + (rest - floor(rest)) * 60.0e0 / 3600.0e0), 9) AS south FROM d"""))
def degrees_minutes_seconds(spark, sf_dir):
    from ..functions.geo import decimal_to_dms, dms_to_decimal

    p = view(spark, sf_dir, "telemetry").select("sample_id", (F.col("latitude") + F.col("sample_id") / 1000.0).alias("v"))
    deg, minutes, micro = decimal_to_dms(F.col("v"))
    rest = (F.abs("v") - F.floor(F.abs("v"))) * 60.0
    south = dms_to_decimal(deg, minutes, (rest - F.floor(rest)) * 60.0, F.lit("s"))
    out = p.select("sample_id", deg.alias("deg"), minutes.alias("minutes"), micro.alias("micro_seconds"), south.alias("south"))
    return r(out, "south", 9)


@query("run_budgets", "P28", with_views("runs", """
    WITH p AS (SELECT run_id, runtime_s AS d, run_id % 900 + 1 AS n, CAST(registration_percent AS DOUBLE) AS fps FROM runs),
    b AS (SELECT *, round_even(0.35e0 * n, 0) AS want, CAST(least(240, greatest(10, round_even(d * 2.0e0, 0) + 1)) AS BIGINT) AS frames FROM p)
    SELECT run_id, round(greatest(3.5e0, 1.5e0 * d / 60), 6) AS deadline_minutes,
        CAST(least(n, least(72, greatest(20, want))) AS BIGINT) AS dense_references, frames AS frame_budget,
        round(greatest(0.5e0, least(3.0e0, 700 / d)), 6) AS candidate_fps,
        CAST(greatest(1, floor(fps / greatest(0.5e0, least(3.0e0, 700 / d)))) AS BIGINT) AS stride FROM b"""))
def run_budgets(spark, sf_dir):
    p = view(spark, sf_dir, "runs").select(
        "run_id", F.col("runtime_s").alias("d"), (F.col("run_id") % 900 + 1).alias("n"),
        F.col("registration_percent").alias("fps"),
    )
    candidate = F.greatest(F.lit(0.5), F.least(F.lit(3.0), 700 / F.col("d")))
    # rint is half-even, as the budget rules round
    out = p.select(
        "run_id", F.greatest(F.lit(3.5), 1.5 * F.col("d") / 60).alias("deadline_minutes"),
        F.least("n", F.least(F.lit(72), F.greatest(F.lit(20), F.rint(0.35 * F.col("n"))))).cast("bigint").alias("dense_references"),
        F.least(F.lit(240), F.greatest(F.lit(10), F.rint(F.col("d") * 2.0) + 1)).cast("bigint").alias("frame_budget"),
        candidate.alias("candidate_fps"),
        F.greatest(F.lit(1), F.floor(F.col("fps") / candidate)).cast("bigint").alias("stride"),
    )
    return r(out, "deadline_minutes candidate_fps")


@query("video_stream_checks", "P29", with_views("runs", """
    WITH p AS (SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 0 ELSE 1920 END AS width, 1080 AS height,
        CASE WHEN run_id % 13 = 0 THEN NULL ELSE 30000.0e0 / 1001 END AS avg_rate, CASE WHEN run_id % 5 = 0 THEN 30.0e0 ELSE 30000.0e0 / 1001 END AS real_rate,
        CASE WHEN run_id % 17 = 0 THEN 0.0e0 ELSE runtime_s END AS duration_s,
        CAST(floor(runtime_s * 30 * (1 + (run_id % 5 - 2) / 100.0e0)) AS BIGINT) AS nb, (run_id % 7 - 3) * 90 AS rot,
        CASE WHEN run_id % 19 <> 0 THEN 'h264' END AS codec FROM runs),
    e AS (SELECT *, duration_s * coalesce(avg_rate, 0) AS expected FROM p),
    f AS (SELECT *, CASE WHEN nb > 0 AND expected > 0 THEN abs(nb - expected) / expected END AS err FROM e)
    SELECT run_id, width > 0 AND height > 0 AS dimensions_valid, avg_rate IS NOT NULL AS frame_rate_valid,
        duration_s > 0 AS duration_valid, coalesce(err <= 0.02e0, true) AS declared_frame_count_consistent,
        codec IS NOT NULL AS codec_declared, round(err, 6) AS frame_count_error,
        coalesce(abs(real_rate - avg_rate) / avg_rate > 0.001e0, false) AS variable_frame_rate,
        (rot % 360 + 360) % 360 AS rotation_degrees,
        width > 0 AND avg_rate IS NOT NULL AND duration_s > 0 AND coalesce(err <= 0.02e0, true) AND codec IS NOT NULL AS critical_pass
    FROM f"""))
def video_stream_checks(spark, sf_dir):
    k = F.col("run_id")
    rate = F.lit(30000.0) / 1001
    p = view(spark, sf_dir, "runs").select(
        "run_id", F.when(k % 11 == 0, 0).otherwise(1920).alias("width"), F.lit(1080).alias("height"),
        F.when(k % 13 != 0, rate).alias("avg_rate"), F.when(k % 5 == 0, 30.0).otherwise(rate).alias("real_rate"),
        F.when(k % 17 == 0, 0.0).otherwise(F.col("runtime_s")).alias("duration_s"),
        F.floor(F.col("runtime_s") * 30 * (1 + (k % 5 - 2) / 100.0)).alias("nb"), ((k % 7 - 3) * 90).alias("rot"),
        F.when(k % 19 != 0, "h264").alias("codec"),
    )
    expected = F.col("duration_s") * F.coalesce("avg_rate", F.lit(0.0))
    err = F.when((F.col("nb") > 0) & (expected > 0), F.abs(F.col("nb") - expected) / expected)
    checks = {
        "dimensions_valid": (F.col("width") > 0) & (F.col("height") > 0),
        "frame_rate_valid": F.col("avg_rate").isNotNull(),
        "duration_valid": F.col("duration_s") > 0,
        "declared_frame_count_consistent": F.coalesce(err <= 0.02, F.lit(True)),
        "codec_declared": F.col("codec").isNotNull(),
    }
    variable = F.coalesce(F.abs(F.col("real_rate") - F.col("avg_rate")) / F.col("avg_rate") > 0.001, F.lit(False))
    out = p.select(
        "run_id", *[c.alias(n) for n, c in checks.items()], err.alias("frame_count_error"),
        variable.alias("variable_frame_rate"), F.pmod(F.col("rot"), F.lit(360)).alias("rotation_degrees"),
        gates.all_known_true(list(checks.values())).alias("critical_pass"),
    )
    return r(out, "frame_count_error")


def terminal_state(telemetry, capture, structural, substantive, production, deadline, stopped):
    """(state, comma-joined reasons) from the ordered decision list."""
    state = (
        F.when(~telemetry, "TELEMETRY_INVALID").when(~capture, "INSUFFICIENT_CAPTURE")
        .when(~structural | ~substantive, "FAILED").when(stopped, "DEADLINE_LIMITED")
        .when(~deadline | ~production, "PARTIAL_VALID").otherwise("COMPLETE")
    )
    reason = (
        F.when(~telemetry, "telemetry_validation_failed").when(~capture, "capture_quality_or_overlap_failed")
        .when(~structural, "required_artifacts_or_stages_failed").when(~substantive, "dense_geometry_is_degenerate")
        .when(stopped, gates.reasons([(stopped, "processing_stopped_at_deadline"), (~production, "production_gates_incomplete")]))
        .otherwise(gates.reasons([(~deadline, "runtime_target_exceeded"), (~production, "one_or_more_production_gates_failed")]))
    )
    return state, reason


@query("terminal_states", "P30", with_views("runs", """
    WITH p AS (SELECT run_id, run_id % 13 <> 0 AS t, run_id % 11 <> 0 AS c, run_id % 7 <> 0 AS s, run_id % 5 <> 0 AS g,
        production_ready AS q, runtime_s < 3000 AS d, run_id % 17 = 0 AS x FROM runs)
    SELECT run_id, CASE WHEN NOT t THEN 'TELEMETRY_INVALID' WHEN NOT c THEN 'INSUFFICIENT_CAPTURE' WHEN NOT s OR NOT g THEN 'FAILED'
        WHEN x THEN 'DEADLINE_LIMITED' WHEN NOT d OR NOT q THEN 'PARTIAL_VALID' ELSE 'COMPLETE' END AS state,
        CASE WHEN NOT t THEN 'telemetry_validation_failed' WHEN NOT c THEN 'capture_quality_or_overlap_failed'
        WHEN NOT s THEN 'required_artifacts_or_stages_failed' WHEN NOT g THEN 'dense_geometry_is_degenerate'
        WHEN x THEN 'processing_stopped_at_deadline' || CASE WHEN q THEN '' ELSE ',production_gates_incomplete' END
        ELSE concat_ws(',', CASE WHEN NOT d THEN 'runtime_target_exceeded' END,
             CASE WHEN NOT q THEN 'one_or_more_production_gates_failed' END) END AS reasons FROM p"""))
def terminal_states(spark, sf_dir):
    k = F.col("run_id")
    state, reason = terminal_state(
        k % 13 != 0, k % 11 != 0, k % 7 != 0, k % 5 != 0, F.col("production_ready"), F.col("runtime_s") < 3000, k % 17 == 0
    )
    return view(spark, sf_dir, "runs").select("run_id", state.alias("state"), reason.alias("reasons"))


def verify_pairs(matches, keys, total_matches, least=24, least_ratio=0.45, least_grid=0.25):
    """Pair verdicts from inlier matches with pixel fractions on both sides."""

    def cell(side):
        return F.struct(*[
            F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col(f"{axis}_{side}") * 4))).alias(axis) for axis in ("x", "y")
        ])

    from ..scale import Quantile, grouped

    move = F.sqrt(
        (F.col("x_b") - F.col("x_a")) * (F.col("x_b") - F.col("x_a"))
        + (F.col("y_b") - F.col("y_a")) * (F.col("y_b") - F.col("y_a"))
    )
    out = grouped(
        matches.withColumn("_move", move).withColumn("_ca", cell("a")).withColumn("_cb", cell("b")), keys,
        [F.count(F.lit(1)).alias("inliers"), F.count_distinct("_ca").alias("_na"), F.count_distinct("_cb").alias("_nb")],
        [Quantile("motion_fraction", F.col("_move"), 0.5)],
    ).join(total_matches, keys)
    out = out.withColumn("inlier_ratio", F.col("inliers") / F.col("matches")).withColumn(
        "grid_fraction", F.least("_na", "_nb") / 16.0
    )
    ok = (F.col("inliers") >= least) & (F.col("inlier_ratio") >= least_ratio) & (F.col("grid_fraction") >= least_grid)
    return out.withColumn("verified", ok).drop("_na", "_nb")


@query("pair_verification", "P31", """
    WITH m AS (SELECT l_suppkey AS pair_id, (l_orderkey * 7 % 100) / 100.0e0 AS x_a, (l_partkey * 13 % 100) / 100.0e0 AS y_a,
        (l_orderkey * 11 % 100) / 100.0e0 AS x_b, (l_partkey * 3 % 100) / 100.0e0 AS y_b, l_quantity > 25 AS inlier FROM lineitem),
    a AS (SELECT pair_id, count(*) AS inliers, count(DISTINCT floor(x_a * 4) * 4 + floor(y_a * 4)) AS na,
        count(DISTINCT floor(x_b * 4) * 4 + floor(y_b * 4)) AS nb,
        quantile_cont(sqrt((x_b - x_a) * (x_b - x_a) + (y_b - y_a) * (y_b - y_a)), 0.5) AS motion FROM m WHERE inlier GROUP BY pair_id),
    t AS (SELECT pair_id, count(*) AS matches FROM m GROUP BY pair_id)
    SELECT pair_id, inliers, matches, round(motion, 6) AS motion_fraction, round(inliers / matches, 6) AS inlier_ratio,
        least(na, nb) / 16.0e0 AS grid_fraction,
        inliers >= 24 AND inliers / matches >= 0.45e0 AND least(na, nb) / 16.0e0 >= 0.25e0 AS verified
    FROM a JOIN t USING (pair_id)""")
def pair_verification(spark, sf_dir):
    m = source(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("pair_id"), (F.col("l_orderkey") * 7 % 100 / 100.0).alias("x_a"),
        (F.col("l_partkey") * 13 % 100 / 100.0).alias("y_a"), (F.col("l_orderkey") * 11 % 100 / 100.0).alias("x_b"),
        (F.col("l_partkey") * 3 % 100 / 100.0).alias("y_b"), (F.col("l_quantity") > 25).alias("inlier"),
    )
    totals = m.groupBy("pair_id").agg(F.count(F.lit(1)).alias("matches"))
    return r(verify_pairs(m.filter("inlier"), ["pair_id"], totals), "motion_fraction inlier_ratio")
