"""Registered similarity, trajectory and pose queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof
from ..operators import similarity as ops
from ..operators.validation import norm
from ..scale import Quantile, grouped, lag, ordered
from .camera import overlap_rows
from .registry import query
from .telemetry import r
from .views import view, with_views


def _pairs(spark, sf_dir, wild: float = 60.0):
    """Known transform per run (scale 1.25, quarter turns, shift) with one wild pair in 31."""
    k, g = F.col("checkpoint_id"), F.col("run_id") % 4
    c, s = F.element_at(F.array(*map(F.lit, (1.0, 0.0, -1.0, 0.0))), (g + 1).cast("int")), F.element_at(F.array(*map(F.lit, (0.0, 1.0, 0.0, -1.0))), (g + 1).cast("int"))
    x, y, z = F.col("known_x_m"), F.col("known_y_m"), (k % 17).cast("double")
    return view(spark, sf_dir, "checkpoints").select(
        "run_id", "checkpoint_id", x.alias("x_a"), y.alias("y_a"), z.alias("z_a"),
        (1.25 * (c * x - s * y) + 4.0 + F.when(k % 31 == 0, wild).otherwise(0.0)).alias("x_b"),
        (1.25 * (s * x + c * y) - 2.0).alias("y_b"), (1.25 * z + 7.0 + (k % 3 - 1) / 100.0).alias("z_b"), (1.0 + k % 5 / 10.0).alias("weight"),
    )


_PAIRS = """
    pr AS (SELECT run_id, checkpoint_id, known_x_m AS xa, known_y_m AS ya, CAST(checkpoint_id % 17 AS DOUBLE) AS za, 1.0e0 + checkpoint_id % 5 / 10.0e0 AS w,
        CASE run_id % 4 WHEN 0 THEN 1.0e0 WHEN 2 THEN -1.0e0 ELSE 0.0e0 END AS c, CASE run_id % 4 WHEN 1 THEN 1.0e0 WHEN 3 THEN -1.0e0 ELSE 0.0e0 END AS s FROM checkpoints),
    pq AS (SELECT *, 1.25e0 * (c * xa - s * ya) + 4 + CASE WHEN checkpoint_id % 31 = 0 THEN 60 ELSE 0 END AS xb, 1.25e0 * (s * xa + c * ya) - 2 AS yb,
        1.25e0 * za + 7 + (checkpoint_id % 3 - 1) / 100.0e0 AS zb FROM pr)"""


@query("similarity_moments", "G10", with_views("checkpoints", f"""WITH {_PAIRS},
    m AS (SELECT run_id, sum(w) AS sw, sum(w * xa) / sum(w) AS ax, sum(w * ya) / sum(w) AS ay, sum(w * xb) / sum(w) AS bx, sum(w * yb) / sum(w) AS bb FROM pq GROUP BY run_id)
    SELECT run_id, count(*) AS n, round(any_value(sw), 4) AS sw, round(sum(w * (xb - bx) * (xa - ax)) / 1000, 4) AS cxx, round(sum(w * (xb - bx) * (ya - ay)) / 1000, 4) AS cxy,
        round(sum(w * (yb - bb) * (xa - ax)) / 1000, 4) AS cyx FROM pq JOIN m USING (run_id) GROUP BY run_id"""))
def similarity_moments(spark, sf_dir):
    m = ops.moments(_pairs(spark, sf_dir), ["run_id"], F.col("weight"))
    out = m.select("run_id", "n", "sw", *[(F.col(c) / 1000).alias(c) for c in ("cxx", "cxy", "cyx")])
    return r(out, "sw cxx cxy cyx", 4)


def _shown(df, *keep):
    f = F.col("fit")
    return df.select(*keep, f["ok"].alias("ok"), f["s"].alias("s"), *[f["r"][i].alias(f"r{i}") for i in (0, 1, 3)], *[f["t"][i].alias(f"t{i}") for i in range(3)])


# The transform each run was made with: what an exact or robust fit must find again, to the size of the z noise.
_TRUTH = "round(c, 2) AS r0, round(-s, 2) AS r1, round(s, 2) AS r3"


@query("similarity_fits", "G10 X2", with_views("checkpoints", f"""WITH {_PAIRS},
    m AS (SELECT run_id, c, s, sum(w * xa) / sum(w) AS ax, sum(w * ya) / sum(w) AS ay, sum(w * za) / sum(w) AS az, sum(w * xb) / sum(w) AS bx, sum(w * yb) / sum(w) AS bb,
        sum(w * zb) / sum(w) AS bz FROM (SELECT * REPLACE (xb - CASE WHEN checkpoint_id % 31 = 0 THEN 60 ELSE 0 END AS xb) FROM pq) GROUP BY run_id, c, s)
    SELECT run_id, true AS ok, k AS s, {_TRUTH}, round(bx - k * (c * ax - s * ay), 1) AS t0, round(bb - k * (s * ax + c * ay), 1) AS t1, round(bz - k * az, 1) AS t2, mode
    FROM m, (VALUES ('umeyama', 1.25e0), ('rms', 1.25e0), ('rigid', 1.0e0)) t(mode, k)"""))
def similarity_fits(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, wild=0.0)
    parts = [_shown(ops.fit(pairs, ["run_id"], F.col("weight"), mode), "run_id").withColumn("mode", F.lit(mode)) for mode in ("umeyama", "rms", "rigid")]
    return r(r(parts[0].unionByName(parts[1]).unionByName(parts[2]), "s r0 r1 r3", 2), "t0 t1 t2", 1)


@query("trimmed_similarity", "G11")
def trimmed_similarity(spark, sf_dir):
    out = ops.trimmed_fit(_pairs(spark, sf_dir), ["run_id"])
    return r(_shown(out, "run_id", "inliers", "correspondences", "median_error", "relative_error", "trusted"), "s r0 r1 r3 t0 t1 t2 median_error relative_error", 4)


@query("window_alignments", "G11 J6")
def window_alignments(spark, sf_dir):
    # source is the later window, target the earlier one
    pairs = overlap_rows(spark, sf_dir).select(
        "seq_id", "chunk_a", "weight", *[F.col(f"{a}_b").alias(f"{a}_a") for a in "xyz"], *[F.col(f"{a}_a").alias(f"{a}_b") for a in "xyz"]
    )
    out = ops.trimmed_fit(pairs, ["seq_id", "chunk_a"])
    return r(_shown(out, "seq_id", "chunk_a", "inliers", "trusted"), "s r0 r1 r3 t0 t1 t2", 4)


@query("huber_similarity", "G11")
def huber_similarity(spark, sf_dir):
    return r(_shown(ops.huber_fit(_pairs(spark, sf_dir), ["run_id"], 0.5), "run_id"), "s r0 r1 r3 t0 t1 t2", 3)


@query("quantile_similarity", "G11", with_views("checkpoints", f"""WITH {_PAIRS}
    SELECT DISTINCT run_id, true AS ok, 1.25e0 AS s, {_TRUTH}, 4.0e0 AS t0, -2.0e0 AS t1, 7.0e0 AS t2 FROM pq"""))
def quantile_similarity(spark, sf_dir):
    out = _shown(ops.quantile_fit(_pairs(spark, sf_dir), ["run_id"]), "run_id")
    return r(r(out, "s r0 r1 r3", 2), "t0 t1 t2", 1)


@query("control_point_consensus", "G11", with_views("checkpoints", f"""WITH {_PAIRS}
    SELECT run_id, checkpoint_id, checkpoint_id % 31 <> 0 AS inlier, count(*) FILTER (checkpoint_id % 31 <> 0) OVER (PARTITION BY run_id) AS inliers,
        true AS ok, 1.25e0 AS s, {_TRUTH}, 4.0e0 AS t0, -2.0e0 AS t1, 7.0e0 AS t2 FROM pq"""))
def control_point_consensus(spark, sf_dir):
    out = ops.consensus_fit(_pairs(spark, sf_dir), ["run_id"], "checkpoint_id", 1.0)
    return r(r(_shown(out, "run_id", "checkpoint_id", "inlier", "inliers"), "s r0 r1 r3", 2), "t0 t1 t2", 1)


@query("control_point_report", "G11 G6", with_views("checkpoints", f"""WITH {_PAIRS},
    i AS (SELECT * FROM pq WHERE checkpoint_id % 31 <> 0),
    e AS (SELECT run_id, abs(zb - 1.25e0 * za - 7) AS d FROM i)
    SELECT run_id, any_value(n) AS control_points, count(*) AS inliers, any_value(n) - count(*) AS outliers, round(sqrt(avg(d * d)), 2) AS fit_rmse_m,
        round(max(d), 1) AS maximum_inlier_error_m, 25.0e0 AS scale_change_percent, count(*) >= 3 AS passes_fit_gate
    FROM e JOIN (SELECT run_id, count(*) AS n FROM pq GROUP BY run_id) USING (run_id) GROUP BY run_id"""))
def control_point_report(spark, sf_dir):
    flagged = ops.consensus_fit(_pairs(spark, sf_dir), ["run_id"], "checkpoint_id", 1.0)
    out = ops.consensus_report(flagged, ["run_id"], 1.0).drop("fit_median_error_m")
    return r(r(r(out, "fit_rmse_m", 2), "maximum_inlier_error_m", 1), "scale_change_percent", 1)


@query("half_sample_similarity", "G11")
def half_sample_similarity(spark, sf_dir):
    return r(_shown(ops.half_sample_fit(_pairs(spark, sf_dir), ["run_id"], "checkpoint_id"), "run_id"), "s r0 r1 r3 t0 t1 t2", 2)


@query("scale_ratios", "G12", with_views("pixels", """
    WITH p AS (SELECT seq_id, pixel, frame_id, depth AS a, depth * (0.8e0 + (pixel % 7) / 20.0e0) AS b, (conf * (1 + sky)) * (conf * (1 + sky)) AS w FROM pixels WHERE depth > 0),
    q AS (SELECT *, a / b AS ratio FROM p), u AS (SELECT *, sum(w) OVER (PARTITION BY seq_id ORDER BY ratio, frame_id, pixel) AS upto, sum(w) OVER (PARTITION BY seq_id) AS total FROM q)
    SELECT seq_id, round(sum(a * b) / sum(b * b), 6) AS least_squares, round(min(ratio) FILTER (upto >= 0.5e0 * total), 6) AS weighted_median,
        round(min(ratio) FILTER (upto >= 0.9e0 * total), 6) AS weighted_p90, count(*) AS valid,
        round(CASE WHEN count(*) >= 100 AND sum(a * b) / sum(b * b) > 0.1e0 AND sum(a * b) / sum(b * b) < 10 THEN sum(a * b) / sum(b * b) ELSE 1 END, 6) AS used FROM u GROUP BY seq_id"""))
def scale_ratios(spark, sf_dir):
    c = F.col("conf") * (1 + F.col("sky"))
    p = view(spark, sf_dir, "pixels").filter("depth > 0").select(
        "seq_id", "frame_id", "pixel", F.col("depth").alias("a"), (F.col("depth") * (0.8 + F.col("pixel") % 7 / 20.0)).alias("b"), (c * c).alias("w")
    ).withColumn("ratio", F.col("a") / F.col("b"))
    lsq = ops.least_squares_scale(p, ["seq_id"], "a", "b").withColumnRenamed("scale", "least_squares")
    order = ["frame_id", "pixel"]
    med = ops.weighted_quantile(p, ["seq_id"], "ratio", "w", 0.5, order).withColumnRenamed("value", "weighted_median")
    far = ops.weighted_quantile(p, ["seq_id"], "ratio", "w", 0.9, order).withColumnRenamed("value", "weighted_p90")
    n = p.groupBy("seq_id").agg(F.count(F.lit(1)).alias("valid"))
    out = lsq.join(med, "seq_id").join(far, "seq_id").join(n, "seq_id")
    out = out.withColumn("used", ops.sane_scale(F.col("least_squares"), F.col("valid")))
    return r(out, "least_squares weighted_median weighted_p90 used")


def _matched_tracks(spark, sf_dir):
    """Camera centres beside truth interpolated at the frame times (metres on a local plane)."""
    samples = view(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", "time_s", ((F.col("longitude") - 77.0) * 108000.0).alias("x"), ((F.col("latitude") - 12.0) * 110000.0).alias("y"),
        F.col("altitude_m").alias("z"),
    )
    truth = asof.interpolate(view(spark, sf_dir, "frames"), samples, ["flight_id"], linear=["x", "y", "z"])
    k = F.col("frame_id")
    return truth.select(
        "flight_id", "frame_id", "time_s", (F.col("y") * -1.02 + k % 5 / 10.0).alias("x_a"), (F.col("x") * 1.02 + k % 3 / 10.0).alias("y_a"), (F.col("z") * 1.02).alias("z_a"),
        *[F.col(a).alias(f"{a}_b") for a in "xyz"],
    )


_TRACK = """
    sm AS (SELECT flight_id, time_s, (longitude - 77.0e0) * 108000.0e0 AS x, (latitude - 12.0e0) * 110000.0e0 AS y, altitude_m AS z FROM telemetry),
    l AS (SELECT f.flight_id, f.frame_id, f.time_s AS t, s.time_s AS lt, s.x AS lx, s.y AS ly, s.z AS lz FROM frames f ASOF LEFT JOIN sm s ON f.flight_id = s.flight_id AND f.time_s >= s.time_s),
    b AS (SELECT l.*, s.time_s AS rt, s.x AS rx, s.y AS ry, s.z AS rz FROM l ASOF LEFT JOIN sm s ON l.flight_id = s.flight_id AND l.t < s.time_s),
    tr AS (SELECT flight_id, frame_id, t, coalesce(lx + (t - lt) / (rt - lt) * (rx - lx), lx, rx) AS x, coalesce(ly + (t - lt) / (rt - lt) * (ry - ly), ly, ry) AS y,
        coalesce(lz + (t - lt) / (rt - lt) * (rz - lz), lz, rz) AS z FROM b),
    ce AS (SELECT flight_id, frame_id, t, y * -1.02e0 + frame_id % 5 / 10.0e0 AS ca, x * 1.02e0 + frame_id % 3 / 10.0e0 AS cb, z * 1.02e0 AS cc, x, y, z FROM tr),
    st AS (SELECT flight_id, sqrt(pow(ca - lag(ca) OVER w, 2) + pow(cb - lag(cb) OVER w, 2) + pow(cc - lag(cc) OVER w, 2)) AS e,
        sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS g FROM ce WINDOW w AS (PARTITION BY flight_id ORDER BY t, frame_id))"""


def _path_ratio(track):
    both = [f"{a}_{s}" for s in "ab" for a in "xyz"]
    steps = ordered(track, ["flight_id"], ["time_s", "frame_id"], {"_p": lag(F.struct(*both))})

    def step(side):
        return norm(*[F.col(f"{a}_{side}") - F.col("_p")[f"{a}_{side}"] for a in "xyz"])

    out = steps.groupBy("flight_id").agg(F.sum(step("a")).alias("estimated_m"), F.sum(step("b")).alias("truth_m"))
    ratio = F.when(F.col("truth_m") > 0, F.col("estimated_m") / F.col("truth_m"))
    return out.withColumn("scale_ratio", ratio).withColumn("scale_error_percent", F.abs(ratio - 1.0) * 100)


@query("trajectory_path_ratio", "G13 J2", with_views("telemetry frames", f"""WITH {_TRACK}
    SELECT flight_id, round(sum(e), 4) AS estimated_m, round(sum(g), 4) AS truth_m, round(CASE WHEN sum(g) > 0 THEN sum(e) / sum(g) END, 6) AS scale_ratio,
        round(CASE WHEN sum(g) > 0 THEN abs(sum(e) / sum(g) - 1) * 100 END, 6) AS scale_error_percent FROM st GROUP BY flight_id"""))
def trajectory_path_ratio(spark, sf_dir):
    return r(r(_path_ratio(_matched_tracks(spark, sf_dir)), "estimated_m truth_m", 4), "scale_ratio scale_error_percent")


@query("trajectory_report", "G13")
def trajectory_report(spark, sf_dir):
    track = _matched_tracks(spark, sf_dir)
    fits = ops.fit(track, ["flight_id"], mode="rigid").filter("n >= 3")
    errors = track.join(fits, "flight_id").withColumn("_e", ops.residual())
    out = grouped(errors, ["flight_id"], [F.count(F.lit(1)).alias("matched_cameras"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_m")],
                  [Quantile("median_m", F.col("_e"), 0.5), Quantile("p95_m", F.col("_e"), 0.95)])
    out = out.join(_path_ratio(track), "flight_id").withColumn("passes_one_metre", F.col("rmse_m") <= 1.0)
    return r(out, "rmse_m median_m p95_m estimated_m truth_m scale_ratio scale_error_percent", 4)


def _pose_pairs(spark, sf_dir):
    k = F.col("frame_id")
    e = k * 0.01 + k % 7 * 0.004
    poses = view(spark, sf_dir, "poses").select(
        "seq_id", "frame_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", F.cos(e).alias("p_qw"), F.lit(0.0).alias("p_qx"), F.lit(0.0).alias("p_qy"),
        F.sin(e).alias("p_qz"), (F.col("tx") + k % 5 * 0.05).alias("p_tx"), (F.col("ty") + k % 3 * 0.05).alias("p_ty"), F.col("tz").alias("p_tz"),
    )
    return ops.frame_pairs(ops.frame_sample(poses, "seq_id", "frame_id", 100), "seq_id", "frame_id")


_SAMPLE = """
    sp AS (SELECT * FROM poses QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY md5('43-' || CAST(seq_id AS STRING) || '-' || CAST(frame_id AS STRING)), frame_id) <= 100),
    ps AS (SELECT seq_id, frame_id, qw AS w, qz AS z, tx, ty, tz, cos(frame_id * 0.01e0 + frame_id % 7 * 0.004e0) AS pw, sin(frame_id * 0.01e0 + frame_id % 7 * 0.004e0) AS pz,
        tx + frame_id % 5 * 0.05e0 AS px, ty + frame_id % 3 * 0.05e0 AS py FROM sp)"""


@query("frame_pair_index", "J13 G26", with_views("poses", f"""WITH {_SAMPLE}
    SELECT a.seq_id, a.frame_id AS frame_id_i, b.frame_id AS frame_id_j FROM ps a JOIN ps b ON a.seq_id = b.seq_id AND a.frame_id < b.frame_id"""))
def frame_pair_index(spark, sf_dir):
    return _pose_pairs(spark, sf_dir).select("seq_id", "frame_id_i", "frame_id_j")


@query("pose_accuracy_area", "G14 J13 P8", with_views("poses", f"""WITH {_SAMPLE},
    pr AS (SELECT a.seq_id, a.w * b.w + a.z * b.z AS rw, a.w * b.z - a.z * b.w AS rz, a.pw * b.pw + a.pz * b.pz AS sw, a.pw * b.pz - a.pz * b.pw AS sz,
        a.w * a.w - a.z * a.z AS c, 2 * a.w * a.z AS s, a.pw * a.pw - a.pz * a.pz AS pc, 2 * a.pw * a.pz AS psn,
        b.tx - a.tx AS dx, b.ty - a.ty AS dy, b.tz - a.tz AS dz, b.px - a.px AS ex, b.py - a.py AS ey FROM ps a JOIN ps b ON a.seq_id = b.seq_id AND a.frame_id < b.frame_id),
    vt AS (SELECT *, c * dx + s * dy AS ux, -s * dx + c * dy AS uy, pc * ex + psn * ey AS vx, -psn * ex + pc * ey AS vy, rw * sw + rz * sz AS dot FROM pr),
    er AS (SELECT seq_id, degrees(acos(greatest(-1, least(1, 2 * dot * dot - 1)))) AS rot,
        greatest(1 - pow((ux * vx + uy * vy + dz * dz) / ((sqrt(ux * ux + uy * uy + dz * dz) + 1e-15) * (sqrt(vx * vx + vy * vy + dz * dz) + 1e-15)), 2), 1e-15) AS loss FROM vt),
    tt AS (SELECT seq_id, rot, degrees(acos(sqrt(greatest(1 - loss, 0)))) AS sh FROM er),
    ee AS (SELECT seq_id, greatest(rot, least(sh, abs(180 - sh))) AS e FROM tt),
    hb AS (SELECT seq_id, T, b, count(*) FILTER (floor(e) = b OR (b = T - 1 AND e = T)) / count(*) AS share FROM ee, (VALUES (3), (5), (15), (30)) t(T), range(30) g(b) WHERE b < T GROUP BY seq_id, T, b),
    cs AS (SELECT seq_id, T, sum(share) OVER (PARTITION BY seq_id, T ORDER BY b) AS cum FROM hb),
    au AS (SELECT seq_id, T, avg(cum) AS a FROM cs GROUP BY seq_id, T), n AS (SELECT seq_id, count(*) AS pairs FROM ee GROUP BY seq_id)
    SELECT seq_id, pairs, round(max(a) FILTER (T = 3), 6) AS auc_3, round(max(a) FILTER (T = 5), 6) AS auc_5, round(max(a) FILTER (T = 15), 6) AS auc_15,
        round(max(a) FILTER (T = 30), 6) AS auc_30 FROM au JOIN n USING (seq_id) GROUP BY seq_id, pairs"""))
def pose_accuracy_area(spark, sf_dir):
    return r(ops.accuracy_area(ops.pair_errors(_pose_pairs(spark, sf_dir)), ["seq_id"]), "auc_3 auc_5 auc_15 auc_30")


@query("accumulated_transforms", "W11", with_views("poses", """
    WITH RECURSIVE ix AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_id) AS k FROM poses),
    ac AS (SELECT seq_id, frame_id, k, qw, qz, tx, ty, tz, s FROM ix WHERE k = 1 UNION ALL
        SELECT n.seq_id, n.frame_id, n.k, a.qw * n.qw - a.qz * n.qz, a.qw * n.qz + a.qz * n.qw,
            a.s * ((a.qw * a.qw - a.qz * a.qz) * n.tx - 2 * a.qw * a.qz * n.ty) + a.tx, a.s * (2 * a.qw * a.qz * n.tx + (a.qw * a.qw - a.qz * a.qz) * n.ty) + a.ty,
            a.s * n.tz + a.tz, a.s * n.s FROM ac a JOIN ix n ON n.seq_id = a.seq_id AND n.k = a.k + 1)
    SELECT seq_id, frame_id, round(qw, 5) AS qw, round(qz, 5) AS qz, round(tx, 7) AS tx, round(ty, 7) AS ty, round(tz, 7) AS tz, round(s, 6) AS s FROM ac"""))
def accumulated_transforms(spark, sf_dir):
    out = ops.prefix_products(view(spark, sf_dir, "poses"), "seq_id", "frame_id")
    out = out.select("seq_id", "frame_id", "qw", "qz", "tx", "ty", "tz", "s")
    return r(r(r(out, "qw qz", 5), "tx ty tz", 7), "s")
