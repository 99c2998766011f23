"""Registered geometry and depth queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera, geo
from ..operators import depth as ops
from . import sqltext as q
from .registry import query
from .telemetry import r
from .views import view, with_views

_E2 = repr(geo.WGS84_E2)


@query("geodetic_to_enu", "P4", with_views("telemetry", f"""
    WITH x AS (SELECT flight_id, sample_id, {", ".join(f"{e} AS x{i}" for i, e in enumerate(q.ecef('latitude', 'longitude', 'altitude_m')))},
        {", ".join(f"{e} AS o{i}" for i, e in enumerate(q.ecef('12.001e0', '77.002e0', '100.0e0')))} FROM telemetry)
    SELECT flight_id, sample_id, {", ".join(f"round({e}, 4) AS {n}" for e, n in zip(q.enu_from_ecef('(x0 - o0)', '(x1 - o1)', '(x2 - o2)', '12.001e0', '77.002e0'), ('east_m', 'north_m', 'up_m')))}
    FROM x"""))
def geodetic_to_enu(spark, sf_dir):
    e, n, u = geo.enu(F.col("latitude"), F.col("longitude"), F.col("altitude_m"), F.lit(12.001), F.lit(77.002), F.lit(100.0))
    out = view(spark, sf_dir, "telemetry").select("flight_id", "sample_id", e.alias("east_m"), n.alias("north_m"), u.alias("up_m"))
    return r(out, "east_m north_m up_m", 4)


def _rounds():
    parts = ["""r0 AS (SELECT point_id, scan_id, x * 3 - 100 AS e, y * 2 - 50 AS n, z AS u FROM points)"""]
    o = q.ecef("12.001e0", "77.002e0", "100.0e0")
    sp, cp, sl, cl = "sin(radians(12.001e0))", "cos(radians(12.001e0))", "sin(radians(77.002e0))", "cos(radians(77.002e0))"
    parts.append(f"""r1 AS (SELECT point_id, scan_id, {o[0]} - {sl} * e - {sp} * {cl} * n + {cp} * {cl} * u AS x,
        {o[1]} + {cl} * e - {sp} * {sl} * n + {cp} * {sl} * u AS y, {o[2]} + {cp} * n + {sp} * u AS z FROM r0)""")
    parts.append(f"""l0 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * (1.0e0 - {_E2})) AS lat, 0.0e0 AS h FROM r1)""")
    for i in range(6):
        parts.append(f"""n{i} AS (SELECT * EXCLUDE (h), 6378137.0e0 / sqrt(1.0e0 - {_E2} * sin(lat) * sin(lat)) AS nn FROM l{i})""")
        parts.append(f"""h{i} AS (SELECT *, p / cos(lat) - nn AS h FROM n{i})""")
        parts.append(f"""l{i + 1} AS (SELECT * EXCLUDE (lat, nn), atan2(z, p * (1.0e0 - {_E2} * nn / (nn + h))) AS lat FROM h{i})""")
    return ", ".join(parts)


@query("enu_to_geodetic", "P5", with_views("points", f"""WITH {_rounds()}
    SELECT point_id, scan_id, round(lat * 180 / pi(), 8) AS lat, round(atan2(y, x) * 180 / pi(), 8) AS lon, round(h, 4) AS height FROM l6"""))
def enu_to_geodetic(spark, sf_dir):
    e, n, u = F.col("x") * 3 - 100, F.col("y") * 2 - 50, F.col("z")
    x, y, z = geo.enu_to_ecef(e, n, u, F.lit(12.001), F.lit(77.002), F.lit(100.0))
    placed = view(spark, sf_dir, "points").select("point_id", "scan_id", x.alias("ex"), y.alias("ey"), z.alias("ez"))
    out = geo.with_geodetic(placed, F.col("ex"), F.col("ey"), F.col("ez")).select("point_id", "scan_id", "lat", "lon", "height")
    return r(r(out, "lat lon", 8), "height", 4)


_XI = " + ".join(f"{a!r} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)" for j, a in enumerate(geo.KRUEGER_ALPHA, 1))
_ETA = " + ".join(f"{a!r} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)" for j, a in enumerate(geo.KRUEGER_ALPHA, 1))


@query("utm_coordinates", "P6", with_views("telemetry", f"""
    WITH p AS (SELECT flight_id, sample_id, CASE WHEN flight_id % 2 = 0 THEN latitude ELSE -latitude - flight_id % 50 END AS lat,
        longitude - (flight_id % 36) * 5 AS lon FROM telemetry),
    z AS (SELECT *, CAST(floor((lon + 180) / 6) AS BIGINT) + 1 AS zone FROM p),
    t AS (SELECT *, tan(radians(lat)) AS t, radians(lon) - radians(zone * 6 - 183) AS dl FROM z),
    s AS (SELECT *, sinh(sqrt({_E2}) * atanh(sqrt({_E2}) * t / sqrt(1 + t * t))) AS sg FROM t),
    u AS (SELECT *, t * sqrt(1 + sg * sg) - sg * sqrt(1 + t * t) AS tau FROM s),
    v AS (SELECT *, atan2(tau, cos(dl)) AS xi0, asinh(sin(dl) / sqrt(tau * tau + cos(dl) * cos(dl))) AS eta0 FROM u)
    SELECT flight_id, sample_id, zone, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS epsg,
        round(500000.0e0 + 0.9996e0 * {geo.KRUEGER_RADIUS!r} * (eta0 + {_ETA}), 3) AS easting,
        round(0.9996e0 * {geo.KRUEGER_RADIUS!r} * (xi0 + {_XI}) + CASE WHEN lat < 0 THEN 10000000.0e0 ELSE 0.0e0 END, 3) AS northing FROM v"""))
def utm_coordinates(spark, sf_dir):
    f = F.col("flight_id")
    p = view(spark, sf_dir, "telemetry").select(
        "flight_id", "sample_id", F.when(f % 2 == 0, F.col("latitude")).otherwise(-F.col("latitude") - f % 50).alias("lat"),
        (F.col("longitude") - f % 36 * 5).alias("lon"),
    )
    e, n = geo.utm(F.col("lat"), F.col("lon"))
    out = p.select("flight_id", "sample_id", geo.utm_zone(F.col("lon")).alias("zone"), geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"),
                   e.alias("easting"), n.alias("northing"))
    return r(out, "easting northing", 3)


def _pose(p=""):
    return [F.col(f"{p}{c}") for c in ("qw", "qx", "qy", "qz")], [F.col(f"{p}{c}") for c in ("tx", "ty", "tz")]


# The derived poses turn about z only, so the checking text can use plane rotation.
@query("rotation_round_trip", "P7", with_views("poses", """
    SELECT seq_id, frame_id, round(qw * qw - qz * qz, 6) AS r00, round(-2 * qz * qw, 6) AS r01, round(2 * qz * qw, 6) AS r10,
        1.0e0 AS r22, round(abs(qw), 6) AS q_w, round(CASE WHEN qw < 0 THEN -qz ELSE qz END, 6) AS q_z, 0.0e0 AS q_x,
        round(-((qw * qw - qz * qz) * tx + 2 * qz * qw * ty), 5) AS cx, round(-(-2 * qz * qw * tx + (qw * qw - qz * qz) * ty), 5) AS cy,
        round(-tz, 5) AS cz FROM poses"""))
def rotation_round_trip(spark, sf_dir):
    quat, t = _pose()
    m = camera.rotation(*quat)
    back = camera.quaternion(m)
    c = camera.camera_centre(*quat, *t)
    out = view(spark, sf_dir, "poses").select(
        "seq_id", "frame_id", m[0][0].alias("r00"), m[0][1].alias("r01"), m[1][0].alias("r10"), m[2][2].alias("r22"),
        back[0].alias("q_w"), back[3].alias("q_z"), back[1].alias("q_x"), c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"),
    )
    return r(r(out, "r00 r01 r10 r22 q_w q_z q_x"), "cx cy cz", 5)


_STEPS = """
    st AS (SELECT seq_id, frame_id, qw AS w1, qz AS z1, tx AS x1, ty AS y1, tz AS h1, s AS s1, lead(qw) OVER w AS w2, lead(qz) OVER w AS z2,
        lead(tx) OVER w AS x2, lead(ty) OVER w AS y2, lead(tz) OVER w AS h2, lead(s) OVER w AS s2 FROM poses WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id)),
    sc AS (SELECT *, w1 * w1 - z1 * z1 AS c1, 2 * w1 * z1 AS n1, w2 * w2 - z2 * z2 AS c2, 2 * w2 * z2 AS n2 FROM st WHERE w2 IS NOT NULL)"""


def _steps(spark, sf_dir):
    from ..scale import lead, ordered

    fields = ["qw", "qx", "qy", "qz", "tx", "ty", "tz", "s"]
    out = ordered(view(spark, sf_dir, "poses"), ["seq_id"], ["frame_id"], {"_next": lead(F.struct(*fields))})
    return out.filter("_next is not null").select("*", *[F.col("_next")[c].alias(f"n_{c}") for c in fields])


@query("relative_poses", "P8 P10", with_views("poses", f"""WITH {_STEPS}
    SELECT seq_id, frame_id, round(c1 * c2 + n1 * n2, 6) AS rel_r00, round(n2 * c1 - c2 * n1, 6) AS rel_r10,
        round(c1 * (x2 - x1) + n1 * (y2 - y1), 5) AS rel_x, round(-n1 * (x2 - x1) + c1 * (y2 - y1), 5) AS rel_y, round(h2 - h1, 5) AS rel_z,
        round(s2 / s1, 6) AS sim_s, round(x2 - s2 / s1 * ((c2 * c1 + n2 * n1) * x1 - (n2 * c1 - c2 * n1) * y1), 5) AS sim_x,
        round(y2 - s2 / s1 * ((n2 * c1 - c2 * n1) * x1 + (c2 * c1 + n2 * n1) * y1), 5) AS sim_y, round(h2 - s2 / s1 * h1, 5) AS sim_z FROM sc"""))
def relative_poses(spark, sf_dir):
    (qa, ta), (qb, tb) = _pose(), _pose("n_")
    ra, rb = camera.rotation(*qa), camera.rotation(*qb)
    rel, t = camera.relative_pose(ra, ta, rb, tb)
    s, _, st = camera.relative_similarity(F.col("s"), ra, ta, F.col("n_s"), rb, tb)
    out = _steps(spark, sf_dir).select(
        "seq_id", "frame_id", rel[0][0].alias("rel_r00"), rel[1][0].alias("rel_r10"), t[0].alias("rel_x"), t[1].alias("rel_y"),
        t[2].alias("rel_z"), s.alias("sim_s"), st[0].alias("sim_x"), st[1].alias("sim_y"), st[2].alias("sim_z"),
    )
    return r(r(out, "rel_r00 rel_r10 sim_s"), "rel_x rel_y rel_z sim_x sim_y sim_z", 5)


@query("similarity_applied", "P9", with_views("poses", """
    SELECT seq_id, frame_id, round(s * ((qw * qw - qz * qz) * 3 - 2 * qw * qz * 4) + tx, 5) AS x,
        round(s * (2 * qw * qz * 3 + (qw * qw - qz * qz) * 4) + ty, 5) AS y, round(s * 5 + tz, 5) AS z,
        3.0e0 AS back_x, 4.0e0 AS back_y, 5.0e0 AS back_z FROM poses"""))
def similarity_applied(spark, sf_dir):
    quat, t = _pose()
    m, s = camera.rotation(*quat), F.col("s")
    p = camera.apply_similarity(s, m, t, [F.lit(3.0), F.lit(4.0), F.lit(5.0)])
    back = camera.invert_similarity(s, m, t, p)
    out = view(spark, sf_dir, "poses").select("seq_id", "frame_id", *[c.alias(n) for c, n in zip(p, "xyz")],
                                              *[c.alias(f"back_{n}") for c, n in zip(back, "xyz")])
    return r(r(out, "x y z", 5), "back_x back_y back_z")


FX, FY, CX, CY = 8.0, 9.0, 3.5, 3.5


def posed_pixels(spark, sf_dir):
    """Pixels with a camera that turns about z and moves along x with its frame number."""
    a = F.col("frame_id") * 0.05
    return view(spark, sf_dir, "pixels").select(
        "*", F.cos(a).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(a).alias("qz"),
        (F.col("frame_id") % 8 * 0.5).alias("tx"), F.lit(1.0).alias("ty"), F.lit(2.0).alias("tz"),
    )


_WORLD = """
    cam AS (SELECT *, cos(frame_id * 0.05e0) * cos(frame_id * 0.05e0) - sin(frame_id * 0.05e0) * sin(frame_id * 0.05e0) AS c,
        2 * cos(frame_id * 0.05e0) * sin(frame_id * 0.05e0) AS n, (u - 3.5e0) / 8.0e0 * depth AS px, (v - 3.5e0) / 9.0e0 * depth AS py FROM pixels),
    wp AS (SELECT seq_id, frame_id, pixel, u, v, depth, conf, c, n, c * px - n * py + frame_id % 8 * 0.5e0 AS x, n * px + c * py + 1 AS y, depth + 2 AS z
        FROM cam WHERE depth > 0)"""


@query("pixel_world_points", "P11 X3", with_views("pixels", f"""WITH {_WORLD}
    SELECT frame_id, pixel, {q.rounded('x y z', 5)} FROM wp"""))
def pixel_world_points(spark, sf_dir):
    out = ops.world_points(posed_pixels(spark, sf_dir), FX, FY, CX, CY).select("frame_id", "pixel", "x", "y", "z")
    return r(out, "x y z", 5)


@query("projected_pixels", "P12", with_views("pixels", f"""WITH {_WORLD},
    tr AS (SELECT frame_id, pixel, x - (frame_id + 1) % 8 * 0.5e0 AS dx, y - 1 AS dy, z - 2 AS dz,
        cos((frame_id + 1) * 0.1e0) AS c2, sin((frame_id + 1) * 0.1e0) AS n2 FROM wp)
    SELECT frame_id, pixel, round(8 * (c2 * dx + n2 * dy) / dz + 3.5e0, 4) AS pu, round(9 * (-n2 * dx + c2 * dy) / dz + 3.5e0, 4) AS pv,
        round(dz, 5) AS pz FROM tr"""))
def projected_pixels(spark, sf_dir):
    world = ops.world_points(posed_pixels(spark, sf_dir), FX, FY, CX, CY)
    # the neighbouring frame's camera
    a = (F.col("frame_id") + 1) * 0.05
    m = camera.rotation(F.cos(a), F.lit(0.0), F.lit(0.0), F.sin(a))
    back, origin = camera.invert_rigid(m, [(F.col("frame_id") + 1) % 8 * 0.5, F.lit(1.0), F.lit(2.0)])
    u, v, z = camera.project([F.col(c) for c in "xyz"], back, origin, FX, FY, CX, CY)
    out = world.select("frame_id", "pixel", u.alias("pu"), v.alias("pv"), z.alias("pz"))
    return r(r(out, "pu pv", 4), "pz", 5)


@query("rays_and_fields", "P13 P14", with_views("pixels", """
    WITH k AS (SELECT frame_id, pixel, u, v, 600 + frame_id % 50 AS fx, 1920 - frame_id % 7 AS w, (u - 3.5e0) / 8 AS a, (v - 3.5e0) / 9 AS b FROM pixels)
    SELECT frame_id, pixel, round(a / sqrt(a * a + b * b + 1), 6) AS ray_x, round(b / sqrt(a * a + b * b + 1), 6) AS ray_y,
        round(1 / sqrt(a * a + b * b + 1), 6) AS ray_z, round(2 * atan(w / 2.0e0 / fx), 6) AS fov, round(CAST(fx AS DOUBLE), 6) AS focal,
        round(fx * 518.0e0 / w, 6) AS scaled_fx, round(960 - floor((w - 518) / 2), 6) AS crop_cx FROM k"""))
def rays_and_fields(spark, sf_dir):
    w, fx = 1920 - F.col("frame_id") % 7, 600 + F.col("frame_id") % 50
    still = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    ray = camera.world_ray(F.col("u"), F.col("v"), FX, FY, CX, CY, still)
    fov = camera.fov_from_focal(w, fx)
    sfx, *_ = camera.rescale_intrinsics(fx, fx, F.lit(960.0), F.lit(540.0), w, F.lit(1080), F.lit(518.0), F.lit(518.0))
    ccx, _ = camera.crop_intrinsics(F.lit(960.0), F.lit(540.0), w, F.lit(1080), F.lit(518), F.lit(518))
    out = view(spark, sf_dir, "pixels").select(
        "frame_id", "pixel", *[c.alias(f"ray_{n}") for c, n in zip(ray, "xyz")], fov.alias("fov"),
        camera.focal_from_fov(w, fov).alias("focal"), sfx.alias("scaled_fx"), ccx.alias("crop_cx"),
    )
    return r(out, "ray_x ray_y ray_z fov focal scaled_fx crop_cx")


@query("depth_alignment_mask", "P15", with_views("pixels", """
    WITH m AS (SELECT *, depth * ((8 + 9) / 2.0e0 / 300) AS md, quantile_cont(conf, 0.5) OVER (PARTITION BY frame_id) AS med FROM pixels)
    SELECT frame_id, pixel, round(md, 6) AS metric_depth, conf >= med AND sky < 0.3e0 AND md > 1e-2 AND depth > 1e-3 AS fit,
        round(CASE WHEN sky < 0.3e0 THEN depth ELSE 200 END, 6) AS filled_depth, round(CASE WHEN sky < 0.3e0 THEN conf ELSE 1 END, 6) AS filled_conf FROM m"""))
def depth_alignment_mask(spark, sf_dir):
    scaled = view(spark, sf_dir, "pixels").withColumn("metric_depth", ops.metric_scale(F.col("depth"), F.lit(FX), F.lit(FY)))
    out = ops.alignment_mask(scaled, ["frame_id"]).select("frame_id", "pixel", "metric_depth", "fit", "filled_depth", "filled_conf")
    return r(out, "metric_depth filled_depth filled_conf")


_STATS = "valid_depth_percentage mean_confidence median_confidence"


@query("depth_run_statistics", "G27 S13", with_views("pixels", f"""
    WITH g AS (SELECT seq_id, count(*) AS pixels, count(*) FILTER (depth > 0) AS valid_depth_pixels,
        100 * avg(CASE WHEN depth > 0 THEN 1.0e0 ELSE 0.0e0 END) AS valid_depth_percentage, avg(conf) AS mean_confidence,
        quantile_cont(conf, 0.5) AS median_confidence FROM pixels GROUP BY seq_id)
    SELECT seq_id, pixels, valid_depth_pixels, {q.rounded(_STATS)} FROM g"""))
def depth_run_statistics(spark, sf_dir):
    # frames as stored: one row per image with flattened arrays (64 values), then exploded again
    images = view(spark, sf_dir, "pixels").groupBy("seq_id", "frame_id").agg(
        F.array_sort(F.collect_list(F.struct("pixel", "depth", "conf"))).alias("_p")
    ).select("seq_id", "frame_id", F.lit(8).alias("w"), F.col("_p.depth").alias("depth"), F.col("_p.conf").alias("conf"))
    return r(ops.run_statistics(ops.explode_frames(images), ["seq_id"]), _STATS)


@query("frame_confidence_timeline", "G27", with_views("pixels", """
    WITH f AS (SELECT seq_id, frame_id, avg(conf) AS mean_confidence, 100 * avg(CASE WHEN depth > 0 THEN 1.0e0 ELSE 0.0e0 END) AS valid_percent
        FROM pixels GROUP BY seq_id, frame_id)
    SELECT seq_id, frame_id, round(mean_confidence, 6) AS mean_confidence, round(valid_percent, 6) AS valid_percent,
        round((frame_id - min(frame_id) OVER (PARTITION BY seq_id)) / 30.0e0, 6) AS time_s FROM f"""))
def frame_confidence_timeline(spark, sf_dir):
    pixels = view(spark, sf_dir, "pixels")
    first = pixels.groupBy("seq_id").agg(F.min("frame_id").alias("_first"))
    out = pixels.groupBy("seq_id", "frame_id").agg(
        F.avg("conf").alias("mean_confidence"), (100.0 * F.avg(F.when(F.col("depth") > 0, 1.0).otherwise(0.0))).alias("valid_percent")
    ).join(first, "seq_id").withColumn("time_s", (F.col("frame_id") - F.col("_first")) / 30.0).drop("_first")
    return r(out, "mean_confidence valid_percent time_s")


@query("adaptive_confidence", "G49", with_views("pixels", """
    WITH g AS (SELECT frame_id, count(*) FILTER (sky < 0.3e0) AS n, quantile_cont(conf, 0.1) FILTER (sky < 0.3e0) AS lo,
        quantile_cont(conf, 0.6) FILTER (sky < 0.3e0) AS hi, quantile_cont(depth, 0.98) FILTER (sky < 0.3e0) AS far, quantile_cont(conf, 0.4) AS p40 FROM pixels GROUP BY frame_id)
    SELECT frame_id, n AS non_sky_pixels, round(CASE WHEN n > 10 THEN least(greatest(1.05e0, lo), hi) ELSE 1.05e0 END, 6) AS threshold,
        round(far, 6) AS sky_depth, round(p40, 6) AS export_threshold FROM g"""))
def adaptive_confidence(spark, sf_dir):
    from ..scale import Quantile, grouped

    pixels = view(spark, sf_dir, "pixels")
    limits = ops.confidence_threshold(pixels, ["frame_id"], 1.05, 0.1, 0.6)
    far = grouped(pixels, ["frame_id"], [], [Quantile("sky_depth", F.when(F.col("sky") < 0.3, F.col("depth")), 0.98),
                                             Quantile("export_threshold", F.col("conf"), 0.4)])
    return r(limits.join(far, "frame_id"), "threshold sky_depth export_threshold")


@query("inverse_depth_shades", "G50", with_views("pixels", """
    WITH i AS (SELECT frame_id, pixel, CASE WHEN depth > 0 THEN 1 / depth END AS v FROM pixels),
    g AS (SELECT frame_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM i GROUP BY frame_id)
    SELECT frame_id, pixel, round(1 - least(greatest((coalesce(v, 0) - lo) / (hi - lo), 0), 1), 6) AS shade FROM i JOIN g USING (frame_id)"""))
def inverse_depth_shades(spark, sf_dir):
    out = ops.normalised_inverse_depth(view(spark, sf_dir, "pixels"), ["frame_id"]).select("frame_id", "pixel", "shade")
    return r(out, "shade")


_BUDGET = """
    ct AS (SELECT seq_id, frame_id, count(*) FILTER (depth > 0) AS valid FROM pixels GROUP BY seq_id, frame_id),
    sh AS (SELECT *, valid * (least(CAST(100 AS DOUBLE), sum(valid) OVER w) / sum(valid) OVER w) AS share, least(100, sum(valid) OVER w) AS budget FROM ct WINDOW w AS (PARTITION BY seq_id)),
    tk AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY floor(share) - share, frame_id) AS place, budget - sum(floor(share)) OVER (PARTITION BY seq_id) AS spare FROM sh),
    bg AS (SELECT seq_id, frame_id, valid, CAST(floor(share) AS BIGINT) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS take FROM tk)"""


@query("point_budget", "G25", with_views("pixels", f"WITH {_BUDGET} SELECT seq_id, frame_id, valid, take FROM bg"))
def point_budget(spark, sf_dir):
    counts = view(spark, sf_dir, "pixels").groupBy("seq_id", "frame_id").agg(F.count_if(F.col("depth") > 0).alias("valid"))
    return ops.point_budget(counts, "seq_id", "frame_id", 100)


@query("budgeted_pixels", "G25", with_views("pixels", f"""WITH {_BUDGET},
    rk AS (SELECT seq_id, frame_id, pixel, row_number() OVER (PARTITION BY frame_id ORDER BY pixel) - 1 AS i FROM pixels WHERE depth > 0),
    pk AS (SELECT DISTINCT frame_id, CAST(floor(j * ((valid - 1) / (take - 1))) AS BIGINT) AS i FROM (SELECT *, unnest(range(take)) AS j FROM bg WHERE take > 1))
    SELECT rk.seq_id, frame_id, pixel FROM rk JOIN pk USING (frame_id, i)"""))
def budgeted_pixels(spark, sf_dir):
    pixels = view(spark, sf_dir, "pixels")
    counts = pixels.groupBy("seq_id", "frame_id").agg(F.count_if(F.col("depth") > 0).alias("valid"))
    budget = ops.point_budget(counts, "seq_id", "frame_id", 100)
    return ops.stride_to_budget(pixels, budget, "seq_id", "frame_id").select("seq_id", "frame_id", "pixel")


def overlap_rows(spark, sf_dir):
    """Windows of four frames with two shared; each window sees depth at its own scale."""
    world = ops.world_points(posed_pixels(spark, sf_dir), FX, FY, CX, CY)
    i = F.col("frame_id") % 8
    first = F.greatest(F.lit(0), F.ceil((i - 3) / 2))
    last = F.least(F.floor(i / 2), F.lit(2))
    seen = world.withColumn("chunk", F.explode(F.sequence(first, last))).select(
        "seq_id", "frame_id", "pixel", "chunk", "conf", *[(F.col(c) * (1 + F.col("chunk") * 0.1)).alias(c) for c in ("x", "y", "z")]
    )
    return ops.overlap_pairs(seen, ["seq_id", "frame_id", "pixel"], 0.1)


@query("overlap_correspondences", "J6", with_views("pixels", f"""WITH {_WORLD},
    sn AS (SELECT seq_id, frame_id, pixel, conf, x, y, z, unnest(range(CAST(greatest(0, ceil((frame_id % 8 - 3) / 2)) AS BIGINT),
        CAST(least(floor(frame_id % 8 / 2), 2) AS BIGINT) + 1)) AS chunk FROM wp),
    md AS (SELECT seq_id, chunk, quantile_cont(conf, 0.5) AS m FROM sn GROUP BY seq_id, chunk),
    pr AS (SELECT a.seq_id, a.frame_id, a.pixel, a.chunk AS chunk_a, a.conf AS ca, b.conf AS cb, a.x * (1 + a.chunk * 0.1e0) AS xa, b.x * (1 + b.chunk * 0.1e0) AS xb
        FROM sn a JOIN sn b ON a.seq_id = b.seq_id AND a.frame_id = b.frame_id AND a.pixel = b.pixel AND b.chunk = a.chunk + 1
        JOIN md ma ON ma.seq_id = a.seq_id AND ma.chunk = a.chunk JOIN md mb ON mb.seq_id = b.seq_id AND mb.chunk = b.chunk
        WHERE a.conf > 0.1e0 * least(ma.m, mb.m) AND b.conf > 0.1e0 * least(ma.m, mb.m))
    SELECT seq_id, frame_id, pixel, chunk_a, round(xa, 5) AS x_a, round(xb, 5) AS x_b, round(sqrt(sqrt(ca) * sqrt(cb)), 6) AS weight FROM pr"""))
def overlap_correspondences(spark, sf_dir):
    out = overlap_rows(spark, sf_dir).select("seq_id", "frame_id", "pixel", "chunk_a", "x_a", "x_b", "weight")
    return r(r(out, "x_a x_b", 5), "weight")
