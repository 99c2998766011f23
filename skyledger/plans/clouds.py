"""Registered point-cloud queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors, scoring
from ..session import cut_lineage
from .registry import query
from .telemetry import r
from .views import view, with_views

# The clouds get sub-metre offsets, so that the two directions and the thresholds differ.
_CLOUD = """
    c AS (SELECT point_id, scan_id, cloud, x + (point_id % 7) / 50.0e0 AS x, y, z + (point_id % 3) / 100.0e0 AS z, conf FROM points)"""
# DuckDB answers with a windowed range join around each point and falls back to a full scan far out.
_NEAR = _CLOUD + """,
    u AS (SELECT DISTINCT scan_id, cloud, x, y, z FROM c),
    nn AS (SELECT a.scan_id, a.cloud, a.x, a.y, a.z, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2
        FROM u a JOIN u b ON a.scan_id = b.scan_id AND a.cloud <> b.cloud AND b.x BETWEEN a.x - 6 AND a.x + 6 GROUP BY ALL),
    far AS (SELECT a.scan_id, a.cloud, a.x, a.y, a.z, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2
        FROM (SELECT * FROM nn WHERE d2 > 36) a JOIN u b ON a.scan_id = b.scan_id AND a.cloud <> b.cloud GROUP BY ALL),
    dd AS (SELECT * FROM nn WHERE d2 <= 36 UNION ALL SELECT * FROM far),
    ds AS (SELECT c.point_id, c.scan_id, CASE c.cloud WHEN 'reconstruction' THEN 'forward' ELSE 'reverse' END AS direction,
        sqrt(d2) AS d FROM c JOIN dd USING (scan_id, cloud, x, y, z))
"""


def clouds(spark, sf_dir):
    k = F.col("point_id")
    return view(spark, sf_dir, "points").select(
        "point_id", "scan_id", "cloud", (F.col("x") + k % 7 / 50.0).alias("x"), "y", (F.col("z") + k % 3 / 100.0).alias("z"), "conf"
    )


@query("nearest_surface_distances", "J7", with_views("points", f"""WITH {_NEAR}
    SELECT scan_id, direction, count(*) AS samples, round(avg(d), 6) AS mean_m, round(sqrt(avg(d * d)), 6) AS rmse_m,
        round(max(d), 6) AS maximum_m, round(quantile_cont(d, 0.5), 6) AS median_m, round(quantile_cont(d, 0.95), 6) AS p95_m
    FROM ds GROUP BY scan_id, direction"""))
def nearest_surface_distances(spark, sf_dir):
    out = scoring.distance_summary(scoring.both_ways(clouds(spark, sf_dir), ["scan_id"]), ["scan_id", "direction"])
    return r(out, "mean_m rmse_m maximum_m median_m p95_m")


_T = "(VALUES (0.05e0), (0.1e0), (0.25e0), (0.5e0), (1.0e0)) t(threshold_m)"


@query("surface_f1", "G15", with_views("points", f"""WITH {_NEAR},
    s AS (SELECT scan_id, threshold_m, avg(CASE WHEN d <= threshold_m THEN 1.0e0 ELSE 0.0e0 END) FILTER (direction = 'forward') AS "precision",
        avg(CASE WHEN d <= threshold_m THEN 1.0e0 ELSE 0.0e0 END) FILTER (direction = 'reverse') AS recall FROM ds, {_T} GROUP BY scan_id, threshold_m)
    SELECT scan_id, threshold_m, round("precision", 6) AS "precision", round(recall, 6) AS recall,
        round(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END, 6) AS f1 FROM s"""))
def surface_f1(spark, sf_dir):
    out = scoring.threshold_scores(scoring.both_ways(clouds(spark, sf_dir), ["scan_id"]), ["scan_id"], [0.05, 0.1, 0.25, 0.5, 1.0])
    return r(out, "precision recall f1")


_VOX = """
    o AS (SELECT cloud, scan_id, min(x) - 1.0e0 AS ox, min(y) - 1.0e0 AS oy, min(z) - 1.0e0 AS oz FROM {src} GROUP BY cloud, scan_id),
    vx AS (SELECT s.cloud, s.scan_id, CAST(floor((x - ox) / 2.0e0) AS BIGINT) AS vx, CAST(floor((y - oy) / 2.0e0) AS BIGINT) AS vy,
        CAST(floor((z - oz) / 2.0e0) AS BIGINT) AS vz, sum(CAST(round_even(x * 1e9, 0) AS BIGINT)) / count(*) / 1e9 AS x,
        sum(CAST(round_even(y * 1e9, 0) AS BIGINT)) / count(*) / 1e9 AS y, sum(CAST(round_even(z * 1e9, 0) AS BIGINT)) / count(*) / 1e9 AS z, count(*) AS points
        FROM {src} s JOIN o USING (cloud, scan_id) GROUP BY ALL)"""


@query("voxel_downsample", "G17", with_views("points", f"""WITH {_CLOUD}, {_VOX.format(src='c')}
    SELECT cloud, scan_id, vx, vy, vz, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, points FROM vx"""))
def voxel_downsample(spark, sf_dir):
    return r(scoring.voxel_means(clouds(spark, sf_dir), ["cloud", "scan_id"], 2.0), "x y z")


@query("reconstruction_score", "G16 G17 P17", with_views("points", f"""WITH {_CLOUD},
    bb AS (SELECT scan_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM c WHERE cloud = 'reference' GROUP BY scan_id),
    fp AS (SELECT * REPLACE (z + 60 AS z) FROM c WHERE cloud = 'reference' AND point_id % 100 = 11),
    cr AS (SELECT * FROM fp UNION ALL SELECT c.* FROM c JOIN bb USING (scan_id) WHERE cloud = 'reference' OR (x BETWEEN x0 - 0.1e0 AND x1 + 0.1e0 AND y BETWEEN y0 - 0.1e0 AND y1 + 0.1e0
        AND z BETWEEN z0 - 0.1e0 AND z1 + 0.1e0)), {_VOX.format(src='cr')},
    d2 AS (SELECT a.scan_id, a.cloud, a.vx, a.vy, a.vz, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2
        FROM vx a JOIN vx b ON a.scan_id = b.scan_id AND a.cloud <> b.cloud GROUP BY ALL),
    s AS (SELECT scan_id, avg(sqrt(d2)) FILTER (cloud = 'reconstruction' AND sqrt(d2) < 20) AS accuracy, avg(sqrt(d2)) FILTER (cloud = 'reference' AND sqrt(d2) < 20) AS completeness,
        avg(CASE WHEN sqrt(d2) < 1.0e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (cloud = 'reconstruction') AS "precision",
        avg(CASE WHEN sqrt(d2) < 1.0e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (cloud = 'reference') AS recall FROM d2 GROUP BY scan_id)
    SELECT scan_id, round(accuracy, 6) AS accuracy, round(completeness, 6) AS completeness, round((accuracy + completeness) / 2, 6) AS overall,
        round("precision", 6) AS "precision", round(recall, 6) AS recall, round(2 * "precision" * recall / ("precision" + recall), 6) AS fscore FROM s"""))
def reconstruction_score(spark, sf_dir):
    points = clouds(spark, sf_dir)
    reference = points.filter("cloud = 'reference'")
    cropped = scoring.crop_to_box(points.filter("cloud = 'reconstruction'"), reference, ["scan_id"], 0.1).unionByName(reference)
    far = reference.filter("point_id % 100 = 11").withColumn("z", F.col("z") + 60)  # copies beyond the distance limit
    # read more than once below, where its coordinates are keys
    thin = cut_lineage(scoring.voxel_means(cropped.unionByName(far), ["cloud", "scan_id"], 2.0))
    out = scoring.reconstruction_score(scoring.both_ways(thin, ["scan_id"]), ["scan_id"], 1.0, cap=20.0)
    return r(out, "accuracy completeness overall precision recall fscore")


# Thirteen least squares per distinct place, the place itself among them: grid cells around it, or all points where they are too few.
@query("neighbour_outliers", "J8 G22", with_views("points", f"""WITH {_CLOUD},
    u AS (SELECT DISTINCT scan_id, x, y, z, CAST(floor(x / 8) AS BIGINT) AS cx, CAST(floor(y / 8) AS BIGINT) AS cy FROM c),
    t AS (SELECT scan_id, x AS tx, y AS ty, z AS tz, CAST(floor(x / 8) AS BIGINT) + i AS cx, CAST(floor(y / 8) AS BIGINT) + j AS cy
        FROM c, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
    nn AS (SELECT scan_id, x, y, z, min((tx - x) * (tx - x) + (ty - y) * (ty - y) + (tz - z) * (tz - z), 13) AS l
        FROM u JOIN t USING (scan_id, cx, cy) GROUP BY ALL),
    far AS (SELECT a.scan_id, a.x, a.y, a.z, min((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z), 13) AS l
        FROM nn a JOIN c b USING (scan_id) WHERE len(a.l) < 13 OR a.l[13] > 64 GROUP BY ALL),
    ls AS (SELECT * FROM nn WHERE len(l) = 13 AND l[13] <= 64 UNION ALL SELECT * FROM far),
    m AS (SELECT c.scan_id, point_id, c.x, c.y, c.z, CASE WHEN len(l) > 1 THEN list_sum(list_transform(l, lambda e: sqrt(e))) / (len(l) - 1) END AS mean_distance
        FROM c JOIN ls USING (scan_id, x, y, z)),
    q AS (SELECT scan_id, count(*) AS n, quantile_cont(mean_distance, 0.5) AS med, quantile_cont(mean_distance, 0.995) AS far FROM m GROUP BY scan_id),
    s AS (SELECT scan_id, any_value(n) AS n, any_value(med) AS med, any_value(far) AS far, 1.4826e0 * quantile_cont(abs(mean_distance - med), 0.5) AS sigma
        FROM m JOIN q USING (scan_id) GROUP BY scan_id),
    li AS (SELECT *, CASE WHEN sigma <= 2.220446049250313e-16 THEN far ELSE med + 4.0e0 * sigma END AS lim FROM s),
    k AS (SELECT scan_id, any_value(n) AS n, any_value(far) AS far, any_value(lim) AS lim, count(*) FILTER (mean_distance <= lim) AS kept
        FROM m JOIN li USING (scan_id) GROUP BY scan_id),
    fl AS (SELECT scan_id, CASE WHEN n < 32 THEN NULL WHEN kept < greatest(32, floor(0.5e0 * n)) THEN far ELSE lim END AS limit_m FROM k)
    SELECT scan_id, point_id, x, y, z, round(mean_distance, 6) AS mean_distance, round(limit_m, 6) AS limit_m, limit_m IS NULL OR mean_distance <= limit_m AS keep
    FROM m JOIN fl USING (scan_id)"""))
def neighbour_outliers(spark, sf_dir):
    # the cloud and the confidence are not asked, so they do not travel
    out = scoring.outlier_limits(clouds(spark, sf_dir).drop("cloud", "conf"), ["scan_id"])
    return r(out.select("scan_id", "point_id", "x", "y", "z", "mean_distance", "limit_m", "keep"), "mean_distance limit_m")


@query("confident_points", "P16", with_views("points", """
    WITH t AS (SELECT scan_id, 0.75e0 * avg(conf) AS lv FROM points GROUP BY scan_id)
    SELECT scan_id, cloud, count(*) AS kept FROM points JOIN t USING (scan_id) WHERE conf >= lv AND conf > 1e-5 GROUP BY scan_id, cloud"""))
def confident_points(spark, sf_dir):
    kept = scoring.confident(view(spark, sf_dir, "points"), ["scan_id"], 0.75)
    return kept.groupBy("scan_id", "cloud").agg(F.count(F.lit(1)).alias("kept"))


@query("masked_points", "P17", with_views("points", """
    WITH m AS (SELECT DISTINCT scan_id, CAST(round_even((x - 10) / 2.5e0, 0) AS BIGINT) AS vx, CAST(round_even((y - 10) / 2.5e0, 0) AS BIGINT) AS vy,
        CAST(round_even((z - 1) / 2.5e0, 0) AS BIGINT) AS vz FROM points WHERE cloud = 'reference' AND x >= 10 AND x < 90 AND y >= 10 AND y < 90 AND z >= 1 AND z < 4)
    SELECT point_id, scan_id, x, y, z FROM points p WHERE cloud = 'reconstruction' AND x >= 8 AND x < 94 AND y >= 8 AND y < 94 AND z >= -1 AND z < 8
        AND 0.1e0 * x - 0.2e0 * y + z + 4 > 0
        AND EXISTS (SELECT 1 FROM m WHERE m.scan_id = p.scan_id AND m.vx = CAST(round_even((x - 10) / 2.5e0, 0) AS BIGINT)
            AND m.vy = CAST(round_even((y - 10) / 2.5e0, 0) AS BIGINT) AND m.vz = CAST(round_even((z - 1) / 2.5e0, 0) AS BIGINT))"""))
def masked_points(spark, sf_dir):
    points = view(spark, sf_dir, "points")
    low, high, cell = (10.0, 10.0, 1.0), (90.0, 90.0, 4.0), 2.5
    seen = points.filter("cloud = 'reference' and x >= 10 and x < 90 and y >= 10 and y < 90 and z >= 1 and z < 4").select(
        "scan_id", *[F.rint((F.col(d) - lo) / cell).cast("bigint").alias(f"v{d}") for d, lo in zip("xyz", low)]
    ).distinct()
    rec = points.filter("cloud = 'reconstruction'").filter(scoring.above_plane((0.1, -0.2, 1.0, 4.0)))
    return scoring.crop_to_mask(rec, seen, ["scan_id"], low, high, cell, 2.0).select("point_id", "scan_id", "x", "y", "z")


@query("radius_thinning", "J9")
def radius_thinning(spark, sf_dir):
    # point ids repeat in the derived cloud, so a distinct coordinate is its own id
    points = clouds(spark, sf_dir).select("scan_id", "x", "y", "z").distinct().withColumn("place", F.concat_ws(",", "x", "y", "z"))
    return neighbors.thin_by_radius(points, ["scan_id"], "place", 3.0)
