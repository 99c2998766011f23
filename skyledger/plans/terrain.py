"""Registered raster and measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import terrain as ops
from . import sqltext as q
from .registry import query
from .telemetry import r
from .views import source, view, with_views

RES = 1.0
_CELLS = """
    cells AS (SELECT scan_id, CAST(floor(x) AS BIGINT) AS col, CAST(floor(y) AS BIGINT) AS "row", max(z) AS z, count(*) AS n FROM points GROUP BY ALL)"""
_EDGES = """
    ed AS (SELECT outline_id, scan_id, i, x AS ax, y AS ay, z AS az, coalesce(lead(x) OVER w, first(x) OVER w) AS bx,
        coalesce(lead(y) OVER w, first(y) OVER w) AS "by", coalesce(lead(z) OVER w, first(z) OVER w) AS bz
        FROM corners WINDOW w AS (PARTITION BY outline_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
_INSIDE = _EDGES + """,
    ex AS (SELECT scan_id, min(col) AS cl, max(col) AS ch, min("row") AS rl, max("row") AS rh FROM cells GROUP BY scan_id),
    bx AS (SELECT outline_id, scan_id, greatest(any_value(cl), CAST(floor(min(x)) AS BIGINT)) AS c0, least(any_value(ch), CAST(floor(max(x)) AS BIGINT)) AS c1,
        greatest(any_value(rl), CAST(floor(min(y)) AS BIGINT)) AS r0, least(any_value(rh), CAST(floor(max(y)) AS BIGINT)) AS r1 FROM corners JOIN ex USING (scan_id) GROUP BY outline_id, scan_id),
    gr AS (SELECT outline_id, scan_id, col, unnest(range(r0, r1 + 1)) AS "row" FROM (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM bx)),
    ins AS (SELECT g.outline_id, g.scan_id, g.col, g."row", g.col + 0.5e0 AS cx, g."row" + 0.5e0 AS cy FROM gr g JOIN ed e USING (outline_id)
        WHERE (ay > g."row" + 0.5e0) <> ("by" > g."row" + 0.5e0) AND g.col + 0.5e0 < (bx - ax) * (g."row" + 0.5e0 - ay) / ("by" - ay) + ax
        GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _field(spark, sf_dir):
    return ops.height_field(view(spark, sf_dir, "points"), ["scan_id"], RES)


def _outlines(spark, sf_dir):
    return ops.rings(view(spark, sf_dir, "corners"), ["outline_id", "scan_id"])


_DSM = """
    gb AS (SELECT scan_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points GROUP BY scan_id),
    gd AS (SELECT *, CAST(greatest(1, ceil((x1 - x0) / 1.5e0) + 1) AS BIGINT) AS width, CAST(greatest(1, ceil((y1 - y0) / 1.5e0) + 1) AS BIGINT) AS height FROM gb),
    dsm AS (SELECT p.scan_id, CAST(least(floor((x - x0) / 1.5e0), width - 1) AS BIGINT) AS col, CAST(least(floor((y1 - y) / 1.5e0), height - 1) AS BIGINT) AS "row",
        CAST(max(CAST(z AS FLOAT)) AS DOUBLE) AS z, count(*) AS n FROM points p JOIN gd USING (scan_id) WHERE conf > 1.02e0 GROUP BY ALL)"""


def _dsm(spark, sf_dir):
    points = view(spark, sf_dir, "points")
    grids = ops.surface(points, ["scan_id"], 1.5)[1]
    # only confident points make the surface, on the whole cloud's grid
    col = F.least(F.floor((F.col("x") - F.col("x_min")) / 1.5), F.col("width") - 1)
    row = F.least(F.floor((F.col("y_max") - F.col("y")) / 1.5), F.col("height") - 1)
    cells = points.filter("conf > 1.02e0").join(grids, "scan_id").groupBy("scan_id", col.alias("col"), row.alias("row")).agg(
        F.max(F.col("z").cast("float")).cast("double").alias("z"), F.count(F.lit(1)).alias("n")
    )
    return cells, grids


@query("surface_raster", "G18", with_views("points", f"WITH {_DSM.replace(' WHERE conf > 1.02e0', '')} SELECT scan_id, col, \"row\", round(z, 5) AS z, n FROM dsm"))
def surface_raster(spark, sf_dir):
    return r(ops.surface(view(spark, sf_dir, "points"), ["scan_id"], 1.5)[0], "z", 5)


@query("surface_raster_summary", "G18", with_views("points", f"""WITH {_DSM.replace(' WHERE conf > 1.02e0', '')}
    SELECT gd.scan_id, width, height, count(*) AS valid_cells, round(count(*) / (width * height), 6) AS valid_fraction
    FROM gd JOIN dsm USING (scan_id) GROUP BY gd.scan_id, width, height"""))
def surface_raster_summary(spark, sf_dir):
    cells, grids = ops.surface(view(spark, sf_dir, "points"), ["scan_id"], 1.5)
    counts = cells.groupBy("scan_id").agg(F.count(F.lit(1)).alias("valid_cells"))
    out = grids.join(counts, "scan_id").select(
        "scan_id", "width", "height", "valid_cells", (F.col("valid_cells") / (F.col("width") * F.col("height"))).alias("valid_fraction")
    )
    return r(out, "valid_fraction")


@query("density_confidence", "G19", with_views("points", f"""WITH {_CELLS},
    p AS (SELECT scan_id, quantile_cont(n, 0.95) AS d FROM cells GROUP BY scan_id),
    c AS (SELECT scan_id, d, least(greatest(ln(1 + n) / greatest(ln(1 + d), 1e-6), 0), 1) AS conf FROM cells JOIN p USING (scan_id))
    SELECT scan_id, count(*) AS occupied_cells, round(avg(conf), 6) AS mean_confidence,
        round(avg(CASE WHEN conf >= 0.65e0 THEN 1.0e0 ELSE 0.0e0 END), 6) AS high_fraction, round(any_value(d), 6) AS density_p95 FROM c GROUP BY scan_id"""))
def density_confidence(spark, sf_dir):
    level = F.col("confidence")
    out = ops.density_confidence(_field(spark, sf_dir), ["scan_id"]).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("occupied_cells"), F.avg(level).alias("mean_confidence"),
        F.avg(F.when(level >= 0.65, 1.0).otherwise(0.0)).alias("high_fraction"), F.first("density_p95").alias("density_p95"),
    )
    return r(out, "mean_confidence high_fraction density_p95")


def _fill_sql(measure, least, edge):
    near = """SELECT f.scan_id, f.col + d.dc AS col, f."row" + e.dr AS "row", z FROM {src} f, (VALUES (-1), (0), (1)) d(dc), (VALUES (-1), (0), (1)) e(dr) WHERE dc <> 0 OR dr <> 0"""
    parts, src = [], "base"
    for i in (1, 2):
        parts.append(f"""f{i} AS (SELECT scan_id, col, "row", z FROM {src} UNION ALL SELECT m.scan_id, m.col, m."row", v FROM (
            SELECT scan_id, col, "row", {measure} AS v FROM ({near.format(src=src)}) GROUP BY ALL HAVING count(*) >= {least}) m JOIN gd USING (scan_id)
            WHERE m.col BETWEEN {edge} AND width - 1 - {edge} AND m."row" BETWEEN {edge} AND height - 1 - {edge}
            AND NOT EXISTS (SELECT 1 FROM {src} s WHERE s.scan_id = m.scan_id AND s.col = m.col AND s."row" = m."row"))""")
        src = f"f{i}"
    return 'base AS (SELECT scan_id, col, "row", z FROM dsm), ' + ", ".join(parts)


@query("median_hole_fill", "G20", with_views("points", f"""WITH {_DSM}, {_fill_sql('quantile_cont(z, 0.5)', 4, 0)}
    SELECT scan_id, col, "row", round(z, 5) AS z FROM f2"""))
def median_hole_fill(spark, sf_dir):
    cells, grids = _dsm(spark, sf_dir)
    return r(ops.fill_holes(cells, grids, ["scan_id"]), "z", 5)


@query("mean_hole_fill", "G20", with_views("points", f"""WITH {_DSM}, {_fill_sql('avg(z)', 5, 1)}
    SELECT scan_id, col, "row", round(z, 5) AS z FROM f2"""))
def mean_hole_fill(spark, sf_dir):
    cells, grids = _dsm(spark, sf_dir)
    return r(ops.fill_holes(cells, grids, ["scan_id"], least=5, mean=True), "z", 5)


@query("closed_coarse_cells", "G21", with_views("points", """
    WITH co AS (SELECT DISTINCT scan_id, CAST(floor(x / 5) AS BIGINT) AS col, CAST(floor(y / 5) AS BIGINT) AS "row" FROM points WHERE z > 2.0e0 AND x + y < 150 AND NOT (x BETWEEN 30 AND 50 AND y BETWEEN 30 AND 45)),
    cr AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) t(dc, dr)),
    di AS (SELECT DISTINCT scan_id, col + dc AS col, "row" + dr AS "row" FROM co, cr)
    SELECT scan_id, col - dc AS col, "row" - dr AS "row" FROM di, cr GROUP BY ALL HAVING count(*) = 5"""))
def closed_coarse_cells(spark, sf_dir):
    return ops.erode(ops.dilate(_lshape(spark, sf_dir), ["scan_id"], ops.CROSS), ["scan_id"], ops.CROSS)


def _lshape(spark, sf_dir):
    points = view(spark, sf_dir, "points").filter("z > 2.0e0 and x + y < 150 and not (x between 30 and 50 and y between 30 and 45)")
    return ops.coarse_cells(ops.height_field(points, ["scan_id"], 1.0), ["scan_id"], 5)


@query("footprint_coverage", "G21")
def footprint_coverage(spark, sf_dir):
    points = view(spark, sf_dir, "points").filter("z > 2.0e0 and x + y < 150 and not (x between 30 and 50 and y between 30 and 45)")
    return r(ops.footprint_coverage(ops.height_field(points, ["scan_id"], 1.0), ["scan_id"], 1.0, 5.0, 10.0), "fraction")


@query("outline_measures", "P18 P19", with_views("corners", f"""WITH {_EDGES},
    a AS (SELECT outline_id, abs(sum(ax * "by" - bx * ay)) / 2 AS area, sum(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay))) AS perimeter,
        sum(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay))) FILTER (i < 4) AS ground_length,
        sum(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) + (bz - az) * (bz - az))) FILTER (i < 4) AS length_3d FROM ed GROUP BY outline_id),
    s AS (SELECT outline_id, 4.0e0 AS dz, 4 AS segments, any_value(c.x) FILTER (i = 0) AS x0, any_value(c.y) FILTER (i = 0) AS y0, any_value(c.x) FILTER (i = 4) AS x4,
        any_value(c.y) FILTER (i = 4) AS y4 FROM corners c GROUP BY outline_id)
    SELECT outline_id, {q.rounded('area perimeter ground_length length_3d', 5)}, segments, round(dz, 5) AS height_change,
        round(sqrt((x4 - x0) * (x4 - x0) + (y4 - y0) * (y4 - y0)), 5) AS horizontal_offset,
        round(sqrt((x4 - x0) * (x4 - x0) + (y4 - y0) * (y4 - y0) + dz * dz), 5) AS straight_line,
        printf('%.2f m', sqrt((x4 - x0) * (x4 - x0) + (y4 - y0) * (y4 - y0) + dz * dz)) AS straight_text FROM a JOIN s USING (outline_id)"""))
def outline_measures(spark, sf_dir):
    a, b = F.element_at("ring", 1), F.element_at("ring", -1)
    out = _outlines(spark, sf_dir).select(
        "outline_id", ops.ring_area().alias("area"), ops.ring_perimeter().alias("perimeter"), ops.path_length().alias("ground_length"),
        ops.path_length(horizontal=False).alias("length_3d"), (F.size("ring") - 1).alias("segments"), (b["z"] - a["z"]).alias("height_change"),
        ops._flat(a, b).alias("horizontal_offset"), ops._solid(a, b).alias("straight_line"), text.length(ops._solid(a, b)).alias("straight_text"),
    )
    return r(out, "area perimeter ground_length length_3d height_change horizontal_offset straight_line", 5)


@query("area_statistics", "G43 P18", with_views("points corners", f"""WITH {_CELLS}, {_INSIDE},
    g AS (SELECT c.*, e.z AS ze, w.z AS zw, n.z AS zn, s.z AS zs FROM cells c LEFT JOIN cells e ON e.scan_id = c.scan_id AND e.col = c.col + 1 AND e."row" = c."row"
        LEFT JOIN cells w ON w.scan_id = c.scan_id AND w.col = c.col - 1 AND w."row" = c."row" LEFT JOIN cells n ON n.scan_id = c.scan_id AND n.col = c.col AND n."row" = c."row" + 1
        LEFT JOIN cells s ON s.scan_id = c.scan_id AND s.col = c.col AND s."row" = c."row" - 1),
    gg AS (SELECT *, CASE WHEN zw IS NOT NULL AND ze IS NOT NULL THEN (ze - zw) / 2 WHEN ze IS NOT NULL THEN ze - z WHEN zw IS NOT NULL THEN z - zw ELSE 0 END AS gx,
        CASE WHEN zs IS NOT NULL AND zn IS NOT NULL THEN (zn - zs) / 2 WHEN zn IS NOT NULL THEN zn - z WHEN zs IS NOT NULL THEN z - zs ELSE 0 END AS gy FROM g),
    a AS (SELECT outline_id, count(*) AS total, count(z) AS valid, sum(CASE WHEN z IS NOT NULL THEN sqrt(1 + gx * gx + gy * gy) END) AS s, min(z) AS z_min, max(z) AS z_max, avg(z) AS z_mean
        FROM ins LEFT JOIN gg USING (scan_id, col, "row") GROUP BY outline_id),
    p AS (SELECT outline_id, abs(sum(ax * "by" - bx * ay)) / 2 AS planar, sum(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay))) AS perimeter FROM ed GROUP BY outline_id)
    SELECT outline_id, {q.rounded('planar perimeter', 5)}, round(s * total / valid, 5) AS surface, {q.rounded('z_min z_max z_mean', 9)},
        round(coalesce(valid / total, 0), 6) AS coverage FROM p LEFT JOIN a USING (outline_id)"""))
def area_statistics(spark, sf_dir):
    out = ops.area_statistics(_outlines(spark, sf_dir), _field(spark, sf_dir), ["scan_id"], "outline_id", RES)
    return r(r(r(out, "planar perimeter surface", 5), "z_min z_max z_mean", 9), "coverage")


def _sampled(src, keys):
    """Bilinear heights of the rows of ``src`` (x, y) as checking SQL."""
    return f"""
    bl AS (SELECT *, CAST(floor(x - 0.5e0) AS BIGINT) AS c0, CAST(floor(y - 0.5e0) AS BIGINT) AS r0, x - 0.5e0 - floor(x - 0.5e0) AS fx, y - 0.5e0 - floor(y - 0.5e0) AS fy FROM {src}),
    hs AS (SELECT {keys}, sum(w * z) / sum(w) AS h FROM (SELECT bl.*, cells.z AS z, (CASE i WHEN 1 THEN fx ELSE 1 - fx END) * (CASE j WHEN 1 THEN fy ELSE 1 - fy END) AS w
        FROM bl, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j), cells WHERE cells.scan_id = bl.scan_id AND cells.col = c0 + i AND cells."row" = r0 + j)
        GROUP BY {keys} HAVING sum(w) > 1e-6)"""


@query("bilinear_heights", "G45", with_views("points corners", f"""WITH {_CELLS}, pl AS (SELECT outline_id, scan_id, i AS k, x, y FROM corners),
    {_sampled('pl', 'outline_id, k').replace('a(i), (VALUES', 'a(i), (VALUES')}
    SELECT pl.outline_id, pl.k, round(h, 6) AS h FROM pl LEFT JOIN hs USING (outline_id, k)"""))
def bilinear_heights(spark, sf_dir):
    places = view(spark, sf_dir, "corners").select("outline_id", "scan_id", F.col("i").alias("k"), "x", "y")
    return r(ops.sample(places, _field(spark, sf_dir), ["scan_id"], ["outline_id", "k"], RES).select("outline_id", "k", "h"), "h")


_CUT_FILL = with_views("points corners", f"""WITH {_CELLS}, {_INSIDE},
    ns AS (SELECT *, greatest(1, CAST(ceil(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay))) AS BIGINT)) AS nn FROM ed),
    bs AS (SELECT outline_id, scan_id, i AS leg, k, ax + (bx - ax) * (k / nn) AS x, ay + ("by" - ay) * (k / nn) AS y FROM (SELECT *, unnest(range(nn)) AS k FROM ns)),
    {_sampled('bs', 'outline_id, leg, k, x, y')},
    mm AS (SELECT outline_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(h) AS mz, min(h) AS lowest FROM hs GROUP BY outline_id),
    mo AS (SELECT outline_id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy,
        sum((y - my) * (y - my)) AS yy, sum((x - mx) * (h - mz)) AS xz, sum((y - my) * (h - mz)) AS yz FROM hs JOIN mm USING (outline_id) GROUP BY outline_id),
    pn AS (SELECT *, CASE WHEN n < 3 OR abs(xx * yy - xy * xy) < 1e-9 THEN 0 ELSE (xz * yy - yz * xy) / (xx * yy - xy * xy) END AS a,
        CASE WHEN n < 3 OR abs(xx * yy - xy * xy) < 1e-9 THEN 0 ELSE (yz * xx - xz * xy) / (xx * yy - xy * xy) END AS b FROM mo),
    dd AS (SELECT ins.outline_id, z, z - (coalesce(a, 0) * cx + coalesce(b, 0) * cy + coalesce(mz - a * mx - b * my, 0)) AS d, pn.n AS n FROM ins LEFT JOIN cells USING (scan_id, col, "row")
        LEFT JOIN pn USING (outline_id))
    SELECT outline_id, round(coalesce(sum(d) FILTER (d > 0), 0), 4) AS fill, round(coalesce(sum(-d) FILTER (d <= 0), 0), 4) AS cut,
        round(coalesce(sum(d) FILTER (d > 0), 0) - coalesce(sum(-d) FILTER (d <= 0), 0), 4) AS net, round(count(z) / count(*), 6) AS coverage, max(n) AS edge_samples
    FROM dd GROUP BY outline_id""")


@query("cut_and_fill", "G44", _CUT_FILL)
def cut_and_fill(spark, sf_dir):
    out = ops.cut_fill(_outlines(spark, sf_dir), _field(spark, sf_dir), ["scan_id"], "outline_id", RES)
    return r(r(out, "fill cut net", 4), "coverage")


_PLANE = "z - (coalesce(a, 0) * cx + coalesce(b, 0) * cy + coalesce(mz - a * mx - b * my, 0)) AS d"
_LOWEST = _CUT_FILL.replace(_PLANE, "z - coalesce(lowest, 0) AS d").replace("any_value(mz) AS mz,", "any_value(mz) AS mz, any_value(lowest) AS lowest,")


@query("cut_and_fill_lowest", "G44", _LOWEST)
def cut_and_fill_lowest(spark, sf_dir):
    out = ops.cut_fill(_outlines(spark, sf_dir), _field(spark, sf_dir), ["scan_id"], "outline_id", RES, base="lowest")
    return r(r(out, "fill cut net", 4), "coverage")


_PROFILE = f"""{_CELLS}, {_EDGES},
    lg AS (SELECT outline_id, scan_id, i AS leg, ax, ay, bx, "by", sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS len FROM ed WHERE i < 4),
    tl AS (SELECT *, sum(len) OVER (PARTITION BY outline_id) AS total, coalesce(sum(len) OVER (PARTITION BY outline_id ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS acc FROM lg),
    st AS (SELECT *, greatest(1, CAST(ceil(len / greatest(1.0e0, total / 2000)) AS BIGINT)) AS nn FROM tl),
    ps AS (SELECT outline_id, scan_id, leg, k, acc + len * (k / nn) AS d, ax + (bx - ax) * (k / nn) AS x, ay + ("by" - ay) * (k / nn) AS y
        FROM (SELECT *, unnest(range(nn + CASE WHEN leg = 3 THEN 1 ELSE 0 END)) AS k FROM st)),
    {_sampled('ps', 'outline_id, leg, k, d')},
    sl AS (SELECT a.outline_id, a.d, a.h, min((b.d, b.leg, b.k, b.h)) AS hit FROM hs a JOIN hs b ON b.outline_id = a.outline_id AND b.d >= a.d + 5 GROUP BY a.outline_id, a.leg, a.k, a.d, a.h),
    mx AS (SELECT outline_id, max(abs(hit[4] - h) / (hit[1] - d)) AS steepest FROM sl GROUP BY outline_id),
    mv AS (SELECT *, h - lag(h) OVER w AS dz, d - lag(d) OVER w AS dd FROM hs WINDOW w AS (PARTITION BY outline_id ORDER BY d, leg, k)),
    fg AS (SELECT outline_id, min(h) AS z_min, max(h) AS z_max, coalesce(sum(dz) FILTER (dz > 0), 0) AS gain, coalesce(sum(-dz) FILTER (dz <= 0), 0) AS loss,
        coalesce(sum(sqrt(dz * dz + dd * dd)), 0) AS surface_length, arg_min(h, (d, leg, k)) AS h0, arg_max(h, (d, leg, k)) AS h1, min(d) AS d0, max(d) AS d1, count(*) AS nv FROM mv GROUP BY outline_id),
    ln AS (SELECT outline_id, sum(len) AS length FROM lg GROUP BY outline_id), ct AS (SELECT outline_id, count(*) AS n FROM ps GROUP BY outline_id)"""


@query("elevation_profiles", "G46", with_views("points corners", f"""WITH {_PROFILE}
    SELECT outline_id, round(length, 5) AS length, {q.rounded('z_min z_max', 5)}, round(coalesce(gain, 0), 4) AS gain, round(coalesce(loss, 0), 4) AS loss,
        round(coalesce(surface_length, 0), 4) AS surface_length, round(CASE WHEN d1 > d0 THEN (h1 - h0) / (d1 - d0) END, 5) AS average_grade, round(coalesce(steepest, 0), 5) AS steepest,
        round(coalesce(nv, 0) / n, 6) AS coverage FROM ln JOIN ct USING (outline_id) LEFT JOIN fg USING (outline_id) LEFT JOIN mx USING (outline_id)"""))
def elevation_profiles(spark, sf_dir):
    out = ops.profiles(_outlines(spark, sf_dir), _field(spark, sf_dir), ["scan_id"], "outline_id", RES)
    return r(r(r(out, "length z_min z_max average_grade steepest", 5), "gain loss surface_length", 4), "coverage")


@query("sight_lines", "G47", with_views("points corners", f"""WITH {_CELLS},
    pr AS (SELECT a.outline_id, a.scan_id, a.x AS ax, a.y AS ay, 4.6e0 AS az, b.x AS bx, b.y AS "by", 4.9e0 AS bz FROM corners a JOIN corners b USING (outline_id) WHERE a.i = 0 AND b.i = 2),
    le AS (SELECT *, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay) + (bz - az) * (bz - az)) AS len FROM pr),
    sp AS (SELECT *, greatest(0.5e0, len / 4000) AS step, least(2.0e0, len * 0.05e0) AS skip FROM le),
    kk AS (SELECT *, skip + k * step AS t FROM (SELECT *, unnest(range(CAST(ceil((len - 2 * skip) / step) AS BIGINT) + 1)) AS k FROM sp)),
    ls AS (SELECT outline_id, scan_id, k, t, ax + (bx - ax) * (t / len) AS x, ay + ("by" - ay) * (t / len) AS y, az + (bz - az) * (t / len) AS line FROM kk WHERE t < len - skip),
    {_sampled('ls', 'outline_id, k')},
    hv AS (SELECT ls.*, h FROM ls LEFT JOIN hs USING (outline_id, k)),
    ht AS (SELECT outline_id, min(k) AS hk, arg_min(t, k) AS ht, arg_min(h, k) AS hh FROM hv WHERE h > line + 0.15e0 GROUP BY outline_id),
    un AS (SELECT hv.outline_id, count(*) FILTER (h IS NULL) / count(*) AS u FROM hv LEFT JOIN ht USING (outline_id) WHERE hk IS NULL OR k <= hk GROUP BY hv.outline_id)
    SELECT outline_id, round(len, 5) AS distance, round(degrees(atan2(bz - az, sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))), 5) AS look_angle, hk IS NULL AS visible,
        round(ht, 5) AS blocked_at, round(hh, 5) AS obstruction_z, round(coalesce(u, 0), 6) AS unknown FROM le LEFT JOIN ht USING (outline_id) LEFT JOIN un USING (outline_id)"""))
def sight_lines(spark, sf_dir):
    ends = view(spark, sf_dir, "corners")
    a = ends.filter("i = 0").select("outline_id", "scan_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(4.6).alias("az"))
    b = ends.filter("i = 2").select("outline_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(4.9).alias("bz"))
    out = ops.sight_lines(a.join(b, "outline_id"), _field(spark, sf_dir), ["scan_id"], "outline_id", RES)
    return r(r(out, "distance look_angle blocked_at obstruction_z", 5), "unknown")


@query("scene_scale", "G48", with_views("points", """
    WITH c AS (SELECT scan_id, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS dx, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS dy,
        quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS dz, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM points GROUP BY scan_id)
    SELECT scan_id, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS scale_m, round(mx, 6) AS centre_x, round(my, 6) AS centre_y, round(mz, 6) AS centre_z FROM c"""))
def scene_scale(spark, sf_dir):
    from ..scale import Quantile, grouped

    wanted = [Quantile(f"{d}{int(p * 100)}", F.col(d), p) for d in "xyz" for p in (0.05, 0.5, 0.95)]
    out = grouped(view(spark, sf_dir, "points"), ["scan_id"], [], wanted)
    d = [F.col(f"{c}95") - F.col(f"{c}5") for c in "xyz"]
    return r(out.select("scan_id", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("scale_m"),
                        *[F.col(f"{c}50").alias(f"centre_{c}") for c in "xyz"]), "scale_m centre_x centre_y centre_z")


@query("height_colour_range", "G48", with_views("points", f"""WITH {_CELLS},
    k AS (SELECT scan_id, z, row_number() OVER (PARTITION BY scan_id ORDER BY z, col, "row") - 1 AS i, count(*) OVER (PARTITION BY scan_id) AS n FROM cells)
    SELECT scan_id, max(z) FILTER (i = floor(0.02e0 * (n - 1))) AS low, max(z) FILTER (i = floor(0.98e0 * (n - 1))) AS high FROM k GROUP BY scan_id"""))
def height_colour_range(spark, sf_dir):
    from ..scale import ordered, rank

    cells = _field(spark, sf_dir)
    sizes = cells.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered(cells, ["scan_id"], ["z", "col", "row"], {"_r": rank()}).join(sizes, "scan_id")

    def pick(p: float):
        return F.max(F.when(F.col("_r") - 1 == F.floor(p * (F.col("_n") - 1)), F.col("z")))

    return placed.groupBy("scan_id").agg(pick(0.02).alias("low"), pick(0.98).alias("high"))


def ground_views(spark, sf_dir):
    """Downward-tilted cameras 30 m over the ground, one per customer."""
    k = F.col("c_custkey")
    a = k % 12 * 0.02
    return source(spark, sf_dir, "customer").select(
        k.alias("view_id"), (k % 90 * 5.0).alias("cx"), (k * 7 % 90 * 5.0).alias("cy"), (30.0 + k % 5).alias("cz"),
        # half a turn about x looks straight down; a little more tilts the view
        F.cos(1.5707963 + a).alias("qw"), F.sin(1.5707963 + a).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"),
        F.lit(160.0).alias("w"), F.lit(120.0).alias("h"), F.lit(120.0).alias("fx"), F.lit(120.0).alias("fy"), F.lit(80.0).alias("pcx"), F.lit(60.0).alias("pcy"),
    )


def ground_cells(spark, sf_dir):
    outlines = ops.ground_outlines(ground_views(spark, sf_dir), "view_id", F.lit(0.0), F.lit(32.0))
    return ops.ring_cells(outlines, 5.0).select("view_id", "col", "row")


GROUND_CELLS = """
    WITH v AS (SELECT c_custkey AS id, c_custkey % 90 * 5.0e0 AS cx, c_custkey * 7 % 90 * 5.0e0 AS cy, 30.0e0 + c_custkey % 5 AS cz,
        2 * (1.5707963e0 + c_custkey % 12 * 0.02e0) AS t FROM customer),
    b AS (SELECT k AS i, k / 12.0e0 AS u, 0.0e0 AS w FROM range(13) r(k) UNION ALL SELECT 13 + k, 1.0e0, k / 12.0e0 FROM range(13) r(k)
        UNION ALL SELECT 26 + k, 1 - k / 12.0e0, 1.0e0 FROM range(13) r(k) UNION ALL SELECT 39 + k, 0.0e0, 1 - k / 12.0e0 FROM range(13) r(k)),
    ry AS (SELECT id, i, cx, cy, cz, (u * 160 - 80) / 120 AS rx, cos(t) * ((w * 120 - 60) / 120) - sin(t) AS ry, sin(t) * ((w * 120 - 60) / 120) + cos(t) AS rz FROM v, b),
    sc AS (SELECT *, sqrt(rx * rx + ry * ry) AS f, CASE WHEN rz < 0 THEN (0 - cz) / rz END AS s FROM ry),
    ou AS (SELECT id, i, cx + k * rx AS x, cy + k * ry AS y FROM (SELECT *, CASE WHEN s IS NULL OR s * f > 64 THEN CASE WHEN f >= 1e-9 THEN 64 / f END ELSE s END AS k FROM sc) WHERE k IS NOT NULL),
    ee AS (SELECT id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first(x) OVER w) AS bx, coalesce(lead(y) OVER w, first(y) OVER w) AS byy FROM ou
        WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    bo AS (SELECT id, CAST(floor(min(x) / 5) AS BIGINT) AS c0, CAST(floor(max(x) / 5) AS BIGINT) AS c1, CAST(floor(min(y) / 5) AS BIGINT) AS r0, CAST(floor(max(y) / 5) AS BIGINT) AS r1 FROM ou GROUP BY id),
    g AS (SELECT id, col, unnest(range(r0, r1 + 1)) AS "row" FROM (SELECT *, unnest(range(c0, c1 + 1)) AS col FROM bo)),
    i AS (SELECT g.id, col, "row" FROM g JOIN ee ON ee.id = g.id WHERE (ay > ("row" + 0.5e0) * 5) <> (byy > ("row" + 0.5e0) * 5)
        AND (col + 0.5e0) * 5 < (bx - ax) * (("row" + 0.5e0) * 5 - ay) / (byy - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("ground_footprints", "J15 P18", GROUND_CELLS + """
    SELECT id AS view_id, count(*) AS cells, min(col) AS first_col, max(col) AS last_col, CAST(sum("row") AS BIGINT) AS row_sum FROM i GROUP BY id""")
def ground_footprints(spark, sf_dir):
    return ground_cells(spark, sf_dir).groupBy("view_id").agg(
        F.count(F.lit(1)).alias("cells"), F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.sum("row").alias("row_sum")
    )
