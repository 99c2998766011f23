"""Registered descriptor, graph, coverage and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, depth, descriptors, graphs, neighbors
from ..operators import windows as win
from ..session import cut_lineage
from .camera import CX, CY, FX, FY, posed_pixels
from .registry import query
from .telemetry import _ASOF, frame_positions, r
from .terrain import GROUND_CELLS, ground_cells
from .views import source, view, with_views

# Second visits: every vector again, slightly disturbed, at a later position.
_VISITS = """
    un AS (SELECT vec_id % 4 AS seq_id, vec_id AS idx, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS d FROM embeddings
        UNION ALL SELECT vec_id % 4, vec_id + 1000000, list_transform(embedding, lambda e, k: CAST(e AS DOUBLE) + 0.015e0 * sin(vec_id * 7 + k - 1)) FROM embeddings),
    nv AS (SELECT seq_id, idx, list_transform(d, lambda e: e / sqrt(list_dot_product(d, d))) AS d FROM un)"""


def visits(spark, sf_dir):
    e = source(spark, sf_dir, "embeddings")
    first = e.select((F.col("vec_id") % 4).alias("seq_id"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("d"), "label")
    shaken = first.withColumn("d", F.transform("d", lambda v, k: v + 0.015 * F.sin(F.col("idx") * 7 + k)))
    again = shaken.withColumn("idx", F.col("idx") + 1000000)
    return first.unionByName(again)


@query("loop_closure_search", "J12", f"""WITH {_VISITS},
    sm AS (SELECT a.seq_id, a.idx AS q, b.idx AS o, list_dot_product(a.d, b.d) AS s FROM nv a JOIN nv b ON a.seq_id = b.seq_id WHERE a.idx <> b.idx AND list_dot_product(a.d, b.d) > 0.9),
    rk AS (SELECT *, row_number() OVER (PARTITION BY seq_id, q ORDER BY s DESC, o) AS k FROM sm)
    SELECT seq_id, least(q, o) AS i, greatest(q, o) AS j, round(max(s), 6) AS score FROM rk WHERE k <= 5 AND abs(q - o) > 10 GROUP BY ALL""")
def loop_closure_search(spark, sf_dir):
    return r(descriptors.loop_closures(visits(spark, sf_dir), "seq_id", 5, 0.9), "score")


@query("mutual_descriptor_matches", "J11", f"""WITH {_VISITS},
    kp AS (SELECT CAST(floor(idx % 1000000 / 20) AS BIGINT) * 2 + CASE WHEN idx >= 1000000 THEN 1 ELSE 0 END AS image_id, idx % 1000000 AS kp, d FROM un),
    ct AS (SELECT image_id FROM kp GROUP BY image_id HAVING count(*) >= 8),
    ds AS (SELECT x.image_id AS a, y.image_id AS b, x.kp AS i, y.kp AS j, list_distance(x.d, y.d) AS dist FROM kp x JOIN kp y ON y.image_id = x.image_id + 1
        WHERE x.image_id % 2 = 0 AND x.image_id IN (SELECT image_id FROM ct) AND y.image_id IN (SELECT image_id FROM ct)),
    f AS (SELECT *, row_number() OVER (PARTITION BY a, b, i ORDER BY dist, j) AS k, lead(dist) OVER (PARTITION BY a, b, i ORDER BY dist, j) AS nxt FROM ds),
    g AS (SELECT *, row_number() OVER (PARTITION BY a, b, j ORDER BY dist, i) AS k, lead(dist) OVER (PARTITION BY a, b, j ORDER BY dist, i) AS nxt FROM ds),
    m AS (SELECT f.a, f.b, f.i, f.j, f.dist FROM f JOIN g USING (a, b, i, j) WHERE f.k = 1 AND g.k = 1 AND f.dist < 0.75e0 * f.nxt AND g.dist < 0.75e0 * g.nxt)
    SELECT a, b, i, j, round(dist, 6) AS dist FROM m WHERE (a, b) IN (SELECT (a, b) FROM m GROUP BY a, b HAVING count(*) >= 8)""")
def mutual_descriptor_matches(spark, sf_dir):
    at = F.col("idx") % 1000000
    keypoints = visits(spark, sf_dir).select(
        (F.floor(at / 20) * 2 + F.when(F.col("idx") >= 1000000, 1).otherwise(0)).alias("image_id"), at.alias("kp"), "d"
    )
    pairs = keypoints.select(F.col("image_id").alias("a")).distinct().filter("a % 2 = 0").withColumn("b", F.col("a") + 1)
    return r(descriptors.mutual_matches(keypoints, pairs), "dist")


_VIEWS = """
    vw AS (SELECT CAST(floor(vec_id / 40) AS BIGINT) AS window_id, vec_id AS idx, list_transform(embedding, lambda e: CAST(e AS DOUBLE) * (1 + vec_id % 7 / 10.0e0)) AS d FROM embeddings),
    nm AS (SELECT *, sqrt(list_dot_product(d, d)) AS norm, list_transform(d, lambda e: e / sqrt(list_dot_product(d, d))) AS u FROM vw)"""


def _views(spark, sf_dir):
    k = F.col("vec_id")
    return source(spark, sf_dir, "embeddings").select(
        F.floor(k / 40).alias("window_id"), k.alias("idx"), F.transform("embedding", lambda e: e.cast("double") * (1 + k % 7 / 10.0)).alias("d")
    )


@query("balanced_reference_views", "G52", f"""WITH {_VIEWS},
    pr AS (SELECT a.window_id, a.idx, any_value(a.norm) AS norm, any_value(a.u) AS u, sum(list_dot_product(a.u, b.u)) FILTER (a.idx <> b.idx) / (count(*) - 1) AS sim FROM nm a JOIN nm b USING (window_id) GROUP BY a.window_id, a.idx),
    sc AS (SELECT window_id, idx, sim, norm, list_var_samp(u) AS v FROM pr),
    mm AS (SELECT *, min(sim) OVER w AS s0, max(sim) OVER w AS s1, min(norm) OVER w AS n0, max(norm) OVER w AS n1, min(v) OVER w AS v0, max(v) OVER w AS v1 FROM sc WINDOW w AS (PARTITION BY window_id)),
    bl AS (SELECT *, floor((abs((sim - s0) / (s1 - s0 + 1e-8) - 0.5e0) + abs((norm - n0) / (n1 - n0 + 1e-8) - 0.5e0) + abs((v - v0) / (v1 - v0 + 1e-8) - 0.5e0)) * 1e9 + 0.5e0) AS off FROM mm)
    SELECT window_id, arg_min(idx, (off, idx)) AS idx FROM bl GROUP BY window_id""")
def balanced_reference_views(spark, sf_dir):
    return descriptors.reference_views(_views(spark, sf_dir), ["window_id"], 64, "balanced")


@query("widest_range_reference_views", "G52", f"""WITH {_VIEWS},
    rg AS (SELECT a.window_id, a.idx, max(CASE WHEN a.idx = b.idx THEN 0 ELSE list_dot_product(a.u, b.u) END) - min(CASE WHEN a.idx = b.idx THEN 0 ELSE list_dot_product(a.u, b.u) END) AS rg
        FROM nm a JOIN nm b USING (window_id) GROUP BY a.window_id, a.idx)
    SELECT window_id, arg_min(idx, (-floor(rg * 1e9 + 0.5e0), idx)) AS idx FROM rg GROUP BY window_id""")
def widest_range_reference_views(spark, sf_dir):
    return descriptors.reference_views(_views(spark, sf_dir), ["window_id"], 64, "range")


@query("middle_reference_views", "G52", f"""WITH {_VIEWS},
    k AS (SELECT window_id, idx, row_number() OVER (PARTITION BY window_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY window_id) AS n, min(idx) OVER (PARTITION BY window_id) AS f FROM vw)
    SELECT window_id, idx AS middle, f AS "first" FROM k WHERE k = floor(n / 2)""")
def middle_reference_views(spark, sf_dir):
    v = _views(spark, sf_dir)
    middle = descriptors.reference_views(v, ["window_id"], 64, "middle").withColumnRenamed("idx", "middle")
    return middle.join(descriptors.reference_views(v, ["window_id"], 64, "first").withColumnRenamed("idx", "first"), "window_id")


@query("feature_colours", "G51")
def feature_colours(spark, sf_dir):
    return r(descriptors.feature_colours(source(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "red green blue", 4)


@query("gps_revisits", "J10 J7", with_views("telemetry frames", "WITH " + _ASOF + """,
    o AS (SELECT flight_id, arg_min(latitude, time_s) AS la, arg_min(longitude, time_s) AS lo FROM mixed GROUP BY flight_id),
    p AS (SELECT mixed.flight_id, row_number() OVER (PARTITION BY mixed.flight_id ORDER BY time_s, frame_id) - 1 AS idx,
        (longitude - lo) * 111320.0e0 * cos(radians(la)) AS x, (latitude - la) * 111320.0e0 AS y FROM mixed JOIN o USING (flight_id)),
    d AS (SELECT a.flight_id, a.idx AS "right", b.idx AS "left", sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a JOIN p b USING (flight_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY flight_id, "right" ORDER BY distance, "left") AS k FROM d WHERE distance <= 300),
    cd AS (SELECT *, row_number() OVER (PARTITION BY flight_id, "right" ORDER BY distance, "left") AS place FROM k WHERE k <= 8 AND "left" < "right" - 2)
    SELECT flight_id, "right", "left", round(distance, 4) AS distance, place FROM cd WHERE place <= 3"""))
def gps_revisits(spark, sf_dir):
    from pyspark.sql import Window as W

    at = frame_positions(spark, sf_dir)
    o = at.groupBy("flight_id").agg(F.min_by(F.struct("latitude", "longitude"), F.struct("time_s", "frame_id")).alias("_o"))
    placed = win.indexed(at, ["flight_id"], ["time_s", "frame_id"]).join(o, "flight_id").select(
        "flight_id", "idx", ((F.col("longitude") - F.col("_o.longitude")) * 111320.0 * F.cos(F.radians("_o.latitude"))).alias("x"),
        ((F.col("latitude") - F.col("_o.latitude")) * 111320.0).alias("y"),
    )
    near = neighbors.nearest_ids(placed, ["flight_id"], "idx", 8, 300.0, ("x", "y")).filter(F.col("neighbour") < F.col("idx") - 2)
    # at most eight neighbours per frame reach this window
    place = F.row_number().over(W.partitionBy("flight_id", "idx").orderBy("distance", "neighbour"))
    out = near.withColumn("place", place).filter("place <= 3")
    return r(out.select("flight_id", F.col("idx").alias("right"), F.col("neighbour").alias("left"), "distance", "place"), "distance", 4)


@query("verified_components", "G23 U3", with_views("edges", """
    WITH RECURSIVE n AS (SELECT a AS v FROM edges UNION SELECT b FROM edges), e AS (SELECT a, b FROM edges WHERE verified UNION SELECT b, a FROM edges WHERE verified),
    r AS (SELECT v, v AS w FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.w)
    SELECT v AS node, min(w) AS label FROM r GROUP BY v"""))
def verified_components(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    links = edges.filter("verified").select("a", "b")
    return graphs.components(nodes, links, [], "node")


@query("graph_set_operations", "U1 U2 U3", with_views("edges", """
    WITH s AS (SELECT a AS v FROM edges WHERE verified), t AS (SELECT b AS v FROM edges WHERE NOT verified)
    SELECT 'both' AS part, v FROM (SELECT v FROM s INTERSECT SELECT v FROM t) UNION ALL SELECT 'any', v FROM (SELECT v FROM s UNION SELECT v FROM t)
    UNION ALL SELECT 'only_first', v FROM (SELECT v FROM s EXCEPT SELECT v FROM t)"""))
def graph_set_operations(spark, sf_dir):
    edges = view(spark, sf_dir, "edges")
    s, t = edges.filter("verified").select(F.col("a").alias("v")), edges.filter("not verified").select(F.col("b").alias("v"))
    parts = {"both": s.intersect(t), "any": s.union(t).distinct(), "only_first": s.exceptAll(t).distinct().join(t, "v", "left_anti")}
    out = None
    for name, df in parts.items():
        tagged = df.select(F.lit(name).alias("part"), "v")
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("match_graph_subset", "J19 U3", with_views("edges", """
    WITH m AS (SELECT CASE WHEN a < b THEN a ELSE b END AS x, CASE WHEN a < b THEN b ELSE a END AS y, count(*) AS rows FROM edges GROUP BY ALL)
    SELECT x * 2147483647 + y AS pair_id, x AS image_a, y AS image_b, rows FROM m WHERE x % 5 <> 0 AND y % 5 <> 0"""))
def match_graph_subset(spark, sf_dir):
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    matches = view(spark, sf_dir, "edges").groupBy((lo.cast("bigint") * F.lit(graphs.PAIR_BASE) + hi).alias("pair_id")).agg(F.count(F.lit(1)).alias("rows"))
    ids = view(spark, sf_dir, "edges").select(F.explode(F.array("a", "b")).alias("image_id")).distinct().filter("image_id % 5 <> 0")
    return graphs.match_subset(matches, ids, [])


def mesh(spark, sf_dir):
    """Triangles of a 15 x 15 sheet per 450 keys, with holes where keys are missing."""
    k = F.col("o_orderkey")
    f = k % 450
    q = F.floor(f / 2)
    corner = q % 15 + F.floor(q / 15) * 16
    upper = f % 2 == 1
    faces = source(spark, sf_dir, "orders").select(
        F.floor(k / 450).alias("mesh_id"), k.alias("face_id"), F.when(upper, corner + 1).otherwise(corner).alias("a"),
        F.when(upper, corner + 17).otherwise(corner + 1).alias("b"), (corner + 16).alias("c"),
    )
    ids = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vertex_id")).distinct()
    v = F.col("vertex_id")
    vertices = ids.select("mesh_id", "vertex_id", (v % 16 + v % 3 * 0.05).alias("x"), F.floor(v / 16).cast("double").alias("y"),
                          (v * 7 % 11 / 10.0 + F.when((v + F.col("mesh_id")) % 97 == 0, 30.0).otherwise(0.0)).alias("z"))
    return faces, vertices


_MESH = """
    fc AS (SELECT CAST(floor(o_orderkey / 450) AS BIGINT) AS mesh_id, o_orderkey AS face_id, o_orderkey % 2 AS up,
        CAST(floor(o_orderkey % 450 / 2) AS BIGINT) % 15 + CAST(floor(floor(o_orderkey % 450 / 2) / 15) AS BIGINT) * 16 AS c FROM orders),
    fa AS (SELECT mesh_id, face_id, CASE up WHEN 1 THEN c + 1 ELSE c END AS a, CASE up WHEN 1 THEN c + 17 ELSE c + 1 END AS b, c + 16 AS c FROM fc),
    vt AS (SELECT mesh_id, v, v % 16 + v % 3 * 0.05e0 AS x, floor(v / 16) AS y, v * 7 % 11 / 10.0e0 + CASE WHEN (v + mesh_id) % 97 = 0 THEN 30 ELSE 0 END AS z
        FROM (SELECT mesh_id, a AS v FROM fa UNION SELECT mesh_id, b FROM fa UNION SELECT mesh_id, c FROM fa)),
    ms AS (SELECT fa.*, greatest(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)), sqrt(pow(q.x - r.x, 2) + pow(q.y - r.y, 2) + pow(q.z - r.z, 2)),
        sqrt(pow(r.x - p.x, 2) + pow(r.y - p.y, 2) + pow(r.z - p.z, 2))) AS e, (p.x + q.x + r.x) / 3 AS gx, (p.y + q.y + r.y) / 3 AS gy, (p.z + q.z + r.z) / 3 AS gz
        FROM fa JOIN vt p ON p.mesh_id = fa.mesh_id AND p.v = fa.a JOIN vt q ON q.mesh_id = fa.mesh_id AND q.v = fa.b JOIN vt r ON r.mesh_id = fa.mesh_id AND r.v = fa.c),
    lm AS (SELECT mesh_id, count(*) AS faces, quantile_cont(e, 0.95) AS p95, max(e) AS mx, greatest(2.25e0 * quantile_cont(e, 0.95), 6 * quantile_cont(e, 0.5)) AS lim FROM ms GROUP BY mesh_id),
    kp AS (SELECT ms.* FROM ms JOIN lm USING (mesh_id) WHERE e <= lim)"""


@query("mesh_edge_limits", "G24", f"""WITH {_MESH}
    SELECT lm.mesh_id, faces, round(p95, 5) AS longest_p95_m, round(mx, 5) AS longest_max_m, round(lim, 5) AS limit_m, count(kp.face_id) AS kept FROM lm LEFT JOIN kp USING (mesh_id) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY lm.mesh_id, faces, p95, mx, lim"))
def mesh_edge_limits(spark, sf_dir):
    faces, vertices = mesh(spark, sf_dir)
    measured = graphs.longest_edges(faces, vertices, ["mesh_id"])
    limits = graphs.edge_limits(measured, ["mesh_id"])
    kept = measured.join(limits, "mesh_id").groupBy("mesh_id").agg(F.count_if(F.col("longest_m") <= F.col("limit_m")).alias("kept"))
    return r(limits.join(kept, "mesh_id"), "longest_p95_m longest_max_m limit_m", 5)


def _plausible(spark, sf_dir):
    faces, vertices = mesh(spark, sf_dir)
    measured = cut_lineage(graphs.longest_edges(faces, vertices, ["mesh_id"]))  # read for the limits and for the faces
    limits = graphs.edge_limits(measured, ["mesh_id"])
    flagged = measured.join(limits.select("mesh_id", "limit_m"), "mesh_id").withColumn("_ok", F.col("longest_m") <= F.col("limit_m")).drop("limit_m")
    return graphs.keep_unless_all(flagged, ["mesh_id"], "_ok"), vertices, limits


@query("supported_faces", "J16", f"""WITH {_MESH}
    SELECT kp.mesh_id, kp.face_id FROM kp JOIN lm USING (mesh_id) WHERE EXISTS (SELECT 1 FROM vt WHERE vt.mesh_id = kp.mesh_id AND v % 23 = 0
        AND sqrt(pow(vt.x - gx, 2) + pow(vt.y - gy, 2) + pow(vt.z - gz, 2)) <= lim)""")
def supported_faces(spark, sf_dir):
    kept, vertices, limits = _plausible(spark, sf_dir)
    return graphs.supported(kept, vertices.filter("vertex_id % 23 = 0"), limits, ["mesh_id"]).select("mesh_id", "face_id")


@query("mesh_without_fragments", "G23")
def mesh_without_fragments(spark, sf_dir):
    kept, _, _ = _plausible(spark, sf_dir)
    return graphs.drop_fragments(kept.select("mesh_id", "face_id", "a", "b", "c"), ["mesh_id"]).select("mesh_id", "face_id", "label", "size")


def _seen(spark, sf_dir):
    return ground_cells(spark, sf_dir).select((F.col("view_id") % 4).alias("site"), "view_id", (F.col("row") * 100000 + F.col("col")).alias("cell"))


@query("coverage_first_pick", "G53", GROUND_CELLS + """,
    sn AS (SELECT id % 4 AS site, id, "row" * 100000 + col AS cell FROM i),
    gn AS (SELECT site, id, count(*) AS gain FROM sn GROUP BY site, id)
    SELECT site, arg_min(id, (-gain, id)) AS view_id, max(gain) AS gain FROM gn GROUP BY site""")
def coverage_first_pick(spark, sf_dir):
    seen = cut_lineage(_seen(spark, sf_dir))  # read twice below
    return coverage.best_view(seen, coverage.coverage_needs(seen, ["site"], 6), ["site"])


@query("coverage_selection", "G53")
def coverage_selection(spark, sf_dir):
    chosen, report = coverage.greedy_coverage(_seen(spark, sf_dir), ["site"], 8, 6)
    return r(chosen.join(report, "site"), "met_percent any_percent", 4)


def _candidates(spark, sf_dir):
    k = F.col("frame_id")
    placed = win.indexed(view(spark, sf_dir, "frames"), ["flight_id"], ["time_s", "frame_id"])
    frames = placed.select("flight_id", "idx", "n", "frame_id", "time_s", "sharpness", (k * 0.05).alias("path_m"), ((F.col("idx") % 4 == 0) | (F.col("idx") == F.col("n") - 1)).alias("selected"))
    ahead = F.explode(F.sequence(F.col("idx") + 1, F.least(F.col("idx") + 4, F.col("n") - 1)))
    pairs = frames.filter("idx < n - 1").select("flight_id", F.col("idx").alias("a"), ahead.alias("b"))
    mix = F.col("a") * 7 + F.col("b") * 3 + F.col("flight_id")
    return frames, pairs.select("flight_id", "a", "b", (mix % 3 != 0).alias("verified"), (mix % 11 / 100.0).alias("motion"))


@query("visual_support", "G54 U3", with_views("frames", """
    WITH ix AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time_s, frame_id) - 1 AS idx, count(*) OVER (PARTITION BY flight_id) AS n FROM frames),
    s AS (SELECT *, idx % 4 = 0 OR idx = n - 1 AS sel, floor(idx / 4) * 4 AS lo, least(floor(idx / 4) * 4 + 4, n - 1) AS hi FROM ix),
    t AS (SELECT flight_id, frame_id, sel OR (lo * 7 + idx * 3 + flight_id) % 3 <> 0 OR (idx * 7 + hi * 3 + flight_id) % 3 <> 0 AS ok FROM s)
    SELECT flight_id, count(*) AS candidates, count(*) FILTER (NOT ok) AS unsupported, round(count(*) FILTER (ok) / count(*), 6) AS support_fraction FROM t GROUP BY flight_id"""))
def visual_support(spark, sf_dir):
    frames, pairs = _candidates(spark, sf_dir)
    out = coverage.visual_support(frames, pairs, "flight_id").groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~F.col("supported")).alias("unsupported"),
        (F.count_if("supported") / F.count(F.lit(1))).alias("support_fraction"),
    )
    return r(out, "support_fraction")


@query("bridge_selection", "W9", with_views("frames", """
    WITH RECURSIVE ix AS (SELECT flight_id, row_number() OVER (PARTITION BY flight_id ORDER BY time_s, frame_id) - 1 AS idx, count(*) OVER (PARTITION BY flight_id) AS n,
        time_s, sharpness, frame_id * 0.05e0 AS path_m FROM frames),
    pr AS (SELECT flight_id, a, b, (a * 7 + b * 3 + flight_id) % 3 <> 0 AS v, (a * 7 + b * 3 + flight_id) % 11 / 100.0e0 AS m
        FROM (SELECT flight_id, n, idx AS a, unnest(range(idx + 1, least(idx + 4, n - 1) + 1)) AS b FROM ix WHERE idx < n - 1)),
    st AS (SELECT flight_id, n, 0 AS i, 0 AS anchor, 0 AS p1, 'start' AS w1, NULL::BIGINT AS p2, NULL::VARCHAR AS w2 FROM ix WHERE idx = 0
        UNION ALL
        SELECT flight_id, n, i, coalesce(p2, held) AS anchor, CASE WHEN bridged THEN held END AS p1, CASE WHEN bridged THEN 'bridge_before_overlap_loss' END AS w1, p2,
            CASE WHEN p2 IS NOT NULL THEN why END AS w2 FROM (
            SELECT *, CASE why WHEN 'unresolved_visual_break' THEN i ELSE (SELECT arg_min(c.idx, (-c.sharpness * (0.85e0 + 0.15e0 * (c.idx - t.held) / (t.i - t.held)), c.idx))
                FROM ix c JOIN pr q ON q.flight_id = c.flight_id AND q.b = c.idx WHERE t.why IS NOT NULL AND c.flight_id = t.flight_id AND q.a = t.held AND q.v AND c.idx BETWEEN t.i - 2 AND t.i) END AS p2 FROM (
            SELECT s.flight_id, s.n, s.i, s.held, s.bridged, CASE WHEN NOT coalesce(q.v, false) THEN 'unresolved_visual_break' WHEN q.m >= 0.06e0 THEN 'visual_motion'
                WHEN now.path_m - was.path_m >= 16.25e0 THEN 'trajectory_gap' WHEN now.time_s - was.time_s >= 4.0e0 THEN 'temporal_guard' END AS why FROM (
                SELECT st.flight_id, st.n, st.i + 1 AS i, NOT coalesce(p.v, false) AND st.i > st.anchor AS bridged,
                    CASE WHEN NOT coalesce(p.v, false) AND st.i > st.anchor THEN st.i ELSE st.anchor END AS held
                FROM st LEFT JOIN pr p ON p.flight_id = st.flight_id AND p.a = st.anchor AND p.b = st.i + 1 WHERE st.i + 1 < st.n) s
            LEFT JOIN pr q ON q.flight_id = s.flight_id AND q.a = s.held AND q.b = s.i
            JOIN ix now ON now.flight_id = s.flight_id AND now.idx = s.i JOIN ix was ON was.flight_id = s.flight_id AND was.idx = s.held) t)),
    pk AS (SELECT flight_id, p1 AS idx, w1 AS reason FROM st WHERE p1 IS NOT NULL UNION ALL SELECT flight_id, p2, w2 FROM st WHERE p2 IS NOT NULL)
    SELECT * FROM pk UNION ALL SELECT flight_id, n - 1, 'end' FROM (SELECT DISTINCT flight_id, n FROM ix) e WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.flight_id = e.flight_id AND pk.idx = e.n - 1)"""))
def bridge_selection(spark, sf_dir):
    frames, pairs = _candidates(spark, sf_dir)
    return coverage.bridge_selection(frames, pairs, "flight_id")


@query("cross_view_consistency", "J14 P11 P12", with_views("pixels", """
    WITH cam AS (SELECT *, cos(frame_id * 0.1e0) AS c, sin(frame_id * 0.1e0) AS n, (u - 3.5e0) / 8.0e0 * depth AS px, (v - 3.5e0) / 9.0e0 * depth AS py FROM pixels),
    wp AS (SELECT frame_id, pixel, u, v, c * px - n * py + frame_id % 8 * 0.5e0 AS x, n * px + c * py + 1 AS y, depth + 2 AS z FROM cam WHERE depth > 0),
    vw AS (SELECT frame_id, s AS source_id FROM (SELECT DISTINCT frame_id FROM pixels), LATERAL (VALUES (frame_id - 1), (frame_id + 1)) t(s) WHERE floor(s / 8) = floor(frame_id / 8)),
    pj AS (SELECT w.*, source_id, cos(source_id * 0.1e0) AS c, sin(source_id * 0.1e0) AS n, x - source_id % 8 * 0.5e0 AS dx, y - 1 AS dy, z - 2 AS dz FROM wp w JOIN vw USING (frame_id)),
    uv AS (SELECT *, 8 * (c * dx + n * dy) / dz + 3.5e0 AS pu, 9 * (-n * dx + c * dy) / dz + 3.5e0 AS pv FROM pj WHERE dz > 0),
    st AS (SELECT uv.frame_id, uv.pixel, uv.source_id, uv.x, uv.y, uv.z, sum(w * s.x) AS sx, sum(w * s.y) AS sy, sum(w * s.z) AS sz FROM
        (SELECT *, floor(pu) + i AS qu, floor(pv) + j AS qv, (CASE i WHEN 1 THEN pu - floor(pu) ELSE 1 - pu + floor(pu) END) * (CASE j WHEN 1 THEN pv - floor(pv) ELSE 1 - pv + floor(pv) END) AS w
         FROM uv, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) uv JOIN wp s ON s.frame_id = uv.source_id AND s.u = qu AND s.v = qv GROUP BY ALL)
    SELECT frame_id, pixel, count(*) AS views, round((x + sum(sx)) / (count(*) + 1), 4) AS mean_x, round((y + sum(sy)) / (count(*) + 1), 4) AS mean_y, round((z + sum(sz)) / (count(*) + 1), 4) AS mean_z
    FROM st WHERE sqrt(pow(sx - x, 2) + pow(sy - y, 2) + pow(sz - z, 2)) < 0.2e0 GROUP BY frame_id, pixel, x, y, z"""))
def cross_view_consistency(spark, sf_dir):
    world = depth.world_points(posed_pixels(spark, sf_dir), FX, FY, CX, CY)
    frames = world.select("frame_id").distinct()
    s = F.col("source_id")
    views = frames.withColumn("source_id", F.explode(F.array(F.col("frame_id") - 1, F.col("frame_id") + 1))).filter(
        F.floor(s / 8) == F.floor(F.col("frame_id") / 8)
    ).select("frame_id", "source_id", F.cos(s * 0.05).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(s * 0.05).alias("qz"),
             (s % 8 * 0.5).alias("tx"), F.lit(1.0).alias("ty"), F.lit(2.0).alias("tz"))
    return r(coverage.consistent_points(world, views, FX, FY, CX, CY, 8, 0.2, 1), "mean_x mean_y mean_z", 4)
