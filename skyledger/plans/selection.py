"""Registered window, pick and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, resample, suppression
from ..operators import windows as ops
from .registry import query
from .telemetry import _PATH, r
from .views import source, view, with_views

_IDX = """
    ix AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY time_s, frame_id) - 1 AS idx,
           count(*) OVER (PARTITION BY flight_id) AS n FROM frames)"""


def _indexed(spark, sf_dir):
    return ops.indexed(view(spark, sf_dir, "frames"), ["flight_id"], ["time_s", "frame_id"])


@query("even_frame_picks", "W5 U2", with_views("frames", f"""WITH {_IDX},
    p AS (SELECT DISTINCT flight_id, CAST(round_even(i * (n - 1) / 9.0e0, 0) AS BIGINT) AS idx
          FROM (SELECT DISTINCT flight_id, n FROM ix), range(10) t(i) WHERE n > 10)
    SELECT flight_id, frame_id, n <= 10 OR p.idx IS NOT NULL AS even_of_10, n <= 1 OR idx = floor(n / 2) AS middle,
        idx % 4 = 0 OR idx = n - 1 AS every_4_and_last FROM ix LEFT JOIN p USING (flight_id, idx)"""))
def even_frame_picks(spark, sf_dir):
    i, n = F.col("idx"), F.col("n")
    return _indexed(spark, sf_dir).select(
        "flight_id", "frame_id", ops.is_even_pick(i, n, 10).alias("even_of_10"), ops.is_even_pick(i, n, 1).alias("middle"),
        ops.stride_with_last(i, n, 4).alias("every_4_and_last"),
    )


_STEP = """
    pl AS (SELECT flight_id, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 2) / 6.0e0) AS BIGINT) END AS k, n
           FROM (SELECT flight_id, count(*) AS n FROM frames GROUP BY flight_id)),
    win AS (SELECT flight_id, c AS chunk, c * 6 AS "start", least(c * 6 + 8, n) AS "end" FROM pl, range(1000000) t(c) WHERE c < k)"""


@query("window_plan", "W10 X3", with_views("frames", """
    WITH pl AS (SELECT flight_id, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 2) / 6.0e0) AS BIGINT) END AS k, n
           FROM (SELECT flight_id, count(*) AS n FROM frames GROUP BY flight_id))
    SELECT flight_id, c AS chunk, c * 6 AS "start", least(c * 6 + 8, n) AS "end" FROM (SELECT flight_id, n, unnest(range(k)) AS c FROM pl)"""))
def window_plan(spark, sf_dir):
    lengths = view(spark, sf_dir, "frames").groupBy("flight_id").agg(F.count(F.lit(1)).alias("n"))
    return ops.window_plan(lengths, "flight_id", 8, 2)


@query("frame_windows", "W10 T4", with_views("frames", f"""WITH {_IDX},
    pl AS (SELECT flight_id, CASE WHEN n <= 8 THEN 1 ELSE CAST(ceil((n - 2) / 6.0e0) AS BIGINT) END AS k, n
           FROM (SELECT flight_id, count(*) AS n FROM frames GROUP BY flight_id)),
    win AS (SELECT flight_id, c AS chunk, c * 6 AS s, least(c * 6 + 8, n) AS e FROM (SELECT flight_id, n, unnest(range(k)) AS c FROM pl))
    SELECT flight_id, frame_id, chunk, min(chunk) OVER (PARTITION BY flight_id, frame_id) AS owner
    FROM ix JOIN win USING (flight_id) WHERE idx >= s AND idx < e"""))
def frame_windows(spark, sf_dir):
    return ops.frame_windows(_indexed(spark, sf_dir), 8, 2).select("flight_id", "frame_id", "chunk", "owner")


_SCORE = """0.4e0 * (ln(1 + sharpness) / ln(1 + CASE WHEN peak = 0 THEN 1 ELSE peak END)) + 0.3e0 * least((frame_id % 53) / 5.0e0 / 5.0e0, 1.0e0)
    + 0.2e0 * (least(parallax_px / 8.0e0, 1.0e0) * least(35.0e0 / greatest(parallax_px, 1e-6), 1.0e0)) + 0.1e0 * least(tracked_fraction / 0.65e0, 1.0e0)"""


@query("best_frame_per_bin", "W8", with_views("frames", f"""WITH {_IDX},
    b AS (SELECT *, CAST(floor(((idx + 1) * 6 - 1) / n) AS BIGINT) AS bin FROM ix),
    p AS (SELECT *, max(sharpness) OVER (PARTITION BY flight_id, bin) AS peak FROM b),
    s AS (SELECT *, round({_SCORE}, 9) AS score FROM p)
    SELECT flight_id, bin, frame_id, round(score, 6) AS score FROM s
    QUALIFY row_number() OVER (PARTITION BY flight_id, bin ORDER BY score DESC, sharpness DESC, frame_id DESC) = 1"""))
def best_frame_per_bin(spark, sf_dir):
    binned = _indexed(spark, sf_dir).withColumn("bin", ops.time_bin(F.col("idx"), F.col("n"), 6))
    peaks = binned.groupBy("flight_id", "bin").agg(F.max("sharpness").alias("peak"))
    scored = binned.join(peaks, ["flight_id", "bin"]).withColumn("score", ops.geometry_score(
        F.col("sharpness"), F.col("peak"), F.col("frame_id") % 53 / 5.0, 5.0, F.col("parallax_px"), F.col("tracked_fraction")
    ))
    best = ops.best_per_bin(r(scored, "score", 9), ["flight_id", "bin"], "score", ["sharpness", "frame_id"])
    return r(best.select("flight_id", "bin", "frame_id", "score"), "score")


_CLIP = "clips AS (SELECT flight_id, CAST(floor(max(time_s) * 2) AS BIGINT) + 1 AS total FROM telemetry GROUP BY flight_id)"
_SEEDS = _PATH + f""",
    {_CLIP},
    st AS (SELECT flight_id, path_m, min(time_s) AS at_s FROM path GROUP BY flight_id, path_m),
    kk AS (SELECT c.flight_id, total, least(24, total) AS k, CAST(greatest(2, round_even(least(24, total) * 0.6e0, 0)) AS BIGINT) AS ks, far
           FROM clips c JOIN (SELECT flight_id, max(path_m) AS far FROM st GROUP BY flight_id) USING (flight_id)),
    k2 AS (SELECT *, greatest(2, k - ks) AS kt FROM kk),
    tm AS (SELECT flight_id, CAST(round_even(i * ((total - 1) / (kt - 1)), 0) AS BIGINT) AS anchor
           FROM (SELECT *, unnest(range(kt)) AS i FROM k2)),
    pr AS (SELECT flight_id, total, i * (far / (ks - 1)) AS d FROM (SELECT *, unnest(range(ks)) AS i FROM k2)),
    l AS (SELECT pr.*, st.path_m AS ld, st.at_s AS lv FROM pr ASOF LEFT JOIN st ON pr.flight_id = st.flight_id AND pr.d >= st.path_m),
    b AS (SELECT l.*, st.path_m AS rd, st.at_s AS rv FROM l ASOF LEFT JOIN st ON l.flight_id = st.flight_id AND l.d < st.path_m),
    sp AS (SELECT flight_id, CAST(greatest(0, least(round_even(2.0e0 * CASE WHEN ld IS NULL THEN rv WHEN rd IS NULL THEN lv
        ELSE lv + (d - ld) / (rd - ld) * (rv - lv) END, 0), total - 1)) AS BIGINT) AS anchor FROM b),
    seeds AS (SELECT * FROM tm UNION SELECT * FROM sp UNION SELECT flight_id, 0 FROM clips UNION SELECT flight_id, total - 1 FROM clips)
"""


def _anchors(spark, sf_dir):
    samples = view(spark, sf_dir, "telemetry")
    clips = samples.groupBy("flight_id").agg((F.floor(F.max("time_s") * 2) + 1).alias("total"))
    path = resample.path_table(samples, ["flight_id"])
    return clips, ops.anchor_seeds(clips, path, "flight_id", 2.0, 24)


@query("anchor_seeds", "W6 U2 J2", with_views("telemetry", "WITH RECURSIVE " + _SEEDS + " SELECT flight_id, anchor FROM seeds"))
def anchor_seeds(spark, sf_dir):
    return _anchors(spark, sf_dir)[1]


@query("hybrid_anchors", "W6", with_views("telemetry", "WITH RECURSIVE " + _SEEDS + """,
    cl AS (SELECT flight_id, total, least(24, total) AS want FROM clips),
    pool AS (SELECT DISTINCT flight_id, CAST(round_even(i * CASE WHEN p > 1 THEN (total - 1) / (p - 1) ELSE 0 END, 0) AS BIGINT) AS f
             FROM (SELECT *, unnest(range(p)) AS i FROM (SELECT *, least(total, want * 8) AS p FROM cl))),
    base AS (SELECT flight_id, want, list_sort(list_distinct(list(anchor))) AS chosen FROM seeds JOIN cl USING (flight_id) GROUP BY flight_id, want),
    far AS (SELECT flight_id, want, chosen FROM base
        UNION ALL
        SELECT flight_id, want, list_append(chosen, f) FROM (
            SELECT g.flight_id, g.want, g.chosen, p.f, row_number() OVER (PARTITION BY g.flight_id ORDER BY list_min([abs(c - p.f) for c in g.chosen]) DESC, p.f) AS k
            FROM far g JOIN pool p ON p.flight_id = g.flight_id AND NOT list_contains(g.chosen, p.f) WHERE len(g.chosen) < g.want) WHERE k = 1),
    done AS (SELECT flight_id, want, arg_max(chosen, len(chosen)) AS chosen FROM far GROUP BY flight_id, want)
    SELECT flight_id, unnest(list_sort(chosen)[1:want]) AS anchor FROM done"""))
def hybrid_anchors(spark, sf_dir):
    clips, seeds = _anchors(spark, sf_dir)
    return ops.fill_anchors(seeds, clips, "flight_id", 24)


@query("candidate_bins", "W7", with_views("telemetry", f"""WITH {_CLIP},
    an AS (SELECT flight_id, total, CAST(floor(i * i * total / 36.0e0) AS BIGINT) AS anchor FROM clips, range(6) t(i)),
    a2 AS (SELECT DISTINCT * FROM an),
    sp AS (SELECT flight_id, anchor, coalesce(CAST(floor((lag(anchor) OVER w + anchor) / 2) AS BIGINT) + 1, 0) AS left_frame,
        coalesce(CAST(floor((anchor + lead(anchor) OVER w) / 2) AS BIGINT), total - 1) AS right_frame FROM a2 WINDOW w AS (PARTITION BY flight_id ORDER BY anchor)),
    ct AS (SELECT *, least(5, greatest(1, right_frame - left_frame + 1)) AS c FROM sp)
    SELECT DISTINCT flight_id, anchor, left_frame, right_frame, CAST(round_even(left_frame + i * CASE WHEN c > 1 THEN
        (right_frame - left_frame) / (c - 1) ELSE 0 END, 0) AS BIGINT) AS candidate FROM (SELECT *, unnest(range(c)) AS i FROM ct)"""))
def candidate_bins(spark, sf_dir):
    clips = view(spark, sf_dir, "telemetry").groupBy("flight_id").agg((F.floor(F.max("time_s") * 2) + 1).alias("total"))
    anchors = clips.select("flight_id", "total", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select(
        "flight_id", F.floor(F.col("i") * F.col("i") * F.col("total") / 36.0).alias("anchor")
    ).distinct()
    return ops.candidate_bins(anchors, clips, "flight_id", 5)


@query("candidate_pool_bins", "W7", with_views("telemetry", f"""WITH RECURSIVE {_CLIP},
    a2 AS (SELECT DISTINCT flight_id, total, CAST(floor(i * i * total / 400.0e0) AS BIGINT) AS anchor FROM clips, range(20) t(i)),
    rk AS (SELECT flight_id, anchor, CAST(floor((total - 1) / 7) AS BIGINT) + 1 AS pool, row_number() OVER w - 1 AS i,
        count(*) OVER (PARTITION BY flight_id) AS m, total FROM a2 WINDOW w AS (PARTITION BY flight_id ORDER BY anchor)),
    raw AS (SELECT *, least(CAST(ceil(anchor / 7) AS BIGINT), pool - 1) AS q FROM rk WHERE pool >= m),
    fw AS (SELECT flight_id, anchor, pool, m, i, q AS f FROM raw WHERE i = 0 UNION ALL
        SELECT r.flight_id, r.anchor, r.pool, r.m, r.i, greatest(r.q, fw.f + 1) FROM fw JOIN raw r ON r.flight_id = fw.flight_id AND r.i = fw.i + 1),
    bw AS (SELECT flight_id, anchor, pool, i, least(f, pool - 1) AS g FROM fw WHERE i = m - 1 UNION ALL
        SELECT f.flight_id, f.anchor, f.pool, f.i, least(least(f.f, f.pool - (f.m - f.i)), bw.g - 1) FROM bw JOIN fw f ON f.flight_id = bw.flight_id AND f.i = bw.i - 1)
    SELECT flight_id, anchor, g AS pool_rank, coalesce(CAST(floor((lag(g) OVER w + g) / 2) AS BIGINT) + 1, 0) AS left_rank,
        coalesce(CAST(floor((g + lead(g) OVER w) / 2) AS BIGINT), pool - 1) AS right_rank FROM bw WINDOW w AS (PARTITION BY flight_id ORDER BY anchor)"""))
def candidate_pool_bins(spark, sf_dir):
    clips = view(spark, sf_dir, "telemetry").groupBy("flight_id").agg((F.floor(F.max("time_s") * 2) + 1).alias("total"))
    anchors = clips.select("flight_id", "total", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i")).select(
        "flight_id", F.floor(F.col("i") * F.col("i") * F.col("total") / 400.0).alias("anchor")
    ).distinct()
    return ops.pool_bins(anchors, clips, "flight_id", 7)


@query("loop_window_lookup", "J5", with_views("frames", f"""WITH {_STEP.replace('range(1000000) t(c) WHERE c < k', '(SELECT unnest(range(100000)) AS c) WHERE c < k')},
    lp AS (SELECT flight_id, frame_id, frame_id % 40 AS pos FROM frames),
    h AS (SELECT lp.*, w.chunk, w."start" AS b, w."end" AS e FROM lp ASOF LEFT JOIN win w ON lp.flight_id = w.flight_id AND lp.pos >= w."start")
    SELECT flight_id, frame_id, pos, chunk, CASE WHEN pos - 3 < b THEN b WHEN pos + 3 > e THEN greatest(b, e - 6) ELSE pos - 3 END AS range_start,
        CASE WHEN pos - 3 < b THEN least(e, b + 6) WHEN pos + 3 > e THEN e ELSE pos + 3 END AS range_end
    FROM h WHERE pos <= e"""))
def loop_window_lookup(spark, sf_dir):
    frames = view(spark, sf_dir, "frames")
    plan = ops.window_plan(frames.groupBy("flight_id").agg(F.count(F.lit(1)).alias("n")), "flight_id", 8, 2)
    loops = frames.select("flight_id", "frame_id", (F.col("frame_id") % 40).alias("pos"))
    found = asof.last_before(loops, plan, ["flight_id"], "pos", ["frame_id"], "start", ["chunk", "start", "end"])
    a, b, e = F.col("pos"), F.col("start"), F.col("end")
    inside = found.filter(F.col("chunk").isNotNull() & (a <= e))
    return inside.select(
        "flight_id", "frame_id", "pos", "chunk",
        F.when(a - 3 < b, b).when(a + 3 > e, F.greatest(b, e - 6)).otherwise(a - 3).alias("range_start"),
        F.when(a - 3 < b, F.least(e, b + 6)).when(a + 3 > e, e).otherwise(a + 3).alias("range_end"),
    )


@query("first_loop_per_window_pair", "W14", """
    WITH l AS (SELECT l_partkey % 40 AS a, l_suppkey % 40 AS b, l_orderkey * 10 + l_linenumber AS place, max(l_quantity) AS score FROM lineitem GROUP BY ALL)
    SELECT a, b, min(place) AS place, arg_min(score, place) AS score FROM l WHERE a <> b GROUP BY a, b""")
def first_loop_per_window_pair(spark, sf_dir):
    rows = source(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
    ).agg(F.max("l_quantity").alias("score"))
    return suppression.first_per_pair(rows, "a", "b", "place")


def _loop_pairs(spark, sf_dir):
    a, b = F.col("l_partkey") % 500, F.col("l_suppkey") * 17 % 500
    return source(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 8).alias("seq_id"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), F.col("l_extendedprice").alias("score")
    ).filter("j - i > 10").groupBy("seq_id", "i", "j").agg(F.max("score").alias("score"))


_LOOPS = """
    pr AS (SELECT seq_id, i, j, max(score) AS score FROM (SELECT l_orderkey % 8 AS seq_id, least(l_partkey % 500, l_suppkey * 17 % 500) AS i,
        greatest(l_partkey % 500, l_suppkey * 17 % 500) AS j, l_extendedprice AS score FROM lineitem) WHERE j - i > 10 GROUP BY seq_id, i, j)"""


@query("loop_pair_suppression", "W12", f"""WITH RECURSIVE {_LOOPS},
    tp AS (SELECT seq_id, max(j) AS top FROM pr GROUP BY seq_id),
    s AS (SELECT seq_id, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS score FROM tp
        UNION ALL
        SELECT seq_id, list_concat(taken, list_concat(range(greatest(0, i - 25), least(i + 25, j - 1) + 1), range(greatest(i + 1, j - 25), least(j + 25, top) + 1))), i, j, score FROM (
            SELECT s.seq_id, s.taken, tp.top, p.i, p.j, p.score, row_number() OVER (PARTITION BY s.seq_id ORDER BY p.score DESC, p.i, p.j) AS k
            FROM s JOIN tp USING (seq_id) JOIN pr p ON p.seq_id = s.seq_id WHERE NOT list_contains(s.taken, p.i) AND NOT list_contains(s.taken, p.j)) WHERE k = 1)
    SELECT seq_id, j AS later, i AS earlier, score FROM s WHERE i IS NOT NULL""")
def loop_pair_suppression(spark, sf_dir):
    return suppression.suppress_loop_pairs(_loop_pairs(spark, sf_dir), "seq_id", 25)


@query("edge_thinning", "W13", f"""WITH RECURSIVE {_LOOPS},
    ed AS (SELECT seq_id, i, j, score / 60.0e0 AS flow FROM pr WHERE j - i >= 30 AND score / 60.0e0 < 1000),
    s AS (SELECT DISTINCT seq_id, j, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS flow FROM ed
        UNION ALL
        SELECT seq_id, j, list_append(taken, i), i, flow FROM (
            SELECT s.seq_id, s.j, s.taken, e.i, e.flow, row_number() OVER (PARTITION BY s.seq_id, s.j ORDER BY e.flow, e.i) AS k
            FROM s JOIN ed e ON e.seq_id = s.seq_id AND e.j = s.j WHERE coalesce(list_min([abs(t - e.i) for t in s.taken]), 99) > 5) WHERE k = 1)
    SELECT seq_id, i, j, flow FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY flow, i, j) AS place FROM s WHERE i IS NOT NULL) WHERE place <= 200""")
def edge_thinning(spark, sf_dir):
    pairs = _loop_pairs(spark, sf_dir).select("seq_id", "i", "j", (F.col("score") / 60.0).alias("flow"))
    return suppression.thin_edges(pairs, "seq_id", 5, 200)


@query("frame_order_validity", "W16", with_views("frames", """
    WITH d AS (SELECT flight_id, frame_id - lag(frame_id) OVER w AS df, time_s - lag(time_s) OVER w AS dt,
        frame_id FROM frames WINDOW w AS (PARTITION BY flight_id ORDER BY frame_id))
    SELECT flight_id, bool_and(coalesce(df > 0, true) AND coalesce(dt > 0, true)) AS strictly_ordered,
        count(DISTINCT frame_id) = count(*) AS no_duplicates, count(*) FILTER (frame_id % 97 = 0) AS unsafe_names FROM d GROUP BY flight_id"""))
def frame_order_validity(spark, sf_dir):
    from ..scale import lag, ordered

    k = F.col("frame_id")
    named = view(spark, sf_dir, "frames").withColumn(
        "image_name", F.concat(F.when(k % 97 == 0, "../").otherwise(""), F.lit("frame_"), k.cast("string"), F.lit(".jpg"))
    )
    d = ordered(named, ["flight_id"], ["frame_id", "time_s"], {"_p": lag(F.struct("frame_id", "time_s"))})
    p = F.col("_p")
    up = F.coalesce((k > p["frame_id"]) & (F.col("time_s") > p["time_s"]), F.lit(True))
    return d.groupBy("flight_id").agg(
        F.every(up).alias("strictly_ordered"),
        # sorted by frame, a duplicate is equal to its predecessor
        F.every(F.coalesce(k != p["frame_id"], F.lit(True))).alias("no_duplicates"),
        F.count_if(F.col("image_name").contains("/")).alias("unsafe_names"),
    )


@query("best_loops", "W17", """
    SELECT l_orderkey AS loop_id, l_linenumber AS line, l_partkey AS a, l_suppkey AS b, l_extendedprice AS score FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def best_loops(spark, sf_dir):
    return source(spark, sf_dir, "lineitem").orderBy(
        F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    ).limit(10).select(
        F.col("l_orderkey").alias("loop_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("a"),
        F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("score"),
    )


@query("smoothed_positions", "W15", with_views("poses", """
    WITH ix AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_id) - 1 AS idx, count(*) OVER (PARTITION BY seq_id) AS n FROM poses),
    ker AS (SELECT CAST(o AS BIGINT) AS o, w / sum(w) OVER () AS w FROM (SELECT o, exp(-(o - 4) * (o - 4) / (2 * 1.7e0 * 1.7e0)) AS w FROM range(9) t(o))),
    src AS (SELECT a.seq_id, a.frame_id, a.idx, w, CASE WHEN a.idx + o - 4 < 0 THEN -(a.idx + o - 4) WHEN a.idx + o - 4 > a.n - 1
        THEN 2 * (a.n - 1) - (a.idx + o - 4) ELSE a.idx + o - 4 END AS s FROM ix a, ker WHERE a.n >= 9)
    SELECT src.seq_id, src.frame_id, round(sum(w * b.tx), 6) AS tx, round(sum(w * b.ty), 6) AS ty, round(sum(w * b.tz), 6) AS tz
    FROM src JOIN ix b ON b.seq_id = src.seq_id AND b.idx = src.s GROUP BY src.seq_id, src.frame_id"""))
def smoothed_positions(spark, sf_dir):
    placed = ops.indexed(view(spark, sf_dir, "poses"), ["seq_id"], ["frame_id"])
    out = ops.smooth(placed, ["seq_id"], ["tx", "ty", "tz"], 9).join(
        placed.select("seq_id", "idx", "frame_id"), ["seq_id", "idx"]
    )
    return r(out.drop("idx"), "tx ty tz")
