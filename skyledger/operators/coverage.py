"""Greedy coverage, visual support, bridge selection, and cross-view depth consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import camera
from ..scale import last_known, next_known, ordered
from ..session import cut_lineage


def coverage_needs(seen: DataFrame, by: list[str], min_views: int) -> DataFrame:
    """Wanted number of chosen views per ground cell: what is available, at most ``min_views``."""
    return seen.groupBy(*by, "cell").agg(F.least(F.count(F.lit(1)), F.lit(min_views)).alias("need"))


def best_view(seen: DataFrame, needs: DataFrame, by: list[str]) -> DataFrame:
    """The view that adds most under-served cells per site; ties go to the lowest view."""
    gains = seen.join(needs.filter("need > 0"), [*by, "cell"], "left").groupBy(*by, "view_id").agg(F.count("need").alias("gain"))
    return gains.groupBy(*by).agg(F.min_by(F.struct("view_id", "gain"), F.struct(-F.col("gain"), "view_id")).alias("_b")).select(*by, "_b.*")


def greedy_coverage(seen: DataFrame, by: list[str], target: int, min_views: int = 6) -> tuple[DataFrame, DataFrame]:
    """(chosen views in order, per-site report). All sites advance together, one view per round."""
    left = cut_lineage(seen.select(*by, "view_id", "cell").distinct())
    wanted = cut_lineage(coverage_needs(left, by, min_views))
    needs = wanted
    chosen = None
    for step in range(target):
        pick = cut_lineage(best_view(left, needs, by).withColumn("step", F.lit(step)))
        if pick.isEmpty():
            break
        chosen = pick if chosen is None else chosen.unionByName(pick)
        served = left.join(pick.select(*by, "view_id"), [*by, "view_id"], "left_semi").select(*by, "cell", F.lit(1).alias("_hit"))
        needs = cut_lineage(needs.join(served, [*by, "cell"], "left").withColumn("need", F.col("need") - F.coalesce("_hit", F.lit(0))).drop("_hit"))
        left = cut_lineage(left.join(pick.select(*by, "view_id"), [*by, "view_id"], "left_anti"))
    got = needs.join(wanted.withColumnRenamed("need", "_full"), [*by, "cell"])
    report = got.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ground_cells"), (100.0 * F.avg(F.when(F.col("need") <= 0, 1.0).otherwise(0.0))).alias("met_percent"),
        (100.0 * F.avg(F.when(F.col("need") < F.col("_full"), 1.0).otherwise(0.0))).alias("any_percent"),
    )
    return chosen, report


def visual_support(candidates: DataFrame, pairs: DataFrame, by: str) -> DataFrame:
    """Candidates with ``supported``: selected, or verified against an adjacent selected one."""
    pick = F.when(F.col("selected"), F.col("idx"))
    near = ordered(candidates, [by], ["idx"], {"_before": last_known(pick), "_after": next_known(pick)})
    links = pairs.filter("verified").select(
        by, F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")
    ).distinct().withColumn("_ok", F.lit(True))
    out = near
    for name, other in (("_by_before", "_before"), ("_by_after", "_after")):
        hit = links.withColumnRenamed("_ok", name)
        out = out.withColumn("_lo", F.least("idx", other)).withColumn("_hi", F.greatest("idx", other)).join(hit, [by, "_lo", "_hi"], "left").drop("_lo", "_hi")
    ok = F.col("selected") | F.coalesce("_by_before", F.lit(False)) | F.coalesce("_by_after", F.lit(False))
    return out.withColumn("supported", ok).drop("_before", "_after", "_by_before", "_by_after")


#: A pick may lie up to two frames before the frame that asked for it.
BACK = 2


def _jumps(candidates: DataFrame, pairs: DataFrame, by: str, motion: float, path_m: float, time_s: float) -> DataFrame:
    """Where the selection goes from every state (anchor, lag): next anchor and lag, and why.

    In a state the frame ``anchor`` was picked last and the frames up to ``anchor + lag`` are
    behind. What comes next depends on the anchor's own links only: the first frame beyond
    whose link is not verified, or the first before that with enough motion, path or time.
    """
    frame = candidates.select(by, "idx", "time_s", "path_m", "sharpness")
    low = lambda c: frame.select(by, F.col("idx").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("time_s", "path_m", "sharpness")])
    links = pairs.filter("verified").select(
        by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("i"), F.coalesce("motion", F.lit(0.0)).alias("motion")
    ).filter("a < i").groupBy(by, "a", "i").agg(F.max("motion").alias("motion"))
    links = links.join(low("a"), [by, "a"]).join(low("i"), [by, "i"])
    reason = (
        F.when(F.col("motion") >= motion, "visual_motion")
        .when(F.col("path_m_i") - F.col("path_m_a") >= path_m, "trajectory_gap")
        .when(F.col("time_s_i") - F.col("time_s_a") >= time_s, "temporal_guard")
    )
    # Weights of the frames that a request at i may pick: i and the BACK frames before it.
    worth = F.transform(
        F.sequence(F.lit(0), F.lit(BACK)),
        lambda k: F.col("sharpness_i") * (0.85 + 0.15 * (F.col("i") - F.col("a")) / (F.col("i") - F.col("a") + k)),
    )
    links = links.select(by, "a", "i", reason.alias("reason"), worth.alias("worth"))
    lagged = links.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(BACK)))).filter("i > a + lag")
    state = W.partitionBy(by, "a", "lag").orderBy("i")
    # Verified without a hole since the state began.
    run = lagged.withColumn("_n", F.row_number().over(state)).filter("i = a + lag + _n")
    ends = run.groupBy(by, "a", "lag").agg(
        F.max("i").alias("last"), F.min(F.when(F.col("reason").isNotNull(), F.col("i"))).alias("ask"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("i"))).alias("why"),
    )
    asked = ends.filter("ask is not null").select(by, "a", "lag", "ask", "why")
    near = asked.join(links.select(by, "a", "i", "worth"), [by, "a"]).filter(F.col("i").between(F.col("ask") - BACK, F.col("ask")))
    value = F.element_at("worth", (F.col("ask") - F.col("i") + 1).cast("int"))
    best = near.groupBy(by, "a", "lag", "ask").agg(F.first("why").alias("why"), F.min_by("i", F.struct(-value, "i")).alias("to"))
    sizes = candidates.groupBy(by).agg((F.max("idx") + 1).alias("n"))
    states = frame.select(by, F.col("idx").alias("a")).withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(BACK))))
    states = states.join(sizes, by).join(ends.select(by, "a", "lag", "last"), [by, "a", "lag"], "left").join(
        best, [by, "a", "lag"], "left"
    )
    kept = F.coalesce("last", F.col("a") + F.col("lag"))  # the last frame that still holds on to the anchor
    lost = kept + 1 < F.col("n")
    step = F.when(
        F.col("to").isNotNull(), F.struct(F.col("to").alias("to"), (F.col("ask") - F.col("to")).cast("int").alias("to_lag"), F.col("why").alias("reason"))
    ).when(
        lost & (kept > F.col("a")), F.struct(kept.alias("to"), F.lit(0).alias("to_lag"), F.lit("bridge_before_overlap_loss").alias("reason"))
    ).when(lost, F.struct((F.col("a") + 1).alias("to"), F.lit(0).alias("to_lag"), F.lit("unresolved_visual_break").alias("reason")))
    return states.select(by, "a", "lag", step.alias("s")).filter("s is not null").select(by, "a", "lag", "s.*")


def bridge_selection(
    candidates: DataFrame, pairs: DataFrame, by: str, motion: float = 0.06, path_m: float = 16.25, time_s: float = 4.0
) -> DataFrame:
    """Frames that keep verified links: last good bridge before a loss, real breaks kept as breaks.

    ``idx`` counts a clip's frames from 0; a missing pair counts as unverified. Every state's
    next pick is worked out on its own, and the chain from a clip's start is followed by
    doubling, so a clip of any length takes a logarithmic number of joins and no task holds it.
    """
    pairs = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])  # its own columns, also when both come from one table
    jumps = cut_lineage(_jumps(candidates, pairs, by, motion, path_m, time_s))
    reached = cut_lineage(candidates.groupBy(by).agg(F.min("idx").alias("a")).withColumn("lag", F.lit(0)))
    leap = jumps.select(by, "a", "lag", "to", "to_lag")
    while True:
        ahead = reached.join(leap, [by, "a", "lag"]).select(by, F.col("to").alias("a"), F.col("to_lag").alias("lag"))
        more = cut_lineage(reached.unionByName(ahead).distinct())
        if more.count() == reached.count():
            break
        reached = more
        onward = leap.select(by, F.col("a").alias("to"), F.col("lag").alias("to_lag"), F.col("to").alias("_to"), F.col("to_lag").alias("_lag"))
        leap = cut_lineage(leap.join(onward, [by, "to", "to_lag"]).select(by, "a", "lag", F.col("_to").alias("to"), F.col("_lag").alias("to_lag")))
    picks = reached.join(jumps, [by, "a", "lag"]).select(by, F.col("to").alias("idx"), "reason")
    start = candidates.groupBy(by).agg(F.min("idx").alias("idx")).withColumn("reason", F.lit("start"))
    picks = cut_lineage(start.unionByName(picks))
    ends = candidates.groupBy(by).agg(F.max("idx").alias("idx"))
    rest = ends.join(picks.select(by, "idx"), [by, "idx"], "left_anti").withColumn("reason", F.lit("end"))
    return picks.unionByName(rest)


def consistent_points(world: DataFrame, views: DataFrame, fx: float, fy: float, cx: float, cy: float, size: int, limit: float, least: int) -> DataFrame:
    """Reference pixels whose world point agrees with enough source views, averaged with them.

    ``world`` has one world point per pixel of every frame; ``views`` lists the source frames
    of each reference frame with their world-to-camera pose. The source point is read
    bilinearly; pixels outside the image add zero.
    """
    q = [F.col(f"q{c}") for c in "wxyz"]
    back, origin = camera.invert_rigid(camera.rotation(*q), [F.col(f"t{c}") for c in "xyz"])
    pu, pv, pz = camera.project([F.col(c) for c in "xyz"], back, origin, fx, fy, cx, cy)
    seen = world.select("frame_id", "pixel", "x", "y", "z").join(views, "frame_id").select(
        "frame_id", "pixel", "source_id", "x", "y", "z", pu.alias("pu"), pv.alias("pv"), pz.alias("pz")
    ).filter("pz > 0")
    c, r = F.floor("pu"), F.floor("pv")
    tx, ty = F.col("pu") - c, F.col("pv") - r
    asked = seen.select("frame_id", "pixel", "source_id", "x", "y", "z", c.alias("u"), r.alias("v"), tx.alias("_tx"), ty.alias("_ty"))
    asked = asked.filter(F.col("u").between(-1, size - 1) & F.col("v").between(-1, size - 1))
    # Every source point is told to the four squares it is a corner of, so a pixel asks for one square instead of four points.
    at = [(i, j) for i in (0, 1) for j in (0, 1)]
    held = world.filter(F.col("u").between(0, size - 1) & F.col("v").between(0, size - 1))
    told = held.select(F.col("frame_id").alias("source_id"), "x", "y", "z", F.explode(F.array(*[
        F.struct((F.col("u") - i).alias("u"), (F.col("v") - j).alias("v"), F.lit(2 * i + j).alias("k")) for i, j in at
    ])).alias("_s")).select("source_id", "_s.*", "x", "y", "z")
    squares = told.groupBy("source_id", "u", "v").agg(*[
        F.sum(F.when(F.col("k") == 2 * i + j, F.col(a))).alias(f"_{a}{i}{j}") for i, j in at for a in "xyz"
    ])
    w = {(i, j): (F.col("_tx") if i else 1 - F.col("_tx")) * (F.col("_ty") if j else 1 - F.col("_ty")) for i, j in at}
    mixed = lambda a: sum((F.coalesce(w[k] * F.col(f"_{a}{k[0]}{k[1]}"), F.lit(0.0)) for k in at), F.lit(0.0))
    got = asked.join(squares, ["source_id", "u", "v"]).select("frame_id", "pixel", "source_id", "x", "y", "z", *[mixed(a).alias(f"s{a}") for a in "xyz"])
    d = [F.col(f"s{a}") - F.col(a) for a in "xyz"]
    agree = got.filter(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) < limit)
    out = agree.groupBy("frame_id", "pixel", "x", "y", "z").agg(F.count(F.lit(1)).alias("views"), *[F.sum(f"s{a}").alias(f"_{a}") for a in "xyz"])
    mean = [((F.col(a) + F.col(f"_{a}")) / (F.col("views") + 1)).alias(f"mean_{a}") for a in "xyz"]
    return out.filter(F.col("views") >= least).select("frame_id", "pixel", "views", *mean)
