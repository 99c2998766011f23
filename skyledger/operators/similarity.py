"""Similarity fits from distributed moments, robust rounds, prefix products and pose errors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..functions import camera
from ..scale import Quantile, grouped, ordered, rank
from ..session import cut_lineage

AXES = ("x", "y", "z")
FIT = "struct<ok:boolean,s:double,r:array<double>,t:array<double>>"


def moments(pairs: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted sums that fix a similarity from ``*_a`` (source) to ``*_b`` (target).

    Coordinates are taken from each group's mean first, so that large offsets do not cancel.
    Both passes are map-side combined, so a hot group costs no more than another.
    """
    w = F.lit(1.0) if weight is None else F.greatest(weight, F.lit(1e-9))
    pairs = pairs.withColumn("_w", w)
    middle = pairs.groupBy(*by).agg(
        F.sum("_w").alias("sw"), F.count(F.lit(1)).alias("n"),
        *[(F.sum(F.col("_w") * F.col(f"{a}_{s}")) / F.sum("_w")).alias(f"m{a}{s}") for s in "ab" for a in AXES],
    )
    c = {(a, s): F.col(f"{a}_{s}") - F.col(f"m{a}{s}") for s in "ab" for a in AXES}
    sums = pairs.join(middle, by).groupBy(*by).agg(
        *[F.sum(F.col("_w") * c[(p, "b")] * c[(q, "a")]).alias(f"c{p}{q}") for p in AXES for q in AXES],
        *[F.sum(F.col("_w") * sum((c[(a, s)] * c[(a, s)] for a in AXES), F.lit(0.0))).alias(f"v{s}") for s in "ab"],
    )
    return middle.join(sums, by)


def fit_column(mode: str = "umeyama") -> Column:
    """(ok, s, R, t) of one row of moments; ``mode`` picks the scale: umeyama, rms or rigid."""
    names = ["sw", *[f"m{a}{s}" for s in "ab" for a in AXES], *[f"c{p}{q}" for p in AXES for q in AXES], "va", "vb"]

    @F.pandas_udf(FIT)
    def solve(m: pd.DataFrame) -> pd.DataFrame:
        v = m.to_numpy(dtype=float)
        sw, ma, mb = v[:, 0], v[:, 1:4], v[:, 4:7]
        cov = v[:, 7:16].reshape(-1, 3, 3) / sw[:, None, None]
        va, vb = v[:, 16] / sw, v[:, 17] / sw
        good = np.isfinite(cov).all(axis=(1, 2)) & (va > 1e-12)
        u, d, vt = np.linalg.svd(np.where(good[:, None, None], cov, np.eye(3)))
        turn = np.ones((len(v), 3))
        turn[:, 2] = np.sign(np.linalg.det(u @ vt))
        r = (u * turn[:, None, :]) @ vt
        if mode == "rigid":
            s = np.ones(len(v))
        elif mode == "rms":
            s = np.sqrt(np.divide(vb, va, out=np.full(len(v), np.nan), where=va > 0))
        else:
            s = np.divide((d * turn).sum(axis=1), va, out=np.full(len(v), np.nan), where=va > 0)
        # a rank below two leaves the rotation open
        good &= np.isfinite(s) & (s > 0) & (d[:, 1] > 1e-9 * np.maximum(d[:, 0], 1e-300))
        t = mb - s[:, None] * np.einsum("nij,nj->ni", r, ma)
        return pd.DataFrame({"ok": good, "s": s, "r": list(r.reshape(-1, 9)), "t": list(t)})

    return solve(F.struct(*names))


def fit(pairs: DataFrame, by: list[str], weight: Column | None = None, mode: str = "umeyama") -> DataFrame:
    """One transform per group, as ``fit`` struct with the pair count ``n``."""
    return moments(pairs, by, weight).select(*by, "n", fit_column(mode).alias("fit"))


def moved(fit_name: str = "fit") -> list[Column]:
    """Source point of a row carried by its group's transform."""
    f = F.col(fit_name)
    m = [[f["r"][3 * i + j] for j in range(3)] for i in range(3)]
    return camera.apply_similarity(f["s"], m, [f["t"][i] for i in range(3)], [F.col(f"{a}_a") for a in AXES])


def residual(fit_name: str = "fit") -> Column:
    d = [p - F.col(f"{a}_b") for p, a in zip(moved(fit_name), AXES)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def trimmed_fit(pairs: DataFrame, by: list[str], rounds: int = 5, least: int = 30) -> DataFrame:
    """Refit on pairs within median + 3 scaled MAD, at most ``rounds`` times, then judge the fit."""
    state = cut_lineage(pairs.withColumn("_keep", F.lit(True)))
    for _ in range(rounds):
        fits = fit(state.filter("_keep"), by, F.col("weight")).drop("n")
        scored = cut_lineage(state.join(fits, by).withColumn("_res", residual()).drop("fit"))
        kept = scored.filter("_keep")
        middle = grouped(kept, by, [], [Quantile("_med", F.col("_res"), 0.5)])
        spread = grouped(kept.join(middle, by), by, [], [Quantile("_mad", F.abs(F.col("_res") - F.col("_med")), 0.5)])
        cutoff = F.col("_med") + F.greatest(3.0 * 1.4826 * F.col("_mad"), F.lit(1e-6))
        limits = middle.join(spread, by).select(*by, cutoff.alias("_cut"))
        fresh = scored.join(limits, by).withColumn("_new", F.col("_res") <= F.col("_cut"))
        counts = fresh.groupBy(*by).agg(F.count_if("_new").alias("_n"))
        # a group whose trimmed set gets too small keeps the set it had
        state = cut_lineage(fresh.join(counts, by).withColumn(
            "_keep", F.when(F.col("_n") < least, F.col("_keep")).otherwise(F.col("_new"))
        ).drop("_res", "_cut", "_new", "_n"))
    final = fit(state.filter("_keep"), by, F.col("weight"))
    scored = state.filter("_keep").join(final, by).withColumn("_res", residual())
    size = F.sqrt(sum((F.col(f"{a}_b") * F.col(f"{a}_b") for a in AXES), F.lit(0.0)))
    errors = grouped(scored, by, [F.count(F.lit(1)).alias("inliers")], [Quantile("median_error", F.col("_res"), 0.5), Quantile("_size", size, 0.5)])
    totals = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("correspondences"))
    out = final.drop("n").join(errors, by).join(totals, by)
    relative = F.col("median_error") / F.greatest("_size", F.lit(1e-6))
    scale = F.col("fit.s")
    trusted = F.col("fit.ok") & scale.between(0.02, 50.0) & (relative <= 0.35) & (F.col("correspondences") >= least)
    return out.withColumn("relative_error", relative).withColumn("trusted", F.coalesce(trusted, F.lit(False))).drop("_size")


def huber_fit(pairs: DataFrame, by: list[str], delta: float, rounds: int = 5) -> DataFrame:
    """Iteratively reweighted fit; residuals beyond ``delta`` count in inverse proportion."""
    base = cut_lineage(pairs)
    fits = cut_lineage(fit(base, by, F.col("weight")))
    for _ in range(rounds):
        res = residual()
        bend = F.when(res > delta, delta / res).otherwise(1.0)
        weighted = base.join(fits.drop("n"), by).withColumn("weight", F.col("weight") * bend).drop("fit")
        fits = cut_lineage(fit(weighted, by, F.col("weight")))
    return fits


def quantile_fit(pairs: DataFrame, by: list[str], share: float = 0.7, rounds: int = 8) -> DataFrame:
    """Refit on the best-fitting share of the pairs, a fixed number of times."""
    base = cut_lineage(pairs)
    fits = cut_lineage(fit(base, by))
    for _ in range(rounds):
        scored = base.join(fits.drop("n"), by).withColumn("_res", residual()).drop("fit")
        limits = grouped(scored, by, [], [Quantile("_cut", F.col("_res"), share)])
        fits = cut_lineage(fit(scored.join(limits, by).filter("_res <= _cut"), by))
    return fits


#: Groups of up to so many pairs have at most 256 triples, and all of them are tried.
FEW_PAIRS = 12


def _triples(sizes: DataFrame, by: list[str], subsets: int) -> DataFrame:
    """(by, subset, _r): rank triples out of 1..n per group, all of them for few pairs, else seeded draws of distinct ones."""
    n = F.col("n")
    one = lambda c: F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias(c)
    few = sizes.filter((n >= 3) & (n <= FEW_PAIRS))
    every = few.select(*by, "n", one("_i")).select(*by, "n", "_i", one("_j")).filter("_i < _j").select(*by, "_i", "_j", one("_k")).filter("_j < _k")
    every = every.withColumn("subset", (F.col("_i") * 256 + F.col("_j") * 16 + F.col("_k")).cast("bigint"))
    # More draws than wanted, so that enough stay when equal ones are dropped.
    drawn = sizes.filter(n > FEW_PAIRS).select(*by, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4 * subsets - 1).cast("bigint"))).alias("subset"))
    pick = lambda k, size: F.pmod(F.xxhash64(F.lit(26158), F.lit(k), "subset", *by), size) + 1
    drawn = drawn.withColumn("_i", pick(1, n)).withColumn("_j", pick(2, n - 1)).withColumn("_k", pick(3, n - 2))
    drawn = drawn.withColumn("_j", F.col("_j") + (F.col("_j") >= F.col("_i")).cast("bigint"))
    low, high = F.least("_i", "_j"), F.greatest("_i", "_j")
    drawn = drawn.withColumn("_k", F.col("_k") + (F.col("_k") >= low).cast("bigint"))
    drawn = drawn.withColumn("_k", F.col("_k") + (F.col("_k") >= high).cast("bigint"))
    distinct = drawn.groupBy(*by, F.array_sort(F.array("_i", "_j", "_k")).alias("_t")).agg(F.min("subset").alias("subset"))
    order = W.partitionBy(*by).orderBy("subset")
    kept = distinct.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= subsets)
    both = every.select(*by, "subset", F.array("_i", "_j", "_k").alias("_t")).unionByName(kept.select(*by, "subset", "_t"))
    return both.select(*by, "subset", F.explode("_t").alias("_r"))


def consensus_fit(pairs: DataFrame, by: list[str], item: str, threshold: float, subsets: int = 256) -> DataFrame:
    """Best of many three-point fits by inlier count, then error; refit on its inliers.

    Subsets are drawn from all pairs of a group; every candidate is scored on all pairs by one
    combined aggregate. ``inlier`` and ``inliers`` are judged under the final fit. A group
    without a candidate of three inliers has no consensus: no fit, and no inliers.
    """
    base = cut_lineage(pairs)
    coords = [f"{a}_{s}" for s in "ab" for a in AXES]
    seeded = base.select(*by, item, *coords, F.xxhash64(F.lit(7), item).alias("_h"))
    ranked = ordered(seeded, by, ["_h", item], {"_r": rank()})
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    triples = _triples(sizes, by, subsets).join(ranked, [*by, "_r"])
    candidates = cut_lineage(fit(triples, [*by, "subset"]).drop("n").filter("fit.ok"))
    res = residual()
    scores = base.join(candidates, by).groupBy(*by, "subset").agg(
        F.count_if(res <= threshold).alias("_in"), F.sqrt(F.avg(F.when(res <= threshold, res * res))).alias("_rmse")
    ).filter("_in >= 3")
    best = scores.groupBy(*by).agg(F.min_by("subset", F.struct(-F.col("_in"), "_rmse", "subset")).alias("subset"))
    chosen = candidates.join(best, [*by, "subset"]).drop("subset")
    near = base.join(chosen, by).filter(residual() <= threshold).drop("fit")
    final = cut_lineage(fit(near, by).drop("n"))
    judged = cut_lineage(base.join(final, by, "left").withColumn("inlier", F.coalesce(residual() <= threshold, F.lit(False))))
    counts = judged.groupBy(*by).agg(F.count_if("inlier").alias("inliers"))
    return judged.join(counts, by)


def consensus_report(flagged: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """One row per group of consensus_fit(): how many agree, how well, and whether that passes."""
    scored = flagged.withColumn("_res", F.when(F.col("inlier"), residual()))
    out = grouped(
        scored, by,
        [
            F.count(F.lit(1)).alias("control_points"), F.count_if("inlier").alias("inliers"), F.count_if(~F.col("inlier")).alias("outliers"),
            F.sqrt(F.avg(F.col("_res") * F.col("_res"))).alias("fit_rmse_m"), F.max("_res").alias("maximum_inlier_error_m"),
            (F.abs(F.first("fit")["s"] - 1.0) * 100.0).alias("scale_change_percent"),
        ],
        [Quantile("fit_median_error_m", F.col("_res"), 0.5)],
    )
    passes = (F.col("inliers") >= 3) & (F.col("maximum_inlier_error_m") <= threshold)
    return out.withColumn("passes_fit_gate", F.coalesce(passes, F.lit(False)))


def half_sample_fit(pairs: DataFrame, by: list[str], item: str, draws: int = 10) -> DataFrame:
    """Best of ``draws`` fits on hash-drawn halves, by the median error over all pairs."""
    number = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    halves = pairs.withColumn("draw", number).filter(F.pmod(F.xxhash64("draw", item), F.lit(2)) == 0)
    candidates = cut_lineage(fit(halves, [*by, "draw"]).drop("n").filter("fit.ok"))
    scored = pairs.join(candidates, by).withColumn("_res", residual())
    errors = grouped(scored, [*by, "draw"], [], [Quantile("_med", F.col("_res"), 0.5)])
    best = errors.groupBy(*by).agg(F.min_by("draw", F.struct("_med", "draw")).alias("draw"), F.min("_med").alias("median_error"))
    return candidates.join(best, [*by, "draw"]).drop("draw")


def least_squares_scale(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    bottom = F.sum(F.col(b) * F.col(b))
    return pairs.groupBy(*by).agg((F.sum(F.col(a) * F.col(b)) / F.greatest(bottom, F.lit(1e-12))).alias("scale"))


def weighted_quantile(rows: DataFrame, by: list[str], value: str, weight: str, q: float, order: list[str]) -> DataFrame:
    """Smallest value whose running weight reaches the share ``q`` of the group's weight."""
    from ..scale import running_sum

    totals = rows.groupBy(*by).agg(F.sum(weight).alias("_total"))
    upto = ordered(rows, by, [value, *order], {"_upto": running_sum(F.col(weight))})
    return upto.join(totals, by).filter(F.col("_upto") >= q * F.col("_total")).groupBy(*by).agg(F.min(value).alias("value"))


def sane_scale(scale: Column, valid: Column, least: int = 100) -> Column:
    """Fall back to one outside (0.1, 10) or on too little data."""
    return F.when((valid >= least) & (scale > 0.1) & (scale < 10.0), scale).otherwise(1.0)


# ---- running composition --------------------------------------------------------------------

POSE = ["qw", "qx", "qy", "qz", "tx", "ty", "tz", "s"]


def _turn(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    u, w = q[:, 1:], q[:, :1]
    return v + 2.0 * np.cross(u, np.cross(u, v) + w * v)


def _multiply(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    w = p[:, 0] * q[:, 0] - (p[:, 1:] * q[:, 1:]).sum(axis=1)
    v = p[:, :1] * q[:, 1:] + q[:, :1] * p[:, 1:] + np.cross(p[:, 1:], q[:, 1:])
    return np.column_stack([w, v])


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Transform a following transform b, row by row (columns of POSE)."""
    t = a[:, 7:8] * _turn(a[:, :4], b[:, 4:7]) + a[:, 4:7]
    return np.column_stack([_multiply(a[:, :4], b[:, :4]), t, a[:, 7] * b[:, 7]])


def _prefix(rows: np.ndarray) -> np.ndarray:
    """All running products; doubling steps, since composition is associative."""
    out, gap = rows.copy(), 1
    while gap < len(out):
        out = np.vstack([out[:gap], _after(out[:-gap], out[gap:])])
        gap *= 2
    return out


def prefix_products(steps: DataFrame, by: str, order: str, block: int = 4096) -> DataFrame:
    """Composition of all transforms up to each row of a sequence.

    Blocks of rows compose on their own; a short table of block products is composed per
    sequence and then applied, so one long sequence spreads over many tasks.
    """
    types = dict(steps.dtypes)
    placed = ordered(steps.select(by, order, *POSE), [by], [order], {"_rank": rank()})
    placed = cut_lineage(placed.withColumn("_block", F.floor((F.col("_rank") - 1) / block)).drop("_rank"))
    row_schema = f"{by} {types[by]}, {order} {types[order]}, _block bigint, " + ", ".join(f"{c} double" for c in POSE)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        pdf[POSE] = _prefix(pdf[POSE].to_numpy(dtype=float))
        return pdf[[by, order, "_block", *POSE]]

    local = cut_lineage(placed.groupBy(by, "_block").applyInPandas(inside, row_schema))
    ends = local.groupBy(by, "_block").agg(F.max_by(F.struct(*POSE), order).alias("_e")).select(by, "_block", "_e.*")
    lead_schema = f"{by} {types[by]}, _block bigint, " + ", ".join(f"_{c} double" for c in POSE)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ignore_index=True)
        out = pd.DataFrame(_prefix(pdf[POSE].to_numpy(dtype=float)), columns=[f"_{c}" for c in POSE])
        out.insert(0, "_block", pdf["_block"] + 1)  # a block's product leads the next block
        out.insert(0, by, pdf[by])
        return out

    leads = ends.groupBy(by).applyInPandas(across, lead_schema)
    joined = local.join(leads, [by, "_block"], "left")
    q, p = [F.col(c) for c in POSE[:4]], [F.col(f"_{c}") for c in POSE[:4]]
    turned = [
        p[0] * q[0] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3], p[0] * q[1] + p[1] * q[0] + p[2] * q[3] - p[3] * q[2],
        p[0] * q[2] - p[1] * q[3] + p[2] * q[0] + p[3] * q[1], p[0] * q[3] + p[1] * q[2] - p[2] * q[1] + p[3] * q[0],
    ]
    t = camera.apply_similarity(F.col("_s"), camera.rotation(*p), [F.col(f"_{c}") for c in POSE[4:7]], [F.col(c) for c in POSE[4:7]])
    whole = [*turned, *t, F.col("_s") * F.col("s")]
    return joined.select(by, order, *[F.coalesce(w, F.col(c)).alias(c) for w, c in zip(whole, POSE)])


# ---- pose error -----------------------------------------------------------------------------


def frame_sample(poses: DataFrame, by: str, item: str, most: int, seed: str = "43") -> DataFrame:
    """At most ``most`` frames per sequence by seeded hash: the benchmark's frame subset."""
    w = W.partitionBy(by).orderBy(F.md5(F.concat_ws("-", F.lit(seed), by, item)), item)
    return poses.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def frame_pairs(sampled: DataFrame, by: str, item: str) -> DataFrame:
    """All pairs i < j of an already sampled, and so bounded, set of frames."""
    fields = [c for c in sampled.columns if c != by]
    a = sampled.select(by, *[F.col(c).alias(f"{c}_i") for c in fields])
    b = sampled.select(by, *[F.col(c).alias(f"{c}_j") for c in fields])
    return a.join(b, by).filter(F.col(f"{item}_i") < F.col(f"{item}_j"))


def _relative(prefix: str) -> tuple[list[Column], list[Column]]:
    """Quaternion and translation of frame j seen from frame i."""
    a, b = [[F.col(f"{prefix}q{c}_{s}") for c in "wxyz"] for s in "ij"]
    q = [
        a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3], a[0] * b[1] - a[1] * b[0] - a[2] * b[3] + a[3] * b[2],
        a[0] * b[2] + a[1] * b[3] - a[2] * b[0] - a[3] * b[1], a[0] * b[3] - a[1] * b[2] + a[2] * b[1] - a[3] * b[0],
    ]
    d = [F.col(f"{prefix}t{c}_j") - F.col(f"{prefix}t{c}_i") for c in "xyz"]
    return q, camera.times(camera.transpose(camera.rotation(*a)), d)


def pair_errors(pairs: DataFrame) -> DataFrame:
    """Rotation and translation-direction error in degrees; direction sign is free."""
    (q, t), (p, u) = _relative(""), _relative("p_")
    dot = sum((a * b for a, b in zip(q, p)), F.lit(0.0))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2.0 * dot * dot - 1.0))))

    def unit(v):
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) + 1e-15
        return [c / n for c in v]

    along = sum((a * b for a, b in zip(unit(t), unit(u))), F.lit(0.0))
    loss = F.greatest(1.0 - along * along, F.lit(1e-15))
    shift = F.degrees(F.acos(F.sqrt(F.greatest(1.0 - loss, F.lit(0.0)))))
    return pairs.withColumn("rotation_deg", turn).withColumn("translation_deg", F.least(shift, F.abs(180.0 - shift))).withColumn(
        "error_deg", F.greatest("rotation_deg", "translation_deg")
    )


def accuracy_area(errors: DataFrame, by: list[str], thresholds: tuple[int, ...] = (3, 5, 15, 30)) -> DataFrame:
    """Area under the accuracy curve with one-degree bins; the last bin holds its upper border.

    The mean of the running shares weighs bin b by (T - b) / T, so no histogram is stored.
    """
    e = F.col("error_deg")
    areas = []
    for t in thresholds:
        bin_of = F.when(e == t, t - 1).otherwise(F.floor(e))
        areas.append(F.avg(F.when(e <= t, (t - bin_of) / t).otherwise(0.0)).alias(f"auc_{t}"))
    return errors.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), *areas)
