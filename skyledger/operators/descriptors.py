"""Descriptor matching, loop search, reference views and feature colours."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..scale import Quantile, grouped
from ..session import cut_lineage
from .metric_index import Measure, similar_pairs


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def normalised(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda e: e / length)


def mutual_matches(keypoints: DataFrame, pairs: DataFrame, ratio: float = 0.75, least: int = 8) -> DataFrame:
    """Reciprocal nearest descriptors of image pairs that pass the ratio test both ways.

    ``keypoints`` (image_id, kp, d) hold at most the detector's feature cap per image, so the
    comparisons of one pair are bounded; work grows with the number of pairs. Pairs with
    fewer than ``least`` descriptors or matches give none.
    """
    counts = keypoints.groupBy("image_id").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= least)
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("image_id").alias(side)), side, "left_semi")
    left = keypoints.select(F.col("image_id").alias("a"), F.col("kp").alias("i"), F.col("d").alias("_da"))
    right = keypoints.select(F.col("image_id").alias("b"), F.col("kp").alias("j"), F.col("d").alias("_db"))
    gap = F.zip_with("_da", "_db", lambda x, y: (x - y) * (x - y))
    scored = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "i", "j", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("dist")
    )

    def best(side: str, other: str) -> DataFrame:
        two = F.array_sort(F.collect_list(F.struct("dist", other)))  # one descriptor's row of the pair
        ranked = scored.groupBy("a", "b", side).agg(two.alias("_t")).filter(F.size("_t") >= 2)
        passed = ranked.filter(F.col("_t")[0]["dist"] < ratio * F.col("_t")[1]["dist"])
        return passed.select("a", "b", side, F.col("_t")[0][other].alias(other), F.col("_t")[0]["dist"].alias(f"dist_{side}"))

    both = best("i", "j").join(best("j", "i"), ["a", "b", "i", "j"]).select("a", "b", "i", "j", F.col("dist_i").alias("dist"))
    enough = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("a", "b")
    return both.join(enough, ["a", "b"], "left_semi")


def loop_closures(
    frames: DataFrame, seq: str, top_k: int = 5, threshold: float = 0.85, apart: int = 10, measure: Measure | None = None
) -> DataFrame:
    """Top-k similar frames per frame above ``threshold`` and more than ``apart`` positions away.

    Equal vectors are folded to one row that keeps its top_k + 1 lowest positions, all that any
    list can use; the different ones are joined over a partition around pivots, which loses no pair.
    """
    unit = frames.select(seq, "idx", normalised(F.col("d")).alias("d"))
    keyed = unit.withColumn("_h", F.xxhash64("d"))
    low = W.partitionBy(seq, "_h", "d").orderBy("idx")
    few = keyed.withColumn("_r", F.row_number().over(low)).filter(F.col("_r") <= top_k + 1)
    folded = few.groupBy(seq, "_h", "d").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    folded = cut_lineage(folded.withColumn("id", F.col("ids")[0]))  # a position has one vector, so it names it
    met = cut_lineage(similar_pairs(folded, [seq], "id", "d", threshold, measure))
    both = met.unionByName(met.select(seq, F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    itself = folded.filter(dot(F.col("d"), F.col("d")) > threshold).select(seq, F.col("id").alias("a"), F.col("id").alias("b"), dot(F.col("d"), F.col("d")).alias("score"))
    both = cut_lineage(both.unionByName(itself))
    each = both.join(folded.select(seq, F.col("id").alias("b"), "ids"), [seq, "b"]).select(seq, "a", "score", F.explode("ids").alias("other"))
    place = F.row_number().over(W.partitionBy(seq, "a").orderBy(F.col("score").desc(), "other"))
    lists = each.withColumn("_r", place).filter(F.col("_r") <= top_k + 1).groupBy(seq, "a").agg(
        F.array_sort(F.collect_list(F.struct("_r", "score", "other"))).alias("_l")
    )
    # the frame itself leaves its list, which then holds the best top_k others
    named = keyed.select(seq, "idx", "_h", "d").join(folded.select(seq, "_h", "d", F.col("id").alias("a")), [seq, "_h", "d"]).select(seq, "idx", "a")
    mine = named.join(lists, [seq, "a"]).withColumn("_o", F.slice(F.filter("_l", lambda x: x["other"] != F.col("idx")), 1, top_k))
    pairs = mine.select(seq, "idx", F.explode("_o").alias("_x")).select(
        seq, F.least("idx", F.col("_x.other")).alias("i"), F.greatest("idx", F.col("_x.other")).alias("j"), F.col("_x.score").alias("score")
    )
    return pairs.filter(F.col("j") - F.col("i") > apart).groupBy(seq, "i", "j").agg(F.max("score").alias("score"))


def reference_views(views: DataFrame, by: list[str], size: int, strategy: str) -> DataFrame:
    """One view per window: first, middle, balanced, or widest similarity range."""
    if strategy == "first":
        return views.groupBy(*by).agg(F.min("idx").alias("idx"))
    if strategy == "middle":
        sizes = views.groupBy(*by).agg(F.floor(F.count(F.lit(1)) / 2).alias("_mid"))
        w = W.partitionBy(*by).orderBy("idx")  # a window holds a bounded number of frames
        placed = views.select(*by, "idx").withColumn("_p", F.row_number().over(w) - 1)
        return placed.join(sizes, by).filter("_p = _mid").select(*by, "idx")
    unit = views.select(*by, "idx", "d", F.sqrt(dot(F.col("d"), F.col("d"))).alias("_norm")).withColumn(
        "_u", F.transform("d", lambda e: e / F.col("_norm"))
    )
    if strategy == "balanced":
        # the mean similarity to the others needs only the sum of the unit vectors
        total = unit.groupBy(*by).agg(F.count(F.lit(1)).alias("_s"), F.array(*[F.sum(F.col("_u")[i]) for i in range(size)]).alias("_t"))
        mean = F.aggregate("_u", F.lit(0.0), lambda s, v: s + v) / size
        var = (dot(F.col("_u"), F.col("_u")) - size * mean * mean) / (size - 1)
        scored = unit.join(total, by).select(
            *by, "idx", ((dot(F.col("_u"), F.col("_t")) - 1.0) / (F.col("_s") - 1)).alias("sim"), F.col("_norm").alias("norm"), var.alias("var")
        )
        spans = scored.groupBy(*by).agg(*[f(m).alias(f"_{n}_{m}") for m in ("sim", "norm", "var") for n, f in (("lo", F.min), ("hi", F.max))])
        off = sum(
            (F.abs((F.col(m) - F.col(f"_lo_{m}")) / (F.col(f"_hi_{m}") - F.col(f"_lo_{m}") + 1e-8) - 0.5) for m in ("sim", "norm", "var")), F.lit(0.0)
        )
        off = F.floor(off * 1e9 + 0.5)  # sums in another order must not decide a tie
        return scored.join(spans, by).groupBy(*by).agg(F.min_by("idx", F.struct(off, "idx")).alias("idx"))
    # similarity range: the frames of one window are bounded by the window plan
    other = unit.select(*by, F.col("idx").alias("_j"), F.col("_u").alias("_v"))
    sims = unit.join(other, by).withColumn("_sim", F.when(F.col("idx") == F.col("_j"), 0.0).otherwise(dot(F.col("_u"), F.col("_v"))))
    ranges = sims.groupBy(*by, "idx").agg((F.max("_sim") - F.min("_sim")).alias("range"))
    wide = F.floor(F.col("range") * 1e9 + 0.5)
    return ranges.groupBy(*by).agg(F.min_by("idx", F.struct(-wide, "idx")).alias("idx"))


def feature_colours(features: DataFrame, item: str, column: str) -> DataFrame:
    """First three principal components, clipped to their 10-90 percentiles and scaled to 0-1.

    A component's sign is set so that its mean cube over the data is not negative.
    """
    vectors = features.select(item, array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(vectors).transform(vectors)
    scored = PCA(k=3, inputCol="_c", outputCol="_p").fit(centred).transform(centred).select(item, vector_to_array("_p").alias("_p"))
    axes = scored.select(item, F.lit(1).alias("_all"), *[F.col("_p")[i].alias(f"p{i}") for i in range(3)])
    signs = axes.groupBy("_all").agg(*[F.when(F.avg(F.pow(f"p{i}", F.lit(3))) < 0, -1.0).otherwise(1.0).alias(f"_s{i}") for i in range(3)])
    axes = axes.join(F.broadcast(signs), "_all")  # one row of signs
    axes = axes.select(item, "_all", *[(F.col(f"p{i}") * F.col(f"_s{i}")).alias(f"p{i}") for i in range(3)])
    spans = grouped(axes, ["_all"], [], [Quantile(f"_{n}{i}", F.col(f"p{i}"), q) for i in range(3) for n, q in (("lo", 0.1), ("hi", 0.9))])
    clipped = axes.join(F.broadcast(spans), "_all")  # one row of limits
    return clipped.select(item, *[
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"p{i}") - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}")))).alias(c)
        for i, c in enumerate(("red", "green", "blue"))
    ])
