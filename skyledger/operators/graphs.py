"""Connected components by label rounds, mesh cleaning, and match-graph subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scale import Quantile, grouped
from ..session import cut_lineage
from .neighbors import nearest_distance


#: A node of more links than this and a ten-thousandth of all is hot; at most 20,000 nodes can be.
HOT_LINKS = 100_000


def _with_least(links: DataFrame, by: list[str], n_links: int) -> DataFrame:
    """Links (u, v) with ``m``, the least neighbour of u. Hot nodes are few enough to be broadcast, so their links stay in place."""
    key = [*by, "u"]
    least = cut_lineage(links.groupBy(*key).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_links")))
    bar = max(HOT_LINKS, n_links // 10_000)
    hot = least.filter(F.col("_links") > bar).drop("_links")
    if hot.isEmpty():
        return links.join(least.drop("_links"), key)
    others = links.join(F.broadcast(hot.select(*key)), key, "left_anti").join(least.filter(F.col("_links") <= bar).drop("_links"), key)
    return links.join(F.broadcast(hot), key).unionByName(others)


def components(nodes: DataFrame, edges: DataFrame, by: list[str], node: str) -> DataFrame:
    """Each node with the smallest node of its component as ``label``.

    ``edges`` has columns a and b. Large-star and small-star rounds alternate: the larger
    neighbours of a node are linked to the least of its neighbourhood, then the smaller ones and
    the node itself to the least of them, until every component is a star around its least node.
    Every step is a map-side combined minimum and a join in which no hot node gathers its links.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = edges.select(*by, high.alias("u"), low.alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        links = cut_lineage(links)
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = links.unionByName(links.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, by, 2 * state[0]).filter("v > u").select(*by, F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        small = _with_least(large, by, state[0])
        own = small.select(*by, "u", F.col("m").alias("v"))
        links = own.unionByName(small.select(*by, F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
    tops = links.select(*by, F.col("u").alias(node), F.col("v").alias("_top"))
    return nodes.select(*by, node).distinct().join(tops, [*by, node], "left").select(*by, node, F.coalesce("_top", node).alias("label"))


def face_edges(faces: DataFrame, by: list[str]) -> DataFrame:
    """Sorted edge keys of each triangle."""
    pairs = F.array(*[
        F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))
    ])
    return faces.select(*by, "face_id", F.explode(pairs).alias("_e")).select(*by, "face_id", "_e.*")


def face_adjacency(faces: DataFrame, by: list[str]) -> DataFrame:
    """Faces sharing an edge, chained through the edge's smallest face, so a hot edge stays linear."""
    edges = face_edges(faces, by)
    lead = edges.groupBy(*by, "lo", "hi").agg(F.min("face_id").alias("a"))
    return edges.join(lead, [*by, "lo", "hi"]).filter("face_id <> a").select(*by, "a", F.col("face_id").alias("b"))


def longest_edges(faces: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """Faces with their corner points, longest edge and centroid.

    Vertices are about as many as faces and compress well, which makes them look small enough
    to broadcast; the hint keeps their joins shuffled.
    """
    out = faces
    for corner in ("a", "b", "c"):
        v = vertices.select(*by, F.col("vertex_id").alias(corner), F.struct("x", "y", "z").alias(f"_{corner}"))
        out = out.join(v.hint("merge"), [*by, corner])

    def length(p: str, q: str):
        d = [F.col(f"_{p}")[k] - F.col(f"_{q}")[k] for k in "xyz"]
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    centre = [((F.col("_a")[k] + F.col("_b")[k] + F.col("_c")[k]) / 3.0).alias(k) for k in "xyz"]
    return out.select(*by, "face_id", "a", "b", "c", F.greatest(length("a", "b"), length("b", "c"), length("c", "a")).alias("longest_m"), *centre)


def edge_limits(measured: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("longest_m")
    out = grouped(
        measured, by, [F.count(e).alias("faces"), F.max(e).alias("longest_max_m")],
        [Quantile("longest_p95_m", e, 0.95), Quantile("_median", e, 0.5)],
    )
    return out.withColumn("limit_m", F.greatest(2.25 * F.col("longest_p95_m"), 6.0 * F.col("_median"))).drop("_median")


def keep_unless_all(faces: DataFrame, by: list[str], ok: str) -> DataFrame:
    """Drop faces that fail, except where every face of the mesh would go."""
    some = faces.groupBy(*by).agg(F.some(ok).alias("_some"))
    return faces.join(some, by).filter(F.col(ok) | ~F.col("_some")).drop("_some", ok)


def supported(measured: DataFrame, support: DataFrame, limits: DataFrame, by: list[str]) -> DataFrame:
    """Faces whose centroid lies within the limit of a support point."""
    near = nearest_distance(measured, support, by).join(limits.select(*by, "limit_m"), by)
    flagged = near.withColumn("_ok", F.coalesce(F.col("distance") <= F.col("limit_m"), F.lit(False)))
    return keep_unless_all(cut_lineage(flagged.drop("limit_m", "distance")), by, "_ok")  # read twice there


def drop_fragments(faces: DataFrame, by: list[str]) -> DataFrame:
    """Faces of components at least a thousandth of the largest, held between 2 and 100 faces."""
    faces = cut_lineage(faces)
    labels = components(faces, face_adjacency(faces, by), by, "face_id")
    sizes = labels.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy(*by).agg(F.max("size").alias("_largest"))
    least = F.greatest(F.lit(2), F.least(F.lit(100), F.floor(F.col("_largest") * 0.001)))
    flagged = faces.join(labels, [*by, "face_id"]).join(sizes, [*by, "label"]).join(largest, by)
    flagged = flagged.withColumn("_ok", F.col("size") >= least).drop("_largest")
    return keep_unless_all(flagged, by, "_ok")


# Fixed value: the pair id packs two image ids in this base.
PAIR_BASE = 2147483647


def decode_pairs(matches: DataFrame) -> DataFrame:
    return matches.withColumn("image_a", F.floor(F.col("pair_id") / F.lit(PAIR_BASE))).withColumn(
        "image_b", F.col("pair_id") % F.lit(PAIR_BASE)
    )


def match_subset(matches: DataFrame, keep: DataFrame, by: list[str]) -> DataFrame:
    """Pairs whose two images are both kept."""
    ids = keep.select(*by, "image_id").distinct()
    out = decode_pairs(matches)
    for side in ("image_a", "image_b"):
        out = out.join(ids.withColumnRenamed("image_id", side), [*by, side], "left_semi")
    return out
