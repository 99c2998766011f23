"""Merkle manifest of a table by slot pivots.

Rows become leaves, ordered per group; every ``FANOUT`` consecutive nodes become their hash
until a group has one, its subroot, and the subroots likewise give the root. A level is one
aggregation: conditional aggregates spread the children of a parent into one column per slot,
and the hash of those columns side by side is the parent. Read downwards, the same tables give
every node its siblings, which are the columns left when that of its own slot is omitted.

Places within a group come from range partitions: (group, order) cuts a group of any size, each
part numbers its rows, and one small row per part and group says where its numbers begin. A
level is grouped by (group, place of the parent), so no key ever has more than ``FANOUT`` rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

FANOUT = 3
PART_ROWS = 200_000
STEP = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """SHA-256 of the values side by side, in lowercase hexadecimal; nulls are left out."""
    return F.sha2(F.concat_ws("", *values), 256)


def _parts(rows: int) -> int:
    return max(1, math.ceil(rows / PART_ROWS))


def placed(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """``rows`` with pos (from 0, by ``order``) and n (rows) of their ``group``; equal rows take any order."""
    dealt = rows.repartitionByRange(_parts(n_rows), "group", *order).sortWithinPartitions("group", *order)
    at = F.monotonically_increasing_id()
    dealt = cut_lineage(dealt.withColumn("_at", at).withColumn("_part", F.spark_partition_id()))
    spans = dealt.groupBy("_part", "group").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per part and group that meet: what a group has in earlier parts, and in all.
    group = W.partitionBy("group")
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select(
        "_part", "group", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("n")
    )
    return dealt.join(spans, ["_part", "group"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _slots(k: int = FANOUT) -> list[str]:
    return [f"s{i}" for i in range(k)]


def _step(slot: Column) -> Column:
    """The siblings of ``slot``: the other columns, those before it and those after it."""
    steps = [
        F.struct(F.concat_ws("", *_slots()[:i]).alias("before"), F.concat_ws("", *_slots()[i + 1 :]).alias("after")) for i in range(FANOUT)
    ]
    chosen = steps[-1]
    for i in range(FANOUT - 2, -1, -1):
        chosen = F.when(slot == i, steps[i]).otherwise(chosen)
    return F.array(chosen)


def climb(nodes: DataFrame, n_nodes: int, longest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above ``nodes`` (group, pos, n, h), each (group, n, pos, slots) with one row per parent, and the roots (group, h).

    ``longest`` is the largest n; a group of one node is its own root and in no level.
    """
    levels, roots = [], nodes.filter("n = 1").select("group", "h")
    slot = F.pmod(F.col("pos"), F.lit(FANOUT))
    parent = F.floor(F.col("pos") / FANOUT).cast("long")
    while longest > 1:
        pivot = [F.max(F.when(slot == i, F.col("h"))).alias(s) for i, s in enumerate(_slots())]
        n_nodes = math.ceil(n_nodes / FANOUT)
        longest = math.ceil(longest / FANOUT)
        level = nodes.filter("n > 1").groupBy("group", "n", parent.alias("_parent")).agg(*pivot).withColumnRenamed("_parent", "pos")
        level = cut_lineage(level.coalesce(_parts(n_nodes)))
        levels.append(level)
        nodes = level.select("group", "pos", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), digest(*_slots()).alias("h"))
        roots = roots.unionByName(nodes.filter("n = 1").select("group", "h"))
    return levels, roots


def _under(nodes: DataFrame, above: DataFrame | None, starts: DataFrame) -> DataFrame:
    """``nodes`` (group, pos, n, ...) with the path from each up to the root.

    ``above`` is the level of their parents with its own paths; a group's only node takes the
    path with which its group starts.
    """
    only = nodes.filter("n = 1").join(starts, "group")
    if above is None:
        return only
    parents = above.select("group", F.col("pos").alias("_parent"), *_slots(), F.col("path").alias("_path"))
    below = nodes.filter("n > 1").withColumn("_parent", F.floor(F.col("pos") / FANOUT).cast("long")).join(parents, ["group", "_parent"])
    path = F.concat(_step(F.pmod(F.col("pos"), F.lit(FANOUT))), F.col("_path"))
    return only.unionByName(below.withColumn("path", path).select(*nodes.columns, "path"))


def paths(nodes: DataFrame, levels: list[DataFrame], starts: DataFrame) -> DataFrame:
    """``nodes`` with ``path``: per level up to the root the siblings before and after (``starts`` continues each group's)."""
    above = None
    for level in reversed(levels):
        # A level's rows are nodes of the next one: ceil(n / FANOUT) of them in a group.
        own = level.withColumnRenamed("n", "_n").withColumn("n", F.ceil(F.col("_n") / FANOUT).cast("long"))
        own = own.select("group", "pos", "n", *[F.col(s).alias(f"_{s}") for s in _slots()])
        found = _under(own, above, starts)
        above = cut_lineage(found.select("group", "pos", *[F.col(f"_{s}").alias(s) for s in _slots()], "path"))
    return _under(nodes, above, starts)


def _up(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def merkle_manifest(
    df: DataFrame, changed: dict[str, Column] | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id", group_col: str = "source",
) -> DataFrame:
    """Per row: ``id_col``, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the hash of ``columns``. Leaves of a group ascend by id (null first), groups by
    name (null first, bytewise); rows of one id ascend by leaf, equal rows are leaves each.
    ``proof_sha256`` hashes the siblings from the leaf to the root. ``changed`` gives columns
    as someone holds them who asks for verification; ``folded_root`` is made of that row's
    leaf and the true siblings, ``verified`` tells if it is the root. Any column may be null,
    texts may be empty or very long, other columns are not read, an empty table gives no rows.
    """
    changed = changed or {}
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    told = digest(*[field(changed.get(c, F.col(c))) for c in columns]) if changed else F.lit(None).cast("string")
    leaves = df.select(
        F.col(id_col).alias("id"), group.alias("group"), digest(*[field(F.col(c)) for c in columns]).alias("h"), told.alias("told"),
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = cut_lineage(leaves)
    n_leaves = leaves.count()
    leaves = cut_lineage(placed(leaves, ["id", "h", "_row"], n_leaves))
    longest = leaves.agg(F.max("n")).first()[0] or 0
    levels, subroots = climb(leaves.select("group", "pos", "n", "h"), n_leaves, longest)
    # The subroots are the leaves of one more tree, whose only group has no name.
    subroots = cut_lineage(subroots)
    n_groups = subroots.count()
    tops = subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "h")
    tops = cut_lineage(placed(tops, ["name"], n_groups))
    top_levels, root = climb(tops.select("group", "pos", "n", "h"), n_groups, n_groups)
    found = root.first()
    root = found["h"] if found else None
    nothing = df.sparkSession.createDataFrame([("", [])], f"group string, path {STEP}")
    starts = paths(tops, top_levels, nothing).select(F.col("name").alias("group"), F.col("h").alias("subroot"), "path")
    starts = cut_lineage(starts)
    full = paths(leaves.select("group", "pos", "n", "id", "h", "told"), levels, starts.select("group", "path"))
    full = full.join(starts.select("group", "subroot"), "group")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = full.select(
        F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), _up(F.col("path"), F.coalesce("told", "h")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
