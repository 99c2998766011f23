"""Greedy suppression in a fixed order: loop pairs, edges and candidate frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import is_hot
from ..session import cut_lineage


def greedy_keep(
    items: DataFrame, group: list[str], item: str, order: list[str], probes: Column, ranges: Column, cell: int,
    hot: bool | None = None,
) -> DataFrame:
    """Rows a sequential pass in ``order`` would keep.

    A row is dropped when one of its ``probes`` lies in a closed range of a row kept before
    it. Small groups run the pass in one group function. Huge groups run rounds: positions
    are cut into cells, a row whose probes lie in cells where no earlier open row reaches is
    kept, and its ranges drop later rows. Both give the same rows.
    """
    items = items.withColumn("_probes", probes).withColumn("_ranges", ranges)
    if hot is None:
        hot = is_hot(items, group)
    return _by_rounds(items, group, item, order, cell) if hot else _in_group(items, group, item, order)


def _in_group(items: DataFrame, group: list[str], item: str, order: list[str]) -> DataFrame:
    types = dict(items.dtypes)
    wanted = list(dict.fromkeys([*group, item]))
    schema = ", ".join(f"{c} {types[c]}" for c in wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted rows stream through; only the open group's blocked positions are held.
        current, taken = None, set()
        for pdf in batches:
            kept = []
            keys = zip(*[pdf[g] for g in group])
            for row, (key, probes, lows, highs) in enumerate(zip(keys, pdf["_probes"], pdf["_lows"], pdf["_highs"])):
                if key != current:
                    current, taken = key, set()
                if any(p in taken for p in probes):
                    continue
                kept.append(row)
                for lo, hi in zip(lows, highs):
                    taken.update(range(lo, hi + 1))
            yield pdf.iloc[kept][wanted]

    small = items.select(
        *dict.fromkeys([*group, item, *order]), "_probes",
        F.transform("_ranges", lambda s: s["lo"]).alias("_lows"), F.transform("_ranges", lambda s: s["hi"]).alias("_highs"),
    )
    kept = small.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)
    return items.drop("_probes", "_ranges").join(kept, wanted)


def _by_rounds(items: DataFrame, group: list[str], item: str, order: list[str], cell: int) -> DataFrame:
    priority = F.struct(*order, item).alias("_first")
    reach = F.array_distinct(F.flatten(F.transform(
        "_ranges", lambda s: F.sequence(F.floor(s["lo"] / cell), F.floor(s["hi"] / cell))
    )))
    undecided = cut_lineage(items.select(*group, item, priority, "_probes", "_ranges"))
    kept_parts = []
    while not undecided.isEmpty():
        leaders = undecided.select(*group, "_first", F.explode(reach).alias("_cell")).groupBy(*group, "_cell").agg(
            F.min("_first").alias("_leader")
        )
        seen = undecided.select(*group, item, "_first", F.explode("_probes").alias("_p")).withColumn("_cell", F.floor(F.col("_p") / cell))
        accepted = (
            seen.join(leaders, [*group, "_cell"]).groupBy(*group, item)
            .agg(F.every(F.col("_leader") == F.col("_first")).alias("_ok")).filter("_ok").drop("_ok")
        )
        accepted = cut_lineage(undecided.join(accepted, [*group, item]))
        kept_parts.append(accepted.select(*group, item))
        spans = accepted.select(*group, F.explode("_ranges").alias("_s")).select(
            *group, "_s.lo", "_s.hi", F.explode(F.sequence(F.floor(F.col("_s.lo") / cell), F.floor(F.col("_s.hi") / cell))).alias("_cell")
        )
        covered = seen.join(spans, [*group, "_cell"]).filter(F.col("_p").between(F.col("lo"), F.col("hi"))).select(*group, item).distinct()
        undecided = cut_lineage(undecided.join(covered, [*group, item], "left_anti"))
    out = kept_parts[0] if kept_parts else undecided.select(*group, item)
    for part in kept_parts[1:]:
        out = out.unionByName(part)
    return items.drop("_probes", "_ranges").join(out, [*group, item])


def span(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))


def suppress_loop_pairs(pairs: DataFrame, seq: str, radius: int, hot: bool | None = None) -> DataFrame:
    """Best-first loop pairs ``(i < j, score)``; each kept pair blocks frames around both ends."""
    top = pairs.groupBy(seq).agg(F.max("j").alias("_top"))
    i, j = F.col("i"), F.col("j")
    ready = pairs.join(top, seq).withColumn("_down", -F.col("score")).withColumn("_pair", F.concat_ws("-", i, j))
    ranges = F.filter(F.array(
        span(F.greatest(F.lit(0), i - radius), F.least(i + radius, j - 1)),
        span(F.greatest(i + 1, j - radius), F.least(j + radius, F.col("_top"))),
    ), lambda s: s["hi"] >= s["lo"])
    kept = greedy_keep(ready, [seq], "_pair", ["_down", "i", "j"], F.array(i, j), ranges, max(1, radius), hot=hot)
    return kept.select(seq, j.alias("later"), i.alias("earlier"), "score")


def thin_edges(edges: DataFrame, seq: str, radius: int, most: int, least_span: int = 30, hot: bool | None = None) -> DataFrame:
    """Shortest-motion edges first; a kept edge blocks near starts with the same end.

    Which edges survive does not depend on the cap, so the cap is the first ``most`` survivors
    of each sequence.
    """
    usable = edges.filter((F.col("j") - F.col("i") >= least_span) & (F.col("flow") < 1000))
    i = F.col("i")
    kept = greedy_keep(
        usable.withColumn("_i", i), [seq, "j"], "i", ["flow", "_i"], F.array(i), F.array(span(i - radius, i + radius)),
        max(1, radius), hot=hot,
    )
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(seq).orderBy("flow", "i", "j"))
    # rank <= most lets Spark keep only the best rows of each partition before the shuffle
    return kept.withColumn("_place", place).filter(F.col("_place") <= most).select(seq, "i", "j", "flow")


def first_per_pair(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Drop self pairs; keep the first row of each ordered pair."""
    rest = [c for c in rows.columns if c not in (a, b)]
    return rows.filter(F.col(a) != F.col(b)).groupBy(a, b).agg(
        F.min_by(F.struct(*rest), order).alias("_r")
    ).select(a, b, "_r.*")
