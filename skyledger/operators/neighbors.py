"""Exact nearest-neighbour joins over leaves of a space-filling curve, and radius thinning.

Sources and targets are range-partitioned together by (group, Morton code), which cuts a group
of any size into parts of bounded rows that are compact in space. Inside a part, targets along
the curve form leaves of a few rows with their boxes, and blocks of sources look only at the
leaves that can hold one of their k nearest. That settles every source whose ball stays inside
the region only its own part covers; the others are sent to the parts whose boxes their ball
touches, and their lists are merged. Copies of a coordinate are one row with a count.
Where distances alone are asked, a source is one row of them from the first search on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage

PART_ROWS = 40_000
MOST_PARTS = 500_000
LEAF = 32
BLOCK = 64
#: A part is told by the boxes of so many stretches of the curve; one box of a bent stretch covers much that is not its own.
STRETCHES = 16
#: Sources that look up the boxes of other parts together.
ASKERS = 256


def with_morton(df: DataFrame, dims: list[str], low: list[float], span: float, name: str) -> DataFrame:
    """Add the place on the curve of each point in the cube of edge ``span`` at ``low``; two or three dimensions.

    Zeros come between the bits of a coordinate by the usual masks. Each step is a projection of
    its own: nested, every step would name the one before twice, and the text of the last would
    hold the coordinate 32 times over.
    """
    steps = {
        2: ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)),
        3: ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)),
    }[len(dims)]
    cells = 1 << 62 // len(dims)
    bits = [f"_m_{d}" for d in dims]
    place = [F.floor((F.col(d) - lo) / span * cells) for d, lo in zip(dims, low)]
    out = df.select("*", *[F.greatest(F.lit(0), F.least(p, F.lit(cells - 1))).cast("bigint").alias(m) for p, m in zip(place, bits)])
    for shift, mask in steps:
        out = out.select(*df.columns, *[F.col(m).bitwiseOR(F.shiftleft(m, shift)).bitwiseAND(F.lit(mask)).alias(m) for m in bits])
    code = F.col(bits[0])
    for i, m in enumerate(bits[1:], 1):
        code = code.bitwiseOR(F.shiftleft(m, i))
    return out.select(*df.columns, code.alias(name))


def _boxes(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows and corner points of the boxes of every ``size`` consecutive points."""
    starts = np.arange(0, len(points), size)
    return starts, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)


def _gap2(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances from one box to several."""
    out = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    return (out * out).sum(axis=1)


def _far2(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances no point of one box exceeds to any point of several."""
    out = np.maximum(np.abs(high - lows), np.abs(highs - low))
    return (out * out).sum(axis=1)


def _sure(far: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per row a squared distance within which ``k`` are counted: the far side of the nearest boxes that hold them."""
    order = np.argsort(far, axis=1)
    held = np.cumsum(counts[order], axis=1) >= k
    at = held.argmax(axis=1)
    return np.where(held.any(axis=1), np.take_along_axis(far, order, 1)[np.arange(len(far)), at] * (1 + 1e-9), np.inf)


def _squared(sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
    total = np.zeros((len(sources), len(targets)))
    for d in range(sources.shape[1]):
        gap = targets[None, :, d] - sources[:, None, d]
        total += gap * gap
    return total


def _kth(d2: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per row the least squared distance up to which ``k`` are counted; infinite where there are fewer."""
    if k == 1:
        return d2.min(axis=1)
    m = min(k, d2.shape[1])
    first = np.argpartition(d2, m - 1, axis=1)[:, :m] if m < d2.shape[1] else np.tile(np.arange(m), (len(d2), 1))
    near = np.take_along_axis(d2, first, axis=1)
    order = np.argsort(near, axis=1, kind="stable")
    near, counted = np.take_along_axis(near, order, axis=1), np.cumsum(n[np.take_along_axis(first, order, axis=1)], axis=1)
    full = counted >= k
    return np.where(full.any(axis=1), near[np.arange(len(d2)), full.argmax(axis=1)], np.inf)


def _leaves(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, first rows in it and corner points of leaves of at most ``size``, got by halving along the longest edge."""
    n = len(points)
    levels, order = max(0, math.ceil(math.log2(n / size))), np.arange(n)
    for level in range(levels + 1):
        starts, placed = np.arange(1 << level) * n >> level, points[order]
        lows, highs = np.minimum.reduceat(placed, starts), np.maximum.reduceat(placed, starts)
        if level < levels:
            node = np.repeat(np.arange(1 << level), np.diff(np.append(starts, n)))
            order = order[np.lexsort((placed[np.arange(n), (highs - lows).argmax(axis=1)[node]], node))]
    return order, starts, lows, highs


def search(sources: np.ndarray, targets: np.ndarray, n: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source, target, d2) of all targets up to each source's k-th distance, ties included, and within ``limit``; and that distance.

    A block of sources first meets the leaves nearest to it, which bounds its distances, then
    every leaf within the bound.
    """
    found, reach = [], np.full(len(sources), np.inf)
    if len(targets) and len(sources):
        t_order, starts, lows, highs = _leaves(targets, LEAF)
        targets, n = targets[t_order], n[t_order]
        sizes = np.diff(np.append(starts, len(targets)))
        s_order, s_starts, s_lows, s_highs = _leaves(sources, BLOCK)
        first = max(1, -(-k // LEAF)) + 1
        for mine, low, high in zip(np.split(s_order, s_starts[1:]), s_lows, s_highs):
            block, bound = sources[mine], limit[mine]
            gaps = _gap2(low, high, lows, highs)
            near = np.zeros(len(gaps), bool)
            near[np.argpartition(gaps, first)[:first] if first < len(gaps) else slice(None)] = True
            rows = np.flatnonzero(np.repeat(near, sizes))
            worst = min(_kth(_squared(block, targets[rows]), n[rows], k).max(), bound.max())
            near = gaps <= worst * (1 + 1e-9) + 1e-300
            rows = np.flatnonzero(np.repeat(near, sizes))
            if not len(rows):
                continue
            d2 = _squared(block, targets[rows])
            kth = _kth(d2, n[rows], k)
            reach[mine] = kth
            i, j = np.nonzero(d2 <= np.minimum(kth, bound)[:, None])
            found.append((mine[i], t_order[rows[j]], d2[i, j]))
    if not found:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0), reach
    return *(np.concatenate([f[x] for f in found]) for x in range(3)), reach


def _matrix(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(table.column(c)) for c in names], axis=1) if table.num_rows else np.zeros((0, len(names)))


def _pairs(sources: pa.Table, targets: pa.Table, shape, k: int, limit: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The found rows of a part with the running count ``_upto``, the source each is of, and the k-th distances."""
    by, dims, s_dims, payload = shape
    n = np.asarray(targets.column("_n")).astype("int64") if targets.num_rows else np.zeros(0, "int64")
    i, j, d2, reach = search(_matrix(sources, dims), _matrix(targets, dims), n, k, limit)
    order = np.lexsort((j, d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    total = np.cumsum(n[j])
    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, "int64")
    before = np.repeat(total[new] - n[j][new], np.diff(np.append(new, len(i))))
    s, t = sources.take(pa.array(i)), targets.take(pa.array(j))
    columns = {b: s.column(b) for b in by} | {a: s.column(d) for a, d in zip(s_dims, dims)} | {d: t.column(d) for d in dims}
    columns |= {"_n": t.column("_n")} | {x: t.column(x) for x in payload}
    return pa.table(columns | {"_d2": pa.array(d2), "_upto": pa.array(total - before, pa.int64())}), i, reach


def _least(sources: np.ndarray, targets: np.ndarray, n: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sources that have targets within ``limit``, their k least squared distances one after another (copies repeated), how many each has; all k-th distances."""
    i, j, d2, reach = search(sources, targets, n, k, limit)
    order = np.lexsort((d2, i))
    i, d2, copies = i[order], d2[order], n[j[order]]
    if not len(i):
        return i, d2, copies, reach
    new = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    total = np.cumsum(copies) - copies
    used = np.clip(k - (total - np.repeat(total[new], np.diff(np.append(new, len(i))))), 0, copies)
    return i[new], np.repeat(d2, used), np.add.reduceat(used, new), reach


def _asks(xyz: np.ndarray, reach: np.ndarray, radius2: float, others, me: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, part, bound) of the sources whose ball touches a box of another part; a block of sources first drops the boxes none of its balls touch."""
    names, lows, highs, counts = others
    out = [(np.zeros(0, "int64"), np.zeros(0, "int32"), np.zeros(0))]
    for at, low, high in zip(*_boxes(xyz, ASKERS)):
        own, worst = reach[at : at + ASKERS], radius2
        if np.isinf(own).any():
            worst = min(worst, _sure(_far2(low, high, lows, highs)[None, :], counts, k)[0])
        else:
            worst = min(worst, own.max())
        near = np.flatnonzero(_gap2(low, high, lows, highs) <= worst * (1 + 1e-8))
        if not (names[near] != me).any():
            continue
        open_ended = np.isinf(own).any()
        step = max(1, 1_000_000 // len(near))
        for start in range(0, len(own), step):
            p = xyz[at : at + ASKERS][start : start + step, None, :]
            gap = np.maximum(np.maximum(lows[near] - p, p - highs[near]), 0.0)
            gap = (gap * gap).sum(axis=2)
            bound = np.minimum(own[start : start + step], radius2)
            if open_ended:
                far = np.maximum(np.abs(p - lows[near]), np.abs(p - highs[near]))
                bound = np.minimum(bound, _sure((far * far).sum(axis=2), counts[near], k))
            i, j = np.nonzero((gap <= bound[:, None] * (1 + 1e-9)) & (names[near] != me)[None, :])
            # a part is asked once, however many of its boxes a ball touches
            i, to = np.unique(np.stack([i, names[near[j]]]), axis=1)
            out.append((i + at + start, to.astype("int32"), bound[i]))
    return tuple(np.concatenate([o[x] for o in out]) for x in range(3))


def _home(shape, k: int, radius2: float, spanning):
    """Search a part by itself; sources whose ball may leave it are handed on as well, with their bound and place on the curve."""
    by, dims, s_dims, payload = shape

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_code", "ascending")])
        is_source = np.asarray(part.column("_n").is_null())
        sources, targets = part.filter(pa.array(is_source)), part.filter(pa.array(~is_source))
        found, owner, reach = _pairs(sources, targets, shape, k, np.full(sources.num_rows, radius2))
        others = spanning.value.get(tuple(part.column(b)[0].as_py() for b in by))
        extra = {"_kind": pa.array([0] * found.num_rows, pa.int32()), "_to": pa.nulls(found.num_rows, pa.int32())}
        found = pa.table({c: found.column(c) for c in found.column_names} | extra)
        if others is None or not sources.num_rows:
            return found
        i, to, bound = _asks(_matrix(sources, dims), reach, radius2, others, part.column("_part")[0].as_py(), k)
        asked = sources.take(pa.array(i))
        columns = {b: asked.column(b) for b in by} | {a: asked.column(d) for a, d in zip(s_dims, dims)}
        columns |= {d: pa.nulls(len(i), pa.float64()) for d in dims} | {"_n": pa.nulls(len(i), pa.int64())}
        columns |= {x: pa.nulls(len(i), part.schema.field(x).type) for x in payload}
        columns |= {"_d2": pa.array(bound), "_upto": asked.column("_code"), "_kind": pa.array([2] * len(i), pa.int32()), "_to": pa.array(to, pa.int32())}
        # What an open source found at home is not final: kind 1, to be merged.
        waits = np.isin(owner, i).astype("int32")
        found = found.set_column(found.schema.get_field_index("_kind"), "_kind", pa.array(waits, pa.int32()))
        return pa.concat_tables([found, pa.table(columns).select(found.column_names)], promote_options="permissive")

    return run


def _lists(values: np.ndarray, held: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)], pa.int32()), pa.array(values))


def _home_sums(shape, k: int, spanning, alike: bool):
    """As ``_home``, of distances alone: a settled source with its sum (kind 0), an open one with its list (kind 1), the parts it asks (kind 2)."""
    by, dims, s_dims, _ = shape

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("_code", "ascending")])
        is_source = np.asarray(part.column("_n").is_null())
        targets = part.filter(pa.array(~is_source))
        sources = part if alike else part.filter(pa.array(is_source))
        xyz, n = _matrix(sources, dims), np.asarray(targets.column("_n")).astype("int64")
        owner, near, held, reach = _least(xyz, _matrix(targets, dims), n, k, np.full(len(xyz), np.inf))
        others = spanning.value.get(tuple(part.column(b)[0].as_py() for b in by))
        i, to, bound = np.zeros(0, "int64"), np.zeros(0, "int32"), np.zeros(0)
        if others is not None and len(xyz):
            i, to, bound = _asks(xyz, reach, math.inf, others, part.column("_part")[0].as_py(), k)
        waits = np.isin(owner, i)
        sums = np.add.reduceat(np.sqrt(near), np.cumsum(held) - held) if len(owner) else np.zeros(0)

        def rows(kind: int, at: np.ndarray, **columns: pa.Array) -> pa.Table:
            taken = sources.take(pa.array(at))
            blank = {"_d2": pa.float64(), "_n": pa.int64(), "_near": pa.list_(pa.float64()), "_code": pa.int64(), "_to": pa.int32()}
            named = {b: taken.column(b) for b in by} | {a: taken.column(d) for a, d in zip(s_dims, dims)}
            named |= {c: columns.get(c, pa.nulls(len(at), t)) for c, t in blank.items()}
            named["_code"] = taken.column("_code") if kind == 2 else named["_code"]
            return pa.table(named | {"_kind": pa.array([kind] * len(at), pa.int32())})

        return pa.concat_tables([
            rows(0, owner[~waits], _d2=pa.array(sums[~waits]), _n=pa.array(held[~waits], pa.int64())),
            rows(1, owner[waits], _near=_lists(near[np.repeat(waits, held)], held[waits])),
            rows(2, i, _d2=pa.array(bound), _to=pa.array(to, pa.int32())),
        ])

    return run


def _away_sums(shape, k: int):
    """The lists that a part has for sources of other parts, each within the bound it brings."""
    by, dims, s_dims, _ = shape

    def run(asked: pa.Table, part: pa.Table) -> pa.Table:
        asked = asked.sort_by([("_code", "ascending")])
        n = np.asarray(part.column("_n")).astype("int64")
        owner, near, held, _ = _least(_matrix(asked, s_dims), _matrix(part, dims), n, k, np.asarray(asked.column("_d2")))
        asked = asked.take(pa.array(owner))
        return pa.table({c: asked.column(c) for c in [*by, *s_dims]} | {"_near": _lists(near, held)})

    return run


def _stretches(by: list[str], dims: list[str], size: int):
    """The boxes of every ``size`` consecutive targets of a part and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            if not len(rows):
                continue
            groups = rows.groupby(["_part", *by, np.arange(len(rows)) // size], sort=False)
            low, high = groups[dims].min(), groups[dims].max()
            out = low.index.to_frame(index=False)[["_part", *by]].assign(_c=groups["_n"].sum().to_numpy("int64"))
            for d in dims:
                out[f"_lo_{d}"], out[f"_hi_{d}"] = low[d].to_numpy(), high[d].to_numpy()
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return run


def _away(shape, k: int):
    """Search a part for sources of other parts, each within the bound it brings."""
    by, dims, s_dims, _ = shape

    def run(asked: pa.Table, part: pa.Table) -> pa.Table:
        sources = pa.table({b: asked.column(b) for b in by} | {d: asked.column(a) for a, d in zip(s_dims, dims)} | {"_bound": asked.column("_d2"), "_code": asked.column("_code")})
        sources = sources.sort_by([("_code", "ascending")])
        return _pairs(sources, part.sort_by([("_code", "ascending")]), shape, k, np.asarray(sources.column("_bound")))[0]

    return run


def neighbours(
    sources: DataFrame | None, targets: DataFrame, by: list[str], dims: list[str], k: int = 1,
    radius: float | None = None, payload: list[str] | None = None, sums: bool = False,
) -> DataFrame:
    """Nearest target rows per distinct source coordinate, two or three dimensions.

    ``targets`` are distinct coordinates with a count ``_n``; result rows carry ``_d2``, ``_n``
    and ``_upto`` (running count): all rows up to the distance at which ``k`` are counted, rows
    of that same distance included, none beyond ``radius``. Rows with a null coordinate or
    group take no part. With ``sums`` (any distance, no payload) a source is one row, of the sum
    of its k distances in ``_d2`` and their number in ``_n``; ``_upto`` is null. There the targets
    are the sources as well, if none are given.
    """
    payload = payload or []
    spark = targets.sparkSession
    s_dims = [f"_s_{d}" for d in dims]
    shape = (by, dims, s_dims, payload)
    kinds = {f.name: f.dataType.simpleString() for f in [*(sources or targets).schema.fields, *targets.schema.fields]}
    known = " and ".join(f"`{c}` is not null" for c in [*by, *dims])
    coordinates = [F.col(d).cast("double").alias(d) for d in dims]
    tgt = targets.select(*by, *coordinates, F.col("_n").cast("bigint").alias("_n"), *payload).filter(known)
    # Written once: counted, sampled and dealt below, while the rows may come from a long plan.
    both = tgt
    if sources is not None:
        both = tgt.unionByName(sources.select(*by, *coordinates).filter(known).distinct(), allowMissingColumns=True)
    both = cut_lineage(both)
    row = both.agg(F.count(F.lit(1)), *[F.min(d) for d in dims], *[F.max(d) for d in dims]).first()
    low, high = list(row[1 : 1 + len(dims)]), list(row[1 + len(dims) :])
    span = max([h - l for l, h in zip(low, high)] if row[0] else [1.0]) or 1.0
    low = low if row[0] else [0.0] * len(dims)
    parts = max(1, math.ceil(row[0] / max(PART_ROWS, row[0] / MOST_PARTS)))
    coded = with_morton(both, dims, low, span, "_code")
    # Sorted, so that rows that are read together are a stretch of the curve.
    dealt = coded.repartitionByRange(parts, *by, "_code", *dims).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt.sortWithinPartitions(*by, "_code"))
    # Only groups that span parts need boxes: a bounded number a part, and the parts are bounded.
    stretch = max(1, math.ceil(max(PART_ROWS, row[0] * STRETCHES / MOST_PARTS) / STRETCHES))
    limits = ", ".join(["_part int", *[f"`{b}` {kinds[b]}" for b in by], "_c bigint", *[f"_lo_{d} double, _hi_{d} double" for d in dims]])
    held = dealt.filter("_n is not null").select("_part", *by, *dims, "_n").mapInArrow(_stretches(by, dims, stretch), limits)
    met = dealt.groupBy(*by).agg(F.min("_part").alias("_a"), F.max("_part").alias("_b")).filter("_a < _b").select(*by)
    boxes: dict[tuple, list] = {}
    for r in held.join(met, by, "left_semi").orderBy("_part").collect() if by else held.orderBy("_part").collect():
        boxes.setdefault(tuple(r[b] for b in by), []).append(r)
    packed = {
        g: (
            np.array([r["_part"] for r in rows], "int32"), np.array([[r[f"_lo_{d}"] for d in dims] for r in rows]),
            np.array([[r[f"_hi_{d}"] for d in dims] for r in rows]), np.array([r["_c"] for r in rows], "int64"),
        )
        for g, rows in boxes.items()
    }
    spanning = spark.sparkContext.broadcast(packed)
    shown = [f"`{b}` {kinds[b]}" for b in by] + [f"{d} double" for d in [*s_dims, *dims]] + ["_n bigint"]
    shown = ", ".join([*shown, *[f"`{x}` {kinds[x]}" for x in payload], "_d2 double", "_upto bigint"])
    radius2 = math.inf if radius is None else float(radius) * float(radius)
    parted = dealt.groupBy("_part", *by)
    if sums:
        given = ", ".join([f"`{b}` {kinds[b]}" for b in by] + [f"{d} double" for d in s_dims])
        home = cut_lineage(parted.applyInArrow(
            _home_sums(shape, k, spanning, sources is None), f"{given}, _d2 double, _n bigint, _near array<double>, _code bigint, _to int, _kind int"
        ))
        settled = home.filter("_kind = 0").select(*by, *s_dims, "_d2", "_n")
        if packed:
            away = _dealt_asks(home, dealt, by, s_dims).applyInArrow(_away_sums(shape, k), f"{given}, _near array<double>")
            lists = home.filter("_kind = 1").select(*by, *s_dims, "_near").unionByName(away)
            merged = lists.groupBy(*by, *s_dims).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
            total = F.aggregate("_near", F.lit(0.0), lambda done, d2: done + F.sqrt(d2))
            settled = settled.unionByName(merged.select(*by, *s_dims, total.alias("_d2"), F.size("_near").cast("bigint").alias("_n")))
        return settled.withColumn("_upto", F.lit(None).cast("bigint"))
    home = cut_lineage(parted.applyInArrow(_home(shape, k, radius2, spanning), f"{shown}, _kind int, _to int"))
    names = [*by, *s_dims, *dims, "_n", *payload, "_d2", "_upto"]
    settled = home.filter("_kind = 0").select(*names)
    if not packed:
        return settled
    away = _dealt_asks(home.withColumnRenamed("_upto", "_code"), dealt, by, s_dims).applyInArrow(_away(shape, k), shown)
    merged = home.filter("_kind = 1").select(*names).unionByName(away).drop("_upto")
    source = [*by, *s_dims]
    w = W.partitionBy(*source).orderBy("_d2", *dims)
    merged = merged.withColumn("_upto", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    reach = F.min(F.when(F.col("_upto") >= k, F.col("_d2"))).over(W.partitionBy(*source))
    merged = merged.withColumn("_reach", reach).filter("_reach is null or _d2 <= _reach")
    return settled.unionByName(merged.select(*names))


def _dealt_asks(home: DataFrame, dealt: DataFrame, by: list[str], s_dims: list[str]):
    """Askers and the targets of the parts they ask; a part that very many ask is copied, and its askers are dealt to the copies."""
    key = ["_part", *by]
    asked = home.filter("_kind = 2").select(F.col("_to").alias("_part"), *by, *s_dims, "_d2", "_code")
    crowds = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (8 * PART_ROWS)).cast("int").alias("_copies"))
    asked = asked.join(crowds, key).withColumn("_copy", F.pmod(F.xxhash64(*s_dims), F.col("_copies")).cast("int")).drop("_copies")
    copied = dealt.filter("_n is not null").join(crowds, key).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies")
    return asked.groupBy(*key, "_copy").cogroup(copied.groupBy(*key, "_copy"))


def _folded(points: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    return points.groupBy(*by, *[F.col(d).cast("double").alias(d) for d in dims]).agg(F.count(F.lit(1)).alias("_n"))


def nearest_distance(source: DataFrame, target: DataFrame, by: list[str], dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Source rows with the distance to the nearest target of the same group (null if none)."""
    dims = list(dims)
    found = neighbours(source, _folded(target, by, dims), by, dims, 1, sums=True)
    best = found.select(*by, *[F.col(f"_s_{d}").alias(d) for d in dims], F.col("_d2").alias("distance"))
    return source.join(best.hint("merge"), [*by, *dims], "left")  # as many rows as sources, so never broadcast


def mean_neighbour_distance(points: DataFrame, by: list[str], k: int = 12, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points with the mean distance to their k nearest others; a copy counts as another at zero."""
    dims = list(dims)
    sums = neighbours(None, _folded(points, by, dims), by, dims, k + 1, sums=True)
    # the nearest of all is the point itself, at zero, and is left out by rank
    mean = F.when(F.col("_n") > 1, F.col("_d2") / (F.col("_n") - 1))
    sums = sums.select(*by, *[F.col(f"_s_{d}").alias(d) for d in dims], mean.alias("mean_distance"))
    return points.join(sums.hint("merge"), [*by, *dims])


def nearest_ids(points: DataFrame, by: list[str], item: str, k: int, radius: float, dims: tuple[str, ...]) -> DataFrame:
    """(source item, neighbour item, distance) for the k nearest within ``radius``, self included.

    Ties go to the lower item, so only the k lowest items of one coordinate can ever be used.
    """
    dims = list(dims)
    cast = points.select(*by, item, *[F.col(d).cast("double").alias(d) for d in dims])
    w = W.partitionBy(*by, *dims).orderBy(item)
    lowest = cast.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    folded = lowest.groupBy(*by, *dims).agg(F.array_sort(F.collect_list(item)).alias("_items")).withColumn("_n", F.size("_items"))
    found = neighbours(points, folded, by, dims, k, radius, ["_items"])
    each = found.select(*by, *[f"_s_{d}" for d in dims], "_d2", F.explode("_items").alias("neighbour"))
    place = F.row_number().over(W.partitionBy(*by, *[f"_s_{d}" for d in dims]).orderBy("_d2", "neighbour"))
    each = each.withColumn("place", place).filter(F.col("place") <= k)
    renamed = each.select(*by, *[F.col(f"_s_{d}").alias(d) for d in dims], "neighbour", F.sqrt("_d2").alias("distance"), "place")
    return cast.join(renamed.hint("merge"), [*by, *dims]).select(*by, item, "neighbour", "distance", "place")


def thin_by_radius(points: DataFrame, by: list[str], item: str, radius: float, seed: int = 42, dims: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points a sequential pass keeps when each kept point blocks the others within ``radius``.

    The pass order is a seeded hash. In cells so small that any two points block each other
    only the first open point can be kept; it is, once no earlier open point is near it.
    Each round then drops the points near the newly kept, at most one per cell.
    """
    dims = list(dims)
    side = radius / math.sqrt(len(dims)) * (1 - 1e-12)
    ring = math.ceil(radius / side)
    cells = [f"_c_{d}" for d in dims]
    open_points = points.select(
        *by, item, *[F.col(d).cast("double").alias(d) for d in dims],
        F.struct(F.xxhash64(F.lit(seed), item), F.col(item)).alias("_first"),
        *[F.floor(F.col(d) / side).alias(c) for d, c in zip(dims, cells)],
    )
    open_points = cut_lineage(open_points)
    offsets = range(-ring, ring + 1)
    gap = sum(((F.col(d) - F.col(f"_k_{d}")) * (F.col(d) - F.col(f"_k_{d}")) for d in dims), F.lit(0.0))
    kept_parts = []

    def spread(df: DataFrame) -> DataFrame:
        for c in cells:
            df = df.withColumn(c, F.explode(F.array(*[F.col(c) + o for o in offsets])))
        return df

    while not open_points.isEmpty():
        leaders = open_points.groupBy(*by, *cells).agg(
            F.min("_first").alias("_first"), F.min_by(F.struct(item, *dims), "_first").alias("_p")
        )
        # a leader waits while an earlier open point of a nearby cell lies within the radius
        asking = spread(leaders.select(*by, *cells, F.col("_first").alias("_mine"), *[F.col("_p")[d].alias(f"_k_{d}") for d in dims]))
        waiting = open_points.join(asking, [*by, *cells]).filter((F.col("_first") < F.col("_mine")) & (gap <= radius * radius))
        waiting = waiting.select(*by, F.col("_mine").alias("_first")).distinct()
        kept = cut_lineage(leaders.join(waiting, [*by, "_first"], "left_anti").select(*by, *cells, "_p.*"))
        kept_parts.append(kept.select(*by, item))
        near = spread(kept.select(*by, *cells, *[F.col(d).alias(f"_k_{d}") for d in dims]))
        blocked = open_points.join(near, [*by, *cells]).filter(gap <= radius * radius).select(*by, item).distinct()
        open_points = cut_lineage(open_points.join(blocked, [*by, item], "left_anti"))
    out = kept_parts[0] if kept_parts else points.select(*by, item).limit(0)
    for part in kept_parts[1:]:
        out = out.unionByName(part)
    return points.join(out, [*by, item])
