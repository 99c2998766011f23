"""Sparse rasters and the measures taken on them. A cell that is absent was never observed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import Quantile, grouped, next_known, ordered
from .graphs import components

AROUND = [(dc, dr) for dc in (-1, 0, 1) for dr in (-1, 0, 1) if (dc, dr) != (0, 0)]


def surface(points: DataFrame, by: list[str], res: float) -> tuple[DataFrame, DataFrame]:
    """(cells, grids): highest float32 z and point count per cell, rows counted from the north."""
    grids = points.groupBy(*by).agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max")
    )
    width = F.greatest(F.lit(1), F.ceil((F.col("x_max") - F.col("x_min")) / res) + 1)
    height = F.greatest(F.lit(1), F.ceil((F.col("y_max") - F.col("y_min")) / res) + 1)
    grids = grids.withColumn("width", width).withColumn("height", height)
    col = F.least(F.floor((F.col("x") - F.col("x_min")) / res), F.col("width") - 1)
    row = F.least(F.floor((F.col("y_max") - F.col("y")) / res), F.col("height") - 1)
    cells = points.join(grids, by).groupBy(*by, col.alias("col"), row.alias("row")).agg(
        F.max(F.col("z").cast("float")).cast("double").alias("z"), F.count(F.lit(1)).alias("n")
    )
    return cells, grids


def height_field(points: DataFrame, by: list[str], res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Highest z per cell, columns and rows counted from a fixed south-west corner."""
    return points.groupBy(
        *by, F.floor((F.col("x") - x0) / res).alias("col"), F.floor((F.col("y") - y0) / res).alias("row")
    ).agg(F.max("z").alias("z"), F.count(F.lit(1)).alias("n"))


def density_confidence(cells: DataFrame, by: list[str]) -> DataFrame:
    n = F.col("n")
    top = grouped(cells, by, [], [Quantile("density_p95", n.cast("double"), 0.95)])
    level = F.log1p(n) / F.greatest(F.log1p("density_p95"), F.lit(1e-6))
    return cells.join(top, by).withColumn("confidence", F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)))


def _sent(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell's value delivered to the cells at the offsets."""
    moves = F.explode(F.array(*[F.struct(F.lit(dc).alias("dc"), F.lit(dr).alias("dr")) for dc, dr in offsets]))
    out = cells.withColumn("_m", moves)
    return out.withColumn("col", F.col("col") + F.col("_m.dc")).withColumn("row", F.col("row") + F.col("_m.dr")).drop("_m")


def fill_holes(cells: DataFrame, grids: DataFrame, by: list[str], passes: int = 2, least: int = 4, mean: bool = False) -> DataFrame:
    """Unobserved cells with enough observed neighbours take their median (or mean).

    Every pass reads only the pass before. ``grids`` bounds the raster; the mean variant
    leaves the border cells empty.
    """
    edge = 1 if mean else 0
    box = grids.select(*by, F.col("width").alias("_w"), F.col("height").alias("_h"))
    filled = cells.select(*by, "col", "row", "z")
    for _ in range(passes):
        # at most eight values arrive per cell, so the exact median is small
        value = F.avg("z") if mean else F.percentile("z", F.lit(0.5))
        near = _sent(filled, AROUND).groupBy(*by, "col", "row").agg(F.count("z").alias("_n"), value.alias("z")).filter(F.col("_n") >= least)
        inside = near.join(box, by).filter(
            F.col("col").between(edge, F.col("_w") - 1 - edge) & F.col("row").between(edge, F.col("_h") - 1 - edge)
        )
        filled = filled.unionByName(inside.select(*by, "col", "row", "z").join(filled, [*by, "col", "row"], "left_anti"))
    return filled


def coarse_cells(cells: DataFrame, by: list[str], factor: int) -> DataFrame:
    return cells.select(*by, F.floor(F.col("col") / factor).alias("col"), F.floor(F.col("row") / factor).alias("row")).distinct()


def disk(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dc, dr) for dc in span for dr in span if math.hypot(dc, dr) <= radius]


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def dilate(cells: DataFrame, by: list[str], shape: list[tuple[int, int]]) -> DataFrame:
    return _sent(cells, shape).select(*by, "col", "row").distinct()


def erode(cells: DataFrame, by: list[str], shape: list[tuple[int, int]]) -> DataFrame:
    """Cells whose whole neighbourhood is present."""
    back = [(-dc, -dr) for dc, dr in shape]
    return _sent(cells, back).groupBy(*by, "col", "row").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") == len(shape)
    ).select(*by, "col", "row")


def fill_enclosed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Add the empty cells that cannot reach the outside through shared sides."""
    box = cells.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in ("col", "row") for n, f in (("lo", F.min), ("hi", F.max))])
    grid = box.select("*", F.explode(F.sequence(F.col("_lo_col") - 1, F.col("_hi_col") + 1)).alias("col")).select(
        "*", F.explode(F.sequence(F.col("_lo_row") - 1, F.col("_hi_row") + 1)).alias("row")
    )
    empty = grid.join(cells, [*by, "col", "row"], "left_anti")
    keyed = empty.withColumn("cell", F.col("row") * 4294967296 + F.col("col")).select(*by, "cell", "col", "row", "_lo_col", "_lo_row")
    spots = keyed.select(*by, "cell", "col", "row")
    sides = _sent(spots.withColumnRenamed("cell", "a"), [(1, 0), (0, 1)]).join(
        spots.withColumnRenamed("cell", "b"), [*by, "col", "row"]
    ).select(*by, "a", "b")
    labels = components(spots, sides, by, "cell")
    # the padded corner is outside by construction
    corner = box.select(*by, ((F.col("_lo_row") - 1) * 4294967296 + F.col("_lo_col") - 1).alias("cell"))
    outside = labels.join(corner, [*by, "cell"]).select(*by, F.col("label").alias("_out"))
    holes = labels.join(outside, by).filter("label <> _out").join(spots, [*by, "cell"]).select(*by, "col", "row")
    return cells.unionByName(holes)


def footprint_coverage(cells: DataFrame, by: list[str], res: float, cell_m: float = 5.0, bridge_m: float = 30.0) -> DataFrame:
    """Share of the gap-bridged flown outline that has surface data."""
    factor = max(1, round(cell_m / res))
    radius = max(1, math.ceil(bridge_m / (factor * res)))
    coarse = erode(dilate(coarse_cells(cells, by, factor), by, CROSS), by, CROSS)
    outline = erode(fill_enclosed(dilate(coarse, by, disk(radius)), by), by, disk(radius))
    whole = outline.groupBy(*by).agg(F.count(F.lit(1)).alias("footprint_cells"))
    covered = outline.join(coarse, [*by, "col", "row"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("covered_cells"))
    return whole.join(covered, by, "left").fillna(0, ["covered_cells"]).withColumn(
        "fraction", F.col("covered_cells") / F.col("footprint_cells")
    )


# ---- polygons -------------------------------------------------------------------------------


def rings(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """One row per drawn outline with its vertices in order (an outline has few vertices)."""
    return vertices.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("ring"))


def ring_edges(ring: Column = None) -> Column:
    ring = F.col("ring") if ring is None else ring
    return F.transform(ring, lambda a, i: F.struct(a.alias("a"), F.element_at(ring, (i + 1) % F.size(ring) + 1).alias("b")))


def path_legs(ring: Column = None) -> Column:
    ring = F.col("ring") if ring is None else ring
    return F.slice(ring_edges(ring), F.lit(1), F.size(ring) - 1)


def _sum(edges: Column, value) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + value(e["a"], e["b"]))


def ring_area(ring: Column = None) -> Column:
    return F.abs(_sum(ring_edges(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2.0


def _flat(a, b) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def _solid(a, b) -> Column:
    return F.sqrt(
        (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]) + (b["z"] - a["z"]) * (b["z"] - a["z"])
    )


def ring_perimeter(ring: Column = None) -> Column:
    return _sum(ring_edges(ring), _flat)


def path_length(ring: Column = None, horizontal: bool = True) -> Column:
    return _sum(path_legs(ring), _flat if horizontal else _solid)


def raster_extent(cells: DataFrame, by: list[str]) -> DataFrame:
    """First and last column and row of each raster."""
    return cells.groupBy(*by).agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in ("col", "row") for f in (F.min, F.max)])


def _row_runs(lines: DataFrame, res: float, x0: float, y0: float) -> DataFrame:
    """Outline rows (``_edges``, ``row``) cut into runs ``_lo`` to ``_hi`` of columns whose cell centres lie inside.

    The edges that cross a row's centre line, in order, pair up into runs: by the even-odd rule a
    centre is inside from an odd crossing, included, to the next one, left out.
    """
    y = y0 + (F.col("row") + 0.5) * res
    cut = F.filter("_edges", lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    at = F.array_sort(F.transform(cut, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    runs = lines.withColumn("_at", at).drop("_edges").filter(F.size("_at") > 0)
    runs = runs.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_at") - 2, F.lit(2))))
    begin, end = F.get("_at", F.col("_k")), F.get("_at", F.col("_k") + 1)

    def from_(x: Column) -> Column:
        """The first column whose centre is not before x, by the very expression that gives centres."""
        near = F.ceil((x - x0) / res - 0.5)
        centre = lambda c: x0 + (c + 0.5) * res
        return F.when(centre(near - 1) >= x, near - 1).when(centre(near) >= x, near).otherwise(near + 1)

    return runs.withColumn("_lo", from_(begin)).withColumn("_hi", from_(end) - 1).drop("_at", "_k").filter("_lo <= _hi")


def _row_range(y0: float, res: float) -> tuple[Column, Column]:
    """First and last row that an outline touches."""
    values = F.transform("ring", lambda p: p["y"])
    return F.floor((F.array_min(values) - y0) / res), F.floor((F.array_max(values) - y0) / res)


def ring_cells(outlines: DataFrame, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Grid cells whose centre lies inside each outline, one by one: its runs of columns written out."""
    first, last = _row_range(y0, res)
    lines = outlines.withColumn("_edges", ring_edges()).withColumn("row", F.explode(F.sequence(first, last))).drop("ring")
    cells = _row_runs(lines, res, x0, y0).withColumn("col", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    return cells.withColumn("cx", x0 + (F.col("col") + 0.5) * res).withColumn("cy", y0 + (F.col("row") + 0.5) * res)


TILE = 64


def ring_spans(outlines: DataFrame, cells: DataFrame, by: list[str], key: str, res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Runs of columns (by, key, row, lo, hi) whose cell centres lie inside each outline, within its raster's extent."""
    first, last = _row_range(y0, res)
    first, last = F.greatest(first, "_min_row"), F.least(last, "_max_row")
    lines = outlines.join(raster_extent(cells, by), by).select(
        *by, key, ring_edges().alias("_edges"), "_min_col", "_max_col", F.explode(F.when(first <= last, F.sequence(first, last))).alias("row")
    )
    runs = _row_runs(lines, res, x0, y0).withColumn("lo", F.greatest("_lo", "_min_col")).withColumn("hi", F.least("_hi", "_max_col"))
    return runs.filter("lo <= hi").select(*by, key, "row", "lo", "hi")


def span_totals(spans: DataFrame, cells: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Runs cut at tiles of ``TILE`` columns, each with ``n`` columns and, of its cells in the raster, ``found``: col and ``values``.

    A tile of a row travels as one row with its cells, so a run costs a lookup per tile it touches.
    """
    tile = F.floor(F.col("col") / TILE)
    rows = cells.groupBy(*by, "row", tile.alias("tile")).agg(F.collect_list(F.struct("col", *values)).alias("_cells"))  # at most TILE
    pieces = spans.withColumn("tile", F.explode(F.sequence(F.floor(F.col("lo") / TILE), F.floor(F.col("hi") / TILE))))
    pieces = pieces.withColumn("lo", F.greatest("lo", F.col("tile") * TILE)).withColumn("hi", F.least("hi", F.col("tile") * TILE + TILE - 1))
    met = pieces.join(rows, [*by, "row", "tile"], "left").withColumn("n", F.col("hi") - F.col("lo") + 1)
    inside = F.filter("_cells", lambda c: (c["col"] >= F.col("lo")) & (c["col"] <= F.col("hi")))
    return met.withColumn("found", F.coalesce(inside, F.array())).drop("_cells", "tile")


def _added(value) -> Column:
    """The sum of ``value`` over the cells of a piece."""
    return F.aggregate("found", F.lit(0.0), lambda total, c: total + value(c))


def sample(places: DataFrame, cells: DataFrame, by: list[str], ids: list[str], res: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Bilinear height at (x, y) from up to four cells; missing cells give up their weight.

    Each cell goes to the four places that read it, so a place is one row with all its heights and
    every point of ``places`` is joined once, as it is.
    """
    fx, fy = (F.col("x") - x0) / res - 0.5, (F.col("y") - y0) / res - 0.5
    spots = [(i, j) for i in (0, 1) for j in (0, 1)]
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spots]))
    sent = cells.select(*by, "col", "row", "z", moves.alias("_m"))
    corners = sent.groupBy(*by, (F.col("col") - F.col("_m.i")).alias("_c"), (F.col("row") - F.col("_m.j")).alias("_r")).agg(
        *[F.max(F.when((F.col("_m.i") == i) & (F.col("_m.j") == j), F.col("z"))).alias(f"_z{i}{j}") for i, j in spots]
    )
    met = places.withColumn("_c", F.floor(fx)).withColumn("_r", F.floor(fy)).join(corners, [*by, "_c", "_r"], "left")
    tx, ty = fx - F.col("_c"), fy - F.col("_r")
    total = weight = F.lit(0.0)
    for i, j in spots:
        z, w = F.col(f"_z{i}{j}"), (tx if i else 1 - tx) * (ty if j else 1 - ty)
        total, weight = total + F.when(z.isNotNull(), w * z).otherwise(0.0), weight + F.when(z.isNotNull(), w).otherwise(0.0)
    return met.select(*[F.col(c) for c in places.columns], F.when(weight > 1e-6, total / weight).alias("h"))


def _slopes(cells: DataFrame, by: list[str], res: float) -> DataFrame:
    """Each observed cell with its gradient; one shuffle brings the four neighbours together."""
    tags = {"e": (-1, 0), "w": (1, 0), "n": (0, -1), "s": (0, 1), "m": (0, 0)}
    moves = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(dc).alias("dc"), F.lit(dr).alias("dr")) for t, (dc, dr) in tags.items()]))
    sent = cells.select(*by, "col", "row", "z", moves.alias("_m")).select(
        *by, (F.col("col") + F.col("_m.dc")).alias("col"), (F.col("row") + F.col("_m.dr")).alias("row"), F.col("_m.t").alias("t"), "z"
    )
    wide = sent.groupBy(*by, "col", "row").agg(*[F.max(F.when(F.col("t") == t, F.col("z"))).alias(f"_{t}") for t in tags]).filter("_m is not null")

    def gradient(before: str, after: str) -> Column:
        b, m, a = F.col(before), F.col("_m"), F.col(after)
        return (
            F.when(b.isNotNull() & a.isNotNull(), (a - b) / (2 * res)).when(a.isNotNull(), (a - m) / res)
            .when(b.isNotNull(), (m - b) / res).otherwise(0.0)
        )

    return wide.select(*by, "col", "row", F.col("_m").alias("z"), gradient("_w", "_e").alias("gx"), gradient("_s", "_n").alias("gy"))


def area_statistics(outlines: DataFrame, cells: DataFrame, by: list[str], key: str, res: float) -> DataFrame:
    rough = res * res * F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    field = _slopes(cells, by, res).select(*by, "col", "row", "z", rough.alias("rough"))
    pieces = span_totals(ring_spans(outlines, cells, by, key, res), field, by, ["z", "rough"])
    heights = F.transform("found", lambda c: c["z"])
    got = pieces.groupBy(key).agg(
        F.sum("n").alias("_total"), F.sum(F.size("found")).alias("_valid"), F.sum(_added(lambda c: c["rough"])).alias("_s"),
        F.min(F.array_min(heights)).alias("z_min"), F.max(F.array_max(heights)).alias("z_max"), F.sum(_added(lambda c: c["z"])).alias("_z"),
    )
    base = outlines.select(key, ring_area().alias("planar"), ring_perimeter().alias("perimeter"))
    some = F.when(F.col("_valid") > 0, F.col("_valid"))
    return base.join(got, key, "left").select(
        key, "planar", "perimeter", (F.col("_s") * F.col("_total") / some).alias("surface"), "z_min", "z_max", (F.col("_z") / some).alias("z_mean"),
        F.coalesce(F.col("_valid") / F.col("_total"), F.lit(0.0)).alias("coverage"),
    )


def boundary_samples(outlines: DataFrame, cells: DataFrame, by: list[str], key: str, res: float) -> DataFrame:
    legs = outlines.select(*by, key, F.posexplode(ring_edges()).alias("leg", "_e"))
    n = F.greatest(F.lit(1), F.ceil(_flat(F.col("_e.a"), F.col("_e.b")) / res))
    steps = legs.select("*", n.alias("_n")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("k"))
    t = F.col("k") / F.col("_n")
    at = steps.select(
        *by, key, "leg", "k", (F.col("_e.a.x") + (F.col("_e.b.x") - F.col("_e.a.x")) * t).alias("x"),
        (F.col("_e.a.y") + (F.col("_e.b.y") - F.col("_e.a.y")) * t).alias("y"),
    )
    return sample(at, cells, by, [key, "leg", "k"], res).filter("h is not null")


def fit_planes(samples: DataFrame, key: str) -> DataFrame:
    """Least-squares plane z = a x + b y + c from centred moments; flat when under-determined."""
    middle = samples.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.avg("h").alias("_mz"), F.min("h").alias("lowest"))
    x, y, z = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"), F.col("h") - F.col("_mz")
    m = samples.join(middle, key).groupBy(key).agg(
        F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x * z).alias("xz"), F.sum(y * z).alias("yz")
    ).join(middle, key)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    flat = (F.col("_n") < 3) | (F.abs(det) < 1e-9)
    a = F.when(flat, 0.0).otherwise((F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det)
    b = F.when(flat, 0.0).otherwise((F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det)
    return m.select(key, a.alias("a"), b.alias("b"), "_mx", "_my", "_mz", "lowest", F.col("_n").alias("edge_samples")).withColumn(
        "c", F.col("_mz") - F.col("a") * F.col("_mx") - F.col("b") * F.col("_my")
    ).drop("_mx", "_my", "_mz")


def cut_fill(outlines: DataFrame, cells: DataFrame, by: list[str], key: str, res: float, base: str = "fit") -> DataFrame:
    planes = fit_planes(boundary_samples(outlines, cells, by, key, res), key)
    if base == "lowest":
        planes = planes.withColumn("a", F.lit(0.0)).withColumn("b", F.lit(0.0)).withColumn("c", F.col("lowest"))
    pieces = span_totals(ring_spans(outlines, cells, by, key, res), cells, by, ["z"])
    # an outline without boundary data measures from zero
    joined = pieces.join(planes, key, "left").fillna(0.0, ["a", "b", "c"])
    level = F.col("b") * ((F.col("row") + 0.5) * res) + F.col("c")
    above = lambda c: c["z"] - (F.col("a") * ((c["col"] + 0.5) * res) + level)
    out = joined.groupBy(key).agg(
        F.sum(_added(lambda c: F.greatest(above(c), F.lit(0.0)))).alias("_fill"), F.sum(_added(lambda c: F.greatest(-above(c), F.lit(0.0)))).alias("_cut"),
        (F.sum(F.size("found")) / F.sum("n")).alias("coverage"), F.max("edge_samples").alias("edge_samples"),
    )
    area = res * res
    return out.select(key, (F.col("_fill") * area).alias("fill"), (F.col("_cut") * area).alias("cut"),
                      ((F.col("_fill") - F.col("_cut")) * area).alias("net"), "coverage", "edge_samples")


def profile_samples(paths: DataFrame, cells: DataFrame, by: list[str], key: str, res: float) -> DataFrame:
    """Surface heights along each route at about one cell's step, with distance ``d``."""
    step = F.greatest(F.lit(res), path_length() / 2000.0)
    legs = paths.withColumn("_step", step).withColumn("_legs", F.size("ring") - 1)
    legs = legs.select(*by, key, "_step", "_legs", F.posexplode(path_legs()).alias("leg", "_e"), "ring")
    length = _flat(F.col("_e.a"), F.col("_e.b"))
    before = F.aggregate(F.slice(path_legs(), F.lit(1), F.col("leg")), F.lit(0.0), lambda s, e: s + _flat(e["a"], e["b"]))
    legs = legs.select(*by, key, "leg", "_legs", "_e", length.alias("_len"), before.alias("_acc"), F.greatest(F.lit(1), F.ceil(length / F.col("_step"))).alias("_n"))
    last = F.when(F.col("leg") == F.col("_legs") - 1, F.col("_n")).otherwise(F.col("_n") - 1)
    steps = legs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("k"))
    t = F.col("k") / F.col("_n")
    at = steps.select(
        *by, key, "leg", "k", (F.col("_acc") + F.col("_len") * t).alias("d"),
        (F.col("_e.a.x") + (F.col("_e.b.x") - F.col("_e.a.x")) * t).alias("x"),
        (F.col("_e.a.y") + (F.col("_e.b.y") - F.col("_e.a.y")) * t).alias("y"),
    )
    return sample(at, cells, by, [key, "leg", "k"], res)


def profiles(paths: DataFrame, cells: DataFrame, by: list[str], key: str, res: float) -> DataFrame:
    """Climb, descent, surface length, average and steepest grade of each route."""
    from ..scale import lag

    window = max(5.0, 4 * res)
    along = profile_samples(paths, cells, by, key, res)
    shares = along.groupBy(key).agg((F.count("h") / F.count(F.lit(1))).alias("coverage"))
    seen = along.filter("h is not null").select(key, "leg", "k", "d", "h")
    order = ["d", "leg", "k"]
    moved = ordered(seen, [key], order, {"_p": lag(F.struct("d", "h"))}, hot=False)  # at most ~2000 samples per route
    dz, dd = F.col("h") - F.col("_p.h"), F.col("d") - F.col("_p.d")
    figures = moved.groupBy(key).agg(
        F.min("h").alias("z_min"), F.max("h").alias("z_max"), F.coalesce(F.sum(F.when(dz > 0, dz)), F.lit(0.0)).alias("gain"),
        F.coalesce(F.sum(F.when(dz <= 0, -dz)), F.lit(0.0)).alias("loss"), F.coalesce(F.sum(F.sqrt(dz * dz + dd * dd)), F.lit(0.0)).alias("surface_length"),
        F.min_by(F.struct("d", "h"), F.struct(*order)).alias("_a"), F.max_by(F.struct("d", "h"), F.struct(*order)).alias("_b"),
    )
    # each sample asks for the first observed one at least a window further on
    asks = seen.select(key, (F.col("d") + window).alias("_t"), F.lit(0).alias("_kind"), "leg", "k", F.struct("d", "h").alias("_from"),
                       F.lit(None).cast("struct<d:double,h:double>").alias("_to"))
    answers = seen.select(key, F.col("d").alias("_t"), F.lit(1).alias("_kind"), "leg", "k",
                          F.lit(None).cast("struct<d:double,h:double>").alias("_from"), F.struct("d", "h").alias("_to"))
    met = ordered(asks.unionByName(answers), [key], ["_t", "_kind", "leg", "k"], {"_hit": next_known(F.col("_to"))}, hot=False)
    steep = met.filter("_kind = 0 and _hit is not null").groupBy(key).agg(
        F.max(F.abs(F.col("_hit.h") - F.col("_from.h")) / (F.col("_hit.d") - F.col("_from.d"))).alias("steepest")
    )
    base = paths.select(key, path_length().alias("length"))
    out = base.join(shares, key).join(figures, key, "left").join(steep, key, "left")
    grade = F.when(F.col("_b.d") > F.col("_a.d"), (F.col("_b.h") - F.col("_a.h")) / (F.col("_b.d") - F.col("_a.d")))
    return out.withColumn("average_grade", grade).drop("_a", "_b").fillna(0.0, ["steepest", "gain", "loss", "surface_length"])


def sight_lines(pairs: DataFrame, cells: DataFrame, by: list[str], key: str, res: float, clearance: float = 0.15) -> DataFrame:
    """Whether a straight line clears the surface, where it is first blocked, and the unknown share so far."""
    dx, dy, dz = [F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"]
    length = F.sqrt(dx * dx + dy * dy + dz * dz)
    lines = pairs.withColumn("_len", length)
    lines = lines.withColumn("_step", F.greatest(F.lit(res * 0.5), F.col("_len") / 4000.0)).withColumn(
        "_skip", F.least(F.lit(2.0), F.col("_len") * 0.05)
    )
    count = F.ceil((F.col("_len") - 2 * F.col("_skip")) / F.col("_step"))
    walked = lines.filter(F.col("_len") > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), count)).alias("k"))
    walked = walked.withColumn("t", F.col("_skip") + F.col("k") * F.col("_step")).filter(F.col("t") < F.col("_len") - F.col("_skip"))
    f = F.col("t") / F.col("_len")
    at = walked.select(*by, key, "k", "t", (F.col("ax") + dx * f).alias("x"), (F.col("ay") + dy * f).alias("y"), (F.col("az") + dz * f).alias("_line"))
    seen = sample(at, cells, by, [key, "k"], res)
    hit = seen.filter(F.col("h") > F.col("_line") + clearance).groupBy(key).agg(F.min(F.struct("k", "t", "h")).alias("_hit"))
    upto = seen.join(hit, key, "left").filter(F.col("_hit").isNull() | (F.col("k") <= F.col("_hit.k")))
    shares = upto.groupBy(key).agg((F.count_if(F.col("h").isNull()) / F.count(F.lit(1))).alias("unknown"))
    angle = F.degrees(F.atan2(dz, F.sqrt(dx * dx + dy * dy)))
    return lines.select(key, F.col("_len").alias("distance"), angle.alias("look_angle")).join(hit, key, "left").join(shares, key, "left").select(
        key, "distance", "look_angle", F.col("_hit").isNull().alias("visible"), F.col("_hit.t").alias("blocked_at"),
        F.col("_hit.h").alias("obstruction_z"), F.coalesce("unknown", F.lit(0.0)).alias("unknown"),
    )


def ground_outlines(views: DataFrame, key: str, ground_z: Column, flying_height: Column) -> DataFrame:
    """Outline of each view on the ground plane from 13 border rays per side.

    ``views`` carries the camera centre, a camera-to-world quaternion and intrinsics. Rays that
    miss the ground or reach beyond twice the flying height stop at that range.
    """
    from ..functions.camera import rotation, times

    border = [(i, u, v) for i, (u, v) in enumerate(
        [(k / 12.0, 0.0) for k in range(13)] + [(1.0, k / 12.0) for k in range(13)]
        + [(1 - k / 12.0, 1.0) for k in range(13)] + [(0.0, 1 - k / 12.0) for k in range(13)]
    )]
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(u).alias("u"), F.lit(v).alias("v")) for i, u, v in border]))
    cast = views.withColumn("_s", spots)
    ray = [(F.col("_s.u") * F.col("w") - F.col("pcx")) / F.col("fx"), (F.col("_s.v") * F.col("h") - F.col("pcy")) / F.col("fy"), F.lit(1.0)]
    rx, ry, rz = times(rotation(*[F.col(f"q{c}") for c in "wxyz"]), ray)
    cast = cast.select(key, F.col("_s.i").alias("i"), "cx", "cy", "cz", rx.alias("rx"), ry.alias("ry"), rz.alias("rz"),
                       ground_z.alias("gz"), (2.0 * flying_height).alias("far"))
    flat = F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry"))
    scale = F.when(F.col("rz") < 0, (F.col("gz") - F.col("cz")) / F.col("rz"))
    held = F.when(scale.isNull() | (scale * flat > F.col("far")), F.when(flat >= 1e-9, F.col("far") / flat)).otherwise(scale)
    out = cast.withColumn("_k", held).filter("_k is not null").select(
        key, "i", (F.col("cx") + F.col("_k") * F.col("rx")).alias("x"), (F.col("cy") + F.col("_k") * F.col("ry")).alias("y"), F.lit(0.0).alias("z")
    )
    return rings(out, [key]).filter(F.size("ring") >= 3)
