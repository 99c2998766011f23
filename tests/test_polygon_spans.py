"""Runs of columns inside outlines beside the even-odd rule cell by cell, crossed and degenerate outlines included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import terrain


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def outlines_of(spark, shapes):
    rows = [(k, g, i, float(x), float(y), 0.0) for k, (g, ring) in shapes.items() for i, (x, y) in enumerate(ring)]
    corners = spark.createDataFrame(rows, "k long, g long, i int, x double, y double, z double")
    return terrain.rings(corners, ["k", "g"])


@pytest.mark.parametrize("tile, res", [(4, 1.0), (64, 0.5), (64, 1.0)])
def test_spans_equal_cells(spark, monkeypatch, tile, res):
    monkeypatch.setattr(terrain, "TILE", tile)
    rng = random.Random(6)
    raster = {(g, c, r): rng.uniform(-3, 9) for g in (0, 1) for c in range(-5, 40) for r in range(-3, 30) if rng.random() < 0.8}
    shapes = {k: (k % 2, [(rng.uniform(-9, 45), rng.uniform(-6, 33)) for _ in range(rng.randrange(3, 9))]) for k in range(12)}  # mostly crossed
    shapes |= {20: (0, [(2.5, 2.5), (8.5, 2.5), (8.5, 8.5), (2.5, 8.5)]), 21: (1, [(3, 3), (9, 9), (3, 9), (9, 3)]), 22: (0, [(5, 5), (5, 5), (5, 5)]),
               23: (0, [(900, 900), (905, 900), (900, 905)]), 24: (7, [(1, 1), (9, 1), (5, 9)]), 25: (0, [(0.5 * i, 4.5 + i % 2) for i in range(9)])}
    cells = spark.createDataFrame([(g, c, r, z) for (g, c, r), z in raster.items()], "g long, col long, row long, z double")
    spans = terrain.ring_spans(outlines_of(spark, shapes), cells, ["g"], "k", res)
    pieces = terrain.span_totals(spans, cells, ["g"], ["z"]).collect()
    got = {k: [0, {}] for k in shapes}
    for p in pieces:
        got[p["k"]][0] += p["n"]
        for c in p["found"]:
            assert (c["col"], p["row"]) not in got[p["k"]][1]
            got[p["k"]][1][c["col"], p["row"]] = c["z"]
    for k, (g, ring) in shapes.items():
        mine = [(c, r) for h, c, r in raster if h == g]
        box = (min(c for c, _ in mine), max(c for c, _ in mine), min(r for _, r in mine), max(r for _, r in mine)) if mine else (1, 0, 1, 0)
        want = [(c, r) for c in range(box[0], box[1] + 1) for r in range(box[2], box[3] + 1) if inside((c + 0.5) * res, (r + 0.5) * res, ring)]
        assert got[k][0] == len(want)
        assert got[k][1] == {(c, r): raster[g, c, r] for c, r in want if (g, c, r) in raster}
    listed = terrain.ring_cells(outlines_of(spark, {k: shapes[k] for k in (20, 21)}), res).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["k"]: r["n"] for r in listed} == {k: got[k][0] for k in (20, 21)}
