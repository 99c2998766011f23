"""Neighbour joins, thinning and components beside brute force, with dense clusters and copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyledger.operators import coverage, graphs, neighbors, scoring


def cloud(spark, seed: int, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    spread = rng.uniform(0, 100, (n, 3))
    tight = rng.normal(50, 0.001, (n // 2, 3))  # a third of the points in one spot
    copies = np.repeat([[10.0, 10.0, 10.0]], n // 4, axis=0)
    xyz = np.vstack([spread, tight, copies, [[500.0, -300.0, 40.0]]])
    return pd.DataFrame(xyz, columns=["x", "y", "z"]).assign(g=1, item=range(len(xyz)))


@pytest.mark.parametrize("rows", [7, 90, 40_000])
def test_nearest_distance(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbors, "PART_ROWS", rows)
    a, b = cloud(spark, 1, 300), cloud(spark, 2, 200)
    got = neighbors.nearest_distance(spark.createDataFrame(a), spark.createDataFrame(b), ["g"]).toPandas().sort_values("item")
    want = np.sqrt(((a[["x", "y", "z"]].to_numpy()[:, None] - b[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(-1)).min(1)
    assert np.allclose(got["distance"], want)


@pytest.mark.parametrize("rows", [20, 40_000])
def test_mean_neighbour_distance(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbors, "PART_ROWS", rows)
    a = cloud(spark, 3, 200)
    got = neighbors.mean_neighbour_distance(spark.createDataFrame(a), ["g"], 12).toPandas().sort_values("item")
    d = np.sqrt(((a[["x", "y", "z"]].to_numpy()[:, None] - a[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(-1))
    want = np.sort(d, axis=1)[:, 1:13].mean(1)
    assert np.allclose(got["mean_distance"], want)


@pytest.mark.parametrize("rows, radius", [(25, 30.0), (40_000, 30.0), (25, 120.0), (40_000, 1.0)])
def test_nearest_ids_with_copies(spark, monkeypatch, rows, radius):
    monkeypatch.setattr(neighbors, "PART_ROWS", rows)
    a = cloud(spark, 4, 80)
    got = neighbors.nearest_ids(spark.createDataFrame(a), ["g"], "item", 4, radius, ("x", "y", "z")).collect()
    xyz = a[["x", "y", "z"]].to_numpy()
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    want = set()
    for i in range(len(a)):
        near = sorted((round(v, 9), j) for j, v in enumerate(d[i]) if v <= radius)[:4]
        want |= {(i, j) for _, j in near}
    assert {(r["item"], r["neighbour"]) for r in got} == want
    assert max(r["distance"] for r in got) <= radius


@pytest.mark.parametrize("rows", [4, 40_000])
def test_ties_go_to_the_lower_item(spark, monkeypatch, rows):
    monkeypatch.setattr(neighbors, "PART_ROWS", rows)
    points = [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, -1.0, 0.0), (1, 3, 0.0, 1.0), (2, 9, 0.0, 0.0), (2, 4, 0.0, -1.0)]
    points += [(3, 100 + i * 9 + j, float(i), float(j)) for i in range(9) for j in range(9)]  # a grid, all ties
    df = spark.createDataFrame(points, "g long, item long, x double, y double")
    for k in (2, 3, 6):
        got = {(r["item"], r["neighbour"], r["place"]) for r in neighbors.nearest_ids(df, ["g"], "item", k, 5.0, ("x", "y")).collect()}
        want = set()
        for g, i, x, y in points:
            near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for h, j, u, v in points if h == g)[:k]
            want |= {(i, j, p) for p, (d, j) in enumerate(near, 1) if d <= 25}
        assert got == want


def test_groups_apart_and_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PART_ROWS", 15)
    rng = np.random.default_rng(8)
    a = [(int(g), float(x), float(y)) for g, (x, y) in zip(rng.integers(0, 6, 200), rng.uniform(-50, 50, (200, 2)))] + [(7, 1.0, 1.0), (None, 0.0, 0.0), (1, None, 2.0)]
    b = [(int(g), float(x), float(y)) for g, (x, y) in zip(rng.integers(0, 5, 150), rng.normal(30, 2, (150, 2)))] * 2
    kinds = "g long, x double, y double"
    got = neighbors.nearest_distance(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), ["g"], ("x", "y")).collect()
    assert len(got) == len(a)
    for r in got:
        near = [np.hypot(r["x"] - x, r["y"] - y) for g, x, y in b if None not in (r["g"], r["x"]) and g == r["g"]]
        assert (r["distance"] is None) == (not near) and (not near or np.isclose(r["distance"], min(near)))
    nothing = spark.createDataFrame([], kinds)
    assert neighbors.nearest_distance(nothing, spark.createDataFrame(b, kinds), ["g"], ("x", "y")).count() == 0
    assert neighbors.nearest_distance(spark.createDataFrame(b, kinds), nothing, ["g"], ("x", "y")).filter("distance is not null").count() == 0


def test_thinning_equals_the_sequential_pass(spark):
    a = cloud(spark, 5, 150).drop_duplicates(["x", "y", "z"])
    df = spark.createDataFrame(a)
    order = df.select("item", F.xxhash64(F.lit(42), "item").alias("h")).toPandas().set_index("item")["h"]
    rows = a.assign(h=a["item"].map(order)).sort_values(["h", "item"])
    xyz, kept, open_ = rows[["x", "y", "z"]].to_numpy(), set(), np.ones(len(rows), bool)
    for i in range(len(rows)):
        if open_[i]:
            kept.add(int(rows["item"].iloc[i]))
            open_ &= ~(((xyz - xyz[i]) ** 2).sum(1) <= 15.0**2)
    assert {r["item"] for r in neighbors.thin_by_radius(df, ["g"], "item", 15.0).collect()} == kept


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(1, i, i + 1) for i in range(60)]
    star = [(1, 1000, 1001 + i) for i in range(40)]
    edges = spark.createDataFrame(chain + star, "g int, a bigint, b bigint")
    nodes = edges.select("g", F.col("a").alias("n")).union(edges.select("g", "b")).distinct()
    got = {r["n"]: r["label"] for r in graphs.components(nodes, edges, ["g"], "n").collect()}
    assert {v for k, v in got.items() if k <= 60} == {0}
    assert {v for k, v in got.items() if k >= 1000} == {1000}


def test_greedy_coverage(spark):
    rng = np.random.default_rng(6)
    seen = {(v, int(c)) for v in range(12) for c in rng.integers(0, 40, 15)}
    df = spark.createDataFrame([(0, v, c) for v, c in seen], "site int, view_id int, cell int")
    chosen, report = coverage.greedy_coverage(df, ["site"], 5, 2)
    need = {c: min(2, sum(1 for v in range(12) if (v, c) in seen)) for _, c in seen}
    want, left = [], set(range(12))
    for _ in range(5):
        best = max(left, key=lambda v: (sum(1 for w, c in seen if w == v and need[c] > 0), -v))
        want.append(best)
        left.discard(best)
        for w, c in seen:
            if w == best:
                need[c] -= 1
    assert [r.view_id for r in chosen.orderBy("step").collect()] == want
    assert abs(report.first().met_percent - 100 * np.mean([n <= 0 for n in need.values()])) < 1e-9


def test_surface_scores_of_shifted_points(spark):
    rows = [("reconstruction", 1.0, 0.0, 0.0), ("reconstruction", 6.0, 0.0, 0.0), ("reference", 0.0, 0.0, 0.0), ("reference", 5.0, 0.0, 0.0)]
    points = spark.createDataFrame([(1, *r) for r in rows], "g int, cloud string, x double, y double, z double")
    d = scoring.both_ways(points, ["g"])
    assert {r.distance for r in d.collect()} == {1.0}
    f1 = {r.threshold_m: r.f1 for r in scoring.threshold_scores(d, ["g"], [0.5, 1.0]).collect()}
    assert f1 == {0.5: 0.0, 1.0: 1.0}


def test_surface_score_with_missing_half(spark):
    rows = [("reconstruction", 0.0), ("reference", 0.0), ("reference", 10.0)]
    points = spark.createDataFrame([(1, c, x, 0.0, 0.0) for c, x in rows], "g int, cloud string, x double, y double, z double")
    got = scoring.threshold_scores(scoring.both_ways(points, ["g"]), ["g"], [0.1]).first()
    assert (got.precision, got.recall, round(got.f1, 9)) == (1.0, 0.5, round(2 / 3, 9))


@pytest.mark.parametrize("hot", [3, 100_000])
def test_giant_component(spark, monkeypatch, hot):
    monkeypatch.setattr(graphs, "HOT_LINKS", hot)
    rng = np.random.default_rng(4)
    star = [(1, 5_000, int(k)) for k in range(900)]  # nine tenths of the nodes hang on one
    chain = [(1, k, k + 1) for k in range(6_000, 6_040)] + [(1, 5_000, 6_000)]
    small = [(1, int(a), int(b)) for a, b in rng.integers(7_000, 7_100, (60, 2))] + [(2, 1, 2), (2, 2, 2), (2, 5, 4)]
    rows = star + chain + small + star[:20]
    nodes = {(g, x) for g, a, b in rows for x in (a, b)} | {(3, 9)}
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for g, a, b in rows:
        x, y = sorted((find((g, a)), find((g, b))))
        top[y] = x
    edges = spark.createDataFrame(rows, "g long, a long, b long").repartition(4)
    got = graphs.components(spark.createDataFrame(sorted(nodes), "g long, n long"), edges, ["g"], "n").collect()
    assert {(r["g"], r["n"]): (r["g"], r["label"]) for r in got} == {x: find(x) for x in nodes} and len(got) == len(nodes)
