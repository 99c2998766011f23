"""Faults of the third round's findings, each on a small table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import common, pieces
from skyledger.operators import metric_index
from skyledger.plans import streams
from skyledger.sources import sinks, telemetry
from skyledger.streaming import jobs


def test_decimals_are_those_of_the_binary_value(spark, duckdb_tables):
    values = [0.845, 2.845, 8.495, 2.985, 1.005, 2.675, 0.125, 0.375, -0.845, -0.125, -0.001, 0.0, 7.0, 99.995, 9.999, 1e-9, 123456.785, 1e17]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 8, 10):
        got = [r.t for r in rows.select(sinks.fixed_decimals(F.col("v"), digits).alias("t")).collect()]
        want = [duckdb_tables.execute(f"SELECT printf('%.{digits}f', {v!r}::DOUBLE)").fetchone()[0] for v in values]
        assert got == want, digits


def test_subtitle_times_beyond_hundred_hours(spark):
    block = "7\n{}:00:01,500 --> {}:00:02,000\nlatitude: 1.5 longitude: 2.5 abs_alt: 3.0"
    rows = spark.createDataFrame([(block.format(h, h),) for h in ("99", "100", "1234")], "block string")
    assert sorted(r.time_s for r in telemetry.parse_subtitles(rows).collect()) == [99 * 3600 + 1.5, 100 * 3600 + 1.5, 1234 * 3600 + 1.5]


def test_silences_of_a_key_that_comes_in_parts():
    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            return self.kept

        def update(self, row):
            self.kept = row

    class Handle:
        def getValueState(self, *_):
            return Value()

        def listTimers(self):
            return []

        def registerTimer(self, at):
            self.timer = at

    processor, handle = jobs.SilenceProcessor(5.0), Handle()
    processor.init(handle)
    parts = [pd.DataFrame({"sample_id": ids, "at_s": [float(i) for i in ids]}) for ids in ([20, 4, 12], [8, 16, 30], [0, 24])]
    out = pd.concat(processor.handleInputRows((1,), iter(parts), None))
    assert out["sample_id"].tolist() == [24] and processor.state.get() == (30, 30.0) and handle.timer == 35001


def test_silence_after_a_sample_at_time_zero(spark, tmp_path):
    from skyledger.plans.streams import telemetry_silence_stream

    rows = spark.createDataFrame([(e, 1, "view", 1.0) for e in (0, 700)], "event_id long, user_id long, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = telemetry_silence_stream(spark, str(tmp_path)).select("sample_id", "silent_from_s").collect()
    assert sorted(map(tuple, got)) == [(0, 5.0), (700, 75.0)]


def test_a_sampled_place_is_joined_once(spark):
    from skyledger.operators import terrain

    cells = spark.createDataFrame([(1, c, r, 10.0 * c + r) for c in range(3) for r in range(3) if (c, r) != (1, 1)], "g int, col long, row long, z double")
    places = spark.createDataFrame([(1, 0, 0.5, 0.5), (1, 1, 1.25, 0.5), (1, 2, 1.0, 1.0), (1, 3, 9.0, 9.0), (2, 4, 0.5, 0.5)], "g int, k int, x double, y double")
    out = terrain.sample(places, cells, ["g"], ["k"], 1.0)
    got = {r.k: r.h for r in out.collect()}
    # cell (1, 1) is missing, so its weight goes to the other three
    assert got == {0: 0.0, 1: 7.5, 2: (0.0 + 1.0 + 10.0) / 3, 3: None, 4: None}
    # no copies of places are joined, grouped and joined back, which the driver had to broadcast
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_cells_of_an_outline_come_from_its_runs(spark):
    from skyledger.operators import terrain

    # a sliver along the diagonal: 4,000 rows of three cells in a box of 16 million
    corners = [(0.0, 0.0), (4000.0, 4000.0), (4003.0, 4000.0), (3.0, 0.0)]
    rows = [(1, i, x, y, 0.0) for i, (x, y) in enumerate(corners)]
    outlines = terrain.rings(spark.createDataFrame(rows, "k int, i int, x double, y double, z double"), ["k"])
    cells = terrain.ring_cells(outlines, 1.0)
    got = cells.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("col").alias("first")).collect()
    assert len(got) == 4000 and {(r.n, r.first - r.row) for r in got} == {(3, 0)}
    # rows, then runs, then the columns of a run: not the whole box
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 3


def test_samples_meet_the_stages_of_their_slice_alone(spark):
    at = lambda s: F.timestamp_millis(F.expr(f"cast({s} * 1000 as bigint) + 86400000"))
    samples = spark.range(600).selectExpr("id AS sample_id", "id % 2 AS host_id", "id / 2 AS s", "'5' AS utilization_gpu_percent")
    # Lengths of 0 to 34 seconds, some longer than the 20 seconds that are looked back, some ending before they start.
    stages = spark.range(120).selectExpr("id AS stage_id", "id % 2 AS host_id", "id * 2.0 AS a", "id * 2.0 + id % 36 - 1 AS b")
    joined = jobs.stage_samples(
        samples.select("sample_id", "host_id", at("s").alias("ts"), "utilization_gpu_percent"),
        stages.select("stage_id", "host_id", at("a").alias("start_ts"), at("b").alias("end_ts")), "30 seconds", "20 seconds",
    )
    got = sorted((r["stage_id"], r["sample_id"]) for r in joined.collect())
    pairs = [(g, s) for g in stages.collect() for s in samples.collect() if s["host_id"] == g["host_id"]]
    assert got == sorted((g["stage_id"], s["sample_id"]) for g, s in pairs if g["a"] <= s["s"] <= g["b"] <= s["s"] + 20)
    keys = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in keys.split("Join Inner")[1].splitlines()[0]


def test_only_a_slice_of_a_batch_is_strings(monkeypatch):
    asked = []

    class Batch:  # a record batch that notes how many texts become Python strings at once
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def column(self, name):
            return Texts(self.batch.column(name))

        def slice(self, at, n):
            return self.batch.slice(at, n)

    class Texts:
        def __init__(self, texts):
            self.texts = texts

        def __arrow_array__(self, type=None):
            return self.texts

        def slice(self, at, n):
            return Texts(self.texts.slice(at, n))

        def to_pylist(self):
            asked.append(len(self.texts))
            return self.texts.to_pylist()

    texts = ["ab", None, "", "üüü", "abcdef", None, "a"] * 30
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    monkeypatch.setattr(common.pc, "utf8_length", lambda t, real=common.pc.utf8_length: real(t.texts))
    out = list(common.sliced([Batch(batch)], "text", 12))
    assert [t for _, ts in out for t in ts] == [t or "" for t in texts]
    assert all(b.num_rows == len(ts) and sum(map(len, ts)) < 12 + 6 for b, ts in out)
    assert max(asked) < 20 and len(out) > 20


def test_an_encoder_bounds_the_words_it_keeps():
    encoder = pieces.ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.first.age <= 50_000 and encoder.rest.age <= 200_000


def test_vectors_that_pivots_do_not_tell_apart_are_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 16))
    v = np.concatenate([v, v[:100] + 0.01 * rng.normal(size=(100, 16))])
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i % 2, i, x.tolist()) for i, x in enumerate(v)], "s int, id long, d array<double>")
    monkeypatch.setattr(metric_index, "PART_VECTORS", 8)
    written = []
    cut = metric_index.cut_lineage
    monkeypatch.setattr(metric_index, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    got = sorted((r["s"], *sorted((r["a"], r["b"]))) for r in metric_index.similar_pairs(rows, ["s"], "id", "d", 0.8).collect())
    dots = v @ v.T
    assert got == sorted((i % 2, i, j) for i in range(500) for j in range(i + 1, 500) if i % 2 == j % 2 and dots[i, j] > 0.8)
    assert sum(w.count() for w in written if {"d", "_guest"} <= set(w.columns)) <= 2 * 500  # every vector, dealt and numbered


def test_raster_chunks_grow_in_number_not_in_size(spark, monkeypatch):
    asked = []
    real = jobs.file_stream
    monkeypatch.setattr(jobs, "file_stream", lambda s, like, path, files_per_batch=None: asked.append((path, files_per_batch)) or real(s, like, path, files_per_batch))
    monkeypatch.setattr(streams, "CHUNK_POINTS", 500)
    rows = streams.incremental_raster_stream(spark, "/root/testdata/sf0.001")
    (path, per_batch), = asked
    files = len(spark.read.parquet(path).inputFiles())
    n = spark.read.parquet(path).count()
    assert files >= n / 500 and per_batch * 3 == files
    assert rows.agg(F.sum("n")).first()[0] == n


@pytest.mark.parametrize("dims", [["x", "y"], ["x", "y", "z"]])
def test_curve_code_names_each_coordinate_once(spark, dims):
    """F6, F7, F8: nested steps held 32 copies of every coordinate and took most of the time of the join."""
    from skyledger.operators.neighbors import with_morton

    rng = np.random.default_rng(3)
    points = np.vstack([rng.uniform(-5, 5, (40, len(dims))), np.full((1, len(dims)), 5.0), np.full((1, len(dims)), -5.0)])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], ", ".join(f"{d} double" for d in dims))
    got = with_morton(df, dims, [-5.0] * len(dims), 10.0, "code")
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("floor(") == len(dims)
    bits = 62 // len(dims)
    for row in got.collect():
        cells = [min(math.floor((row[d] + 5.0) / 10.0 * (1 << bits)), (1 << bits) - 1) for d in dims]
        assert row["code"] == sum((c >> b & 1) << (b * len(dims) + i) for i, c in enumerate(cells) for b in range(bits))


def test_source_far_from_every_target_asks_all_parts_it_may_touch(spark, monkeypatch):
    """F6, F7, F8: boxes are looked up by blocks of sources; part by part the result stays exact, ties included."""
    from skyledger.operators import neighbors

    monkeypatch.setattr(neighbors, "PART_ROWS", 30)
    monkeypatch.setattr(neighbors, "ASKERS", 8)
    rng = np.random.default_rng(4)
    sources = np.vstack([rng.integers(0, 9, (60, 2)), rng.integers(40, 49, (120, 2))]).astype(float)
    targets = np.unique(rng.integers(0, 12, (200, 2)), axis=0).astype(float)
    s = spark.createDataFrame([(1, *map(float, p)) for p in sources], "g int, x double, y double")
    t = spark.createDataFrame([(1, *map(float, p), 1) for p in targets], "g int, x double, y double, _n bigint")
    for k in (1, 5):
        got = {(r["_s_x"], r["_s_y"], r["x"], r["y"]) for r in neighbors.neighbours(s, t, ["g"], ["x", "y"], k).collect()}
        d2 = ((sources[:, None] - targets[None]) ** 2).sum(-1)
        near = d2 <= np.sort(d2, axis=1)[:, k - 1 : k]
        assert got == {(*sources[i], *targets[j]) for i, j in zip(*np.nonzero(near))}


def test_mesh_and_nearest_joins_are_not_broadcast(spark):
    """vertices and distances, as many as faces, were sent to the driver because they compress well."""
    from skyledger.operators import graphs, neighbors

    faces = spark.createDataFrame([(1, 1, 1, 2, 3), (1, 2, 2, 3, 4)], "mesh_id int, face_id int, a int, b int, c int")
    vertices = spark.createDataFrame([(1, v, v * 1.0, v % 2 * 1.0, 0.0) for v in range(1, 5)], "mesh_id int, vertex_id int, x double, y double, z double")
    measured = graphs.longest_edges(faces, vertices, ["mesh_id"])
    near = neighbors.nearest_distance(measured, vertices, ["mesh_id"])
    for df in (measured, near):
        assert df.count() == 2
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_scan_of_the_overlap_join_takes_bounded_batches(spark, monkeypatch):
    """pipeline, op4: texts, histograms and whole sets came to the later scans 10,000 rows at a time."""
    from skyledger.llm import overlap_join

    sizes, usual = [], overlap_join.cut_lineage

    def noted(df):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            sizes.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        return usual(df)

    monkeypatch.setattr(overlap_join, "cut_lineage", noted)
    words = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(i, words + f" {i}") for i in range(4)] + [(9, "a b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in overlap_join.overlap_join(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert len(sizes) == 5 and set(sizes) == {"4m"}


@pytest.mark.parametrize("part_rows", [60, 40_000])
def test_settled_sources_are_one_row_with_their_sum(spark, monkeypatch, part_rows):
    """13 rows of every source were written and shuffled to be summed."""
    from skyledger.operators import neighbors

    monkeypatch.setattr(neighbors, "PART_ROWS", part_rows)
    rng = np.random.default_rng(6)
    xyz = rng.integers(0, 6, (200, 3)).astype(float)  # many copies and ties
    points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(xyz)], "g int, item int, x double, y double, z double")
    found = neighbors.neighbours(points, neighbors._folded(points, ["g"], ["x", "y", "z"]), ["g"], ["x", "y", "z"], 13, sums=True)
    settled = found.filter("_upto is null").groupBy("_s_x", "_s_y", "_s_z").count().collect()
    assert all(r["count"] == 1 for r in settled) and (part_rows == 60 or len(settled) == len(np.unique(xyz, axis=0)))
    got = {r["item"]: r["mean_distance"] for r in neighbors.mean_neighbour_distance(points, ["g"]).collect()}
    d = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)), axis=1)[:, 1:13].mean(1)
    assert np.allclose([got[i] for i in range(200)], d)
