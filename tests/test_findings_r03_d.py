"""Faults of the third round's findings that the check tool showed, each on a small table."""

from __future__ import annotations

import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from skyledger.llm import kneser_ney, pieces
from skyledger.operators import coverage, windows

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_many_texts_are_encoded_by_rows_of_pieces(monkeypatch):
    rng = random.Random(7)
    bits = [*"ab c\n\t. ,éßİı中\xa0　' 1Ġ\r", "<|endoftext|>", " the", "naïve", "it's", "\n\n", " \xa0", "."]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(4_000)]
    texts += ["", " ", "\n", "\n ", " a", "a\n", " ".join(f"word{'abc' * (k % 5)}" for k in range(2_000))]
    monkeypatch.setattr(pieces, "TOGETHER_CHARS", 0)
    for width, plain in ((2, False), (4, True)):
        tok = pieces.load_tokenizer(BYTES, plain)
        whole = [np.array(e.ids, f"<u{width}").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert pieces.ByteLevelEncoder(BYTES, width, plain).encode(texts) == whole
    encoder = pieces.ByteLevelEncoder(BYTES)
    single = []
    monkeypatch.setattr(encoder, "_whole", lambda text, real=encoder._whole: single.append(text) or real(text))
    words = [" ".join("".join(rng.choices("etaoin", k=7)) + rng.choice(["", ",", "."]) for _ in range(300)) for _ in range(20)]
    ids = [np.array(e.ids, "<u2").tobytes() for e in encoder.tok.encode_batch(words, add_special_tokens=False)]
    assert encoder.encode(words) == ids and set(single) <= {" "}  # no word is encoded by itself


def test_anchors_read_the_flown_path_and_the_seeds_once(spark):
    def counted(df, column, kind):
        read = spark.sparkContext.accumulator(0)

        def seen(x):
            read.add(1)
            return x

        return df.withColumn(column, F.udf(seen, kind)(column)), read

    clips = spark.createDataFrame([(1, 40), (2, 90)], "flight_id long, total long")
    path = spark.createDataFrame([(f, float(t), 3.0 * t) for f in (1, 2) for t in range(20)], "flight_id long, time_s double, path_m double")
    path, path_read = counted(path, "path_m", "double")
    seeds, seeds_read = counted(windows.anchor_seeds(clips, path, "flight_id", 2.0, 12), "anchor", "long")
    rows = windows.fill_anchors(seeds, clips, "flight_id", 12).collect()
    assert sorted((r["flight_id"], r["anchor"]) for r in rows) == sorted({(r["flight_id"], r["anchor"]) for r in rows})
    assert [sum(r["flight_id"] == f for r in rows) for f in (1, 2)] == [12, 12]
    assert path_read.value == 40
    assert seeds_read.value <= 2 * 14  # at most target + 2 of each flight


def test_a_pixel_asks_a_source_view_for_one_square_of_points(spark):
    rng = np.random.default_rng(3)
    world = [(f, 4 * v + u, u, v, *map(float, rng.normal(size=3) * 0.3 + [0.2 * u, 0.2 * v, 4.0])) for f in (0, 1) for u in range(4) for v in range(4) if (u, v, f) != (1, 1, 1)]
    views = [(0, 1, 1.0, 0.0, 0.0, 0.0, 0.1, 0.0, 0.0), (1, 0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.0)]
    out = coverage.consistent_points(
        spark.createDataFrame(world, "frame_id long, pixel long, u long, v long, x double, y double, z double"),
        spark.createDataFrame(views, "frame_id long, source_id long, " + ", ".join(f"{c} double" for c in "qw qx qy qz tx ty tz".split())),
        8.0, 8.0, 0.5, 0.5, 4, 3.0, 1,
    )
    point = {(f, u, v): np.array(p) for f, _, u, v, *p in world}
    want = {}
    for f, k, u, v, *p in world:
        s = 1 - f
        d = np.array(p) - views[f][6:]
        pu, pv = 8.0 * d[0] / d[2] + 0.5, 8.0 * d[1] / d[2] + 0.5
        c, r = math.floor(pu), math.floor(pv)
        near = [(abs(1 - i - pu + c) * abs(1 - j - pv + r), point.get((s, c + i, r + j))) for i in (0, 1) for j in (0, 1)]
        near = [w * q for w, q in near if q is not None]
        if near and np.linalg.norm(sum(near) - p) < 3.0:
            want[f, k] = (np.array(p) + sum(near)) / 2
    rows = out.collect()
    got = {(r["frame_id"], r["pixel"]): [r["mean_x"], r["mean_y"], r["mean_z"]] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(want) > 10
    assert all(np.allclose(got[k], want[k]) for k in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "pixel" in x and "source_id" in x]  # no second shuffle of four rows a pixel


def test_a_group_of_texts_stays_below_a_doubling_of_its_buffer():
    # Groups are dealt by rows, so their bytes vary about the bound; beyond a power of two the buffers take twice as much.
    assert kneser_ney.GROUP_BYTES * 5 // 4 <= 32 << 20
