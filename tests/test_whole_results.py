"""Results that must not depend on size, line endings or a lucky draw."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from skyledger import session
from skyledger.operators import coverage, similarity, validation, windows
from skyledger.sources import sinks, telemetry


def test_fingerprint_is_the_same_however_ranks_are_found(spark, monkeypatch):
    rows = spark.range(25).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    entry = F.concat(F.lit("e"), F.col("o").cast("string"))
    entries = [f"e{i}" for i in range(25)]
    plain = hashlib.sha256(",".join(entries).encode()).hexdigest()
    got = [sinks.fingerprint(rows, "k", ["o"], entry, ",", hot=hot).first() for hot in (False, True)]
    assert got[0] == got[1] and (got[0].sha256, got[0].method, got[0].entries) == (plain, "stream", 25)
    monkeypatch.setattr(sinks, "BLOCK_ENTRIES", 10)
    parts = [hashlib.sha256(",".join(entries[i : i + 10]).encode()).hexdigest() for i in (0, 10, 20)]
    tree = hashlib.sha256("".join(parts).encode()).hexdigest()
    for hot in (False, True):
        r = sinks.fingerprint(rows, "k", ["o"], entry, ",", hot=hot).first()
        assert (r.sha256, r.method, r.entries) == (tree, "blocks", 25)


def test_subtitles_of_both_line_endings(spark, tmp_path):
    block = "{n}\n00:00:0{n},000 --> 00:00:0{n},500\nlatitude: 1.5 longitude: 2.5 abs_alt: {n}.0"
    text = "\n\n".join(block.format(n=n) for n in range(1, 6))
    (tmp_path / "a.srt").write_bytes(text.encode())
    (tmp_path / "b.srt").write_bytes(text.replace("\n", "\r\n").encode())
    rows = telemetry.read_subtitles(spark, str(tmp_path))
    assert sorted(r.altitude_m for r in rows.collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_rows_with_unreadable_numbers_go(spark, tmp_path):
    lines = ["time_s,latitude,longitude,altitude_m,yaw", "0,1,2,3,4", "1,1,2,3,north", "2,1,2,3,", "x,1,2,3,4"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    rows = telemetry.read_csv(spark, str(tmp_path / "t.csv")).collect()
    assert sorted((r.time_s, r.yaw_deg) for r in rows) == [(0.0, 4.0), (2.0, None)]


def test_consensus_needs_three_that_agree(spark):
    wild = [(1, k, float(k), float(k * k % 7), float(k % 3), float(k * 997 % 83), float(k * 31 % 57), float(k * 7919 % 91)) for k in range(6)]
    good = [(2, k, float(k), float(k * k % 7), float(k % 3), k + 1.0, k * k % 7 + 2.0, k % 3 + 3.0 + (50 if k == 29 else 0)) for k in range(30)]
    names = "g int, item int, x_a double, y_a double, z_a double, x_b double, y_b double, z_b double"
    flagged = similarity.consensus_fit(spark.createDataFrame(wild + good, names), ["g"], "item", 1e-6)
    report = {r.g: r for r in similarity.consensus_report(flagged, ["g"], 1e-6).collect()}
    assert (report[2].control_points, report[2].inliers, report[2].outliers, report[2].passes_fit_gate) == (30, 29, 1, True)
    assert report[2].fit_rmse_m < 1e-8 and abs(report[2].scale_change_percent) < 1e-6
    assert report[1].control_points == 6 and (report[1].inliers == 3 or not report[1].passes_fit_gate)


def test_known_points_on_the_globe(spark):
    rows = [(0.0, 0.0, 0.0, None, None, None), (None, 1.0, 2.0, 12.0, 77.0, 100.0), (None, None, None, 12.001, 77.0, 110.0), (None,) * 6]
    df = spark.createDataFrame(rows, "known_x_m double, known_y_m double, known_z_m double, known_latitude double, known_longitude double, known_altitude_m double")
    got = [tuple(r)[:3] for r in validation.geodetic_known(df, (12.0, 77.0, 100.0)).collect()]
    assert got[0] == (0.0, 0.0, 0.0) and got[1] == pytest.approx((0.0, 0.0, 0.0), abs=1e-6)
    assert got[2] == pytest.approx((0.0, 110.6, 10.0), abs=0.1) and got[3] == (None, None, None)


def test_anchor_filling_takes_the_farthest_frames(spark):
    clips = spark.createDataFrame([(1, 101), (2, 3), (3, 41)], "k int, total bigint")
    seeds = spark.createDataFrame([(1, 0), (1, 100), (1, 10), (2, 0), (2, 2), (3, 0), (3, 40)], "k int, anchor bigint")
    got = {}
    for r in windows.fill_anchors(seeds, clips, "k", 5).collect():
        got.setdefault(r.k, []).append(r.anchor)
    assert sorted(got[2]) == [0, 1, 2]
    for k, total, chosen in ((1, 101, [0, 10, 100]), (3, 41, [0, 40])):
        pool = {int(round(i * (total - 1) / 39)) for i in range(40)}
        while len(chosen) < 5:
            chosen.append(max(pool - set(chosen), key=lambda f: (min(abs(f - c) for c in chosen), -f)))
        assert sorted(got[k]) == sorted(chosen)


def test_bridge_without_any_link_keeps_every_frame(spark):
    frames = spark.createDataFrame([(1, i, float(i), 0.0, 1.0) for i in range(5)], "v int, idx bigint, time_s double, path_m double, sharpness double")
    none = spark.createDataFrame([], "v int, a bigint, b bigint, verified boolean, motion double")
    got = {r.idx: r.reason for r in coverage.bridge_selection(frames, none, "v").collect()}
    assert got == {0: "start", **{i: "unresolved_visual_break" for i in range(1, 5)}}


def test_scratch_is_refused_off_this_machine(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    assert session.steps_folder(spark).endswith(spark.sparkContext.applicationId)
