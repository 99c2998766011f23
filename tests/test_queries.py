"""Every query beside its SQL on the smallest tables, plain and with every group treated as huge."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from skyledger import scale
from skyledger.plans import catalog
from tests.oracle import compare

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES

# Queries whose operators switch to the split path for a group beyond the bound.
SPLIT = [
    "telemetry_quality", "telemetry_preflight", "flight_classifier", "frame_position_interpolation", "flown_path",
    "selected_frame_gaps", "flight_record_clip_match", "longest_recording", "image_gps_assembly", "pose_clock",
    "checkpoint_error_statistics", "even_frame_picks", "loop_window_lookup", "depth_alignment_mask", "point_budget",
    "scale_ratios", "manifest_fingerprints", "telemetry_fingerprints", "scene_scale", "height_colour_range", "visual_support", "vibration_alarms", "accumulated_transforms",
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duckdb_tables, name):
    assert compare(QUERIES[name](spark, SF_DIR), ORACLES[name], duckdb_tables) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


@pytest.mark.parametrize("name", SPLIT)
def test_split_path_agrees_with_sql(spark, duckdb_tables, monkeypatch, name):
    monkeypatch.setattr(scale, "MAX_GROUP_ROWS", 3)
    monkeypatch.setattr(scale, "PART_ROWS", 150)
    assert compare(QUERIES[name](spark, SF_DIR), ORACLES[name], duckdb_tables) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
