from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from skyledger.session import build_session

    return build_session()


@pytest.fixture(scope="session")
def duckdb_tables():
    from tests.oracle import duck

    return duck("/root/testdata/sf0.001")
