"""Imports every plan module so that all queries are registered."""

from . import alignment, camera, clouds, documents, matching, reports, scalars, selection, sources, streams, telemetry, terrain, validation  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES  # noqa: F401
