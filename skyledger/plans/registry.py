"""Named queries, each with its Spark plan and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def fixed_digits(value: Column, digits: int = 6) -> Column:
    """Round half up by plain arithmetic, which both engines do bit for bit alike."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def _fixed_text(sql: str) -> str:
    """Write each ``round(x, n)`` of the checking SQL as the same arithmetic."""
    out, at = [], 0
    while (found := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, found + len("round("), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 1 and sql[end] == ",":
                comma = end
            end += 1
        inner, digits = _fixed_text(sql[found + len("round(") : comma]), int(sql[comma + 1 : end - 1])
        out += [sql[at:found], f"(floor(({inner}) * 1e{digits} + 0.5e0) / 1e{digits})"]
        at = end
    return "".join(out) + sql[at:]


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``covers`` lists survey operator ids."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if oracle is not None:
            ORACLES[name] = _fixed_text(oracle)
        return fn

    return keep
