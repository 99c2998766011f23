"""Comparisons that fail closed, and three-valued ones that stay unknown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import finite

# Surface comparison tolerances.
ABSOLUTE_TOLERANCE_M = 0.02
RELATIVE_TOLERANCE = 0.05
F1_TOLERANCE = 0.02


def surely(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def at_least(v: Column, least) -> Column:
    return surely(finite(v) & (v >= least))


def at_most(v: Column, most) -> Column:
    return surely(finite(v) & (v <= most))


def not_materially_higher(before: Column, after: Column) -> Column:
    allowance = F.greatest(F.lit(ABSOLUTE_TOLERANCE_M), F.abs(before) * RELATIVE_TOLERANCE)
    return surely(finite(before) & finite(after) & (after <= before + allowance + 1e-12))


def within_delta(before: Column, after: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Null when a side is unmeasured."""
    delta = after - before
    ok = F.lit(True)
    if lower is not None:
        ok = ok & (delta >= lower)
    if upper is not None:
        ok = ok & (delta <= upper)
    return F.when(before.isNotNull() & after.isNotNull(), ok)


def retains_ratio(before: Column, after: Column, ratio: float) -> Column:
    return F.when(before.isNotNull() & after.isNotNull() & (before > 0), after >= ratio * before)


def same_duration(a: Column, b: Column) -> Column:
    near = F.abs(a - b) <= F.greatest(1e-4 * F.greatest(F.abs(a), F.abs(b)), F.lit(0.5))
    return surely(finite(a) & finite(b) & (a > 0) & (b > 0) & near)


def same_value(a: Column, b: Column) -> Column:
    """Equal and known."""
    return surely(a == b)


def failing(gates: dict[str, Column]) -> Column:
    """Sorted, comma-joined names of gates that do not hold."""
    names = F.array(*[F.when(~surely(c), F.lit(n)) for n, c in sorted(gates.items())])
    return F.array_join(F.array_compact(names), ",")


def reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(surely(c), F.lit(t)) for c, t in pairs])), ",")


def all_known_true(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & surely(c)
    return out
