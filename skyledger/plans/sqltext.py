"""Small text builders for the checking SQL."""

from __future__ import annotations


def local_distance(lat1, lon1, alt1, lat2, lon2, alt2) -> str:
    east = f"(radians({lon2} - {lon1}) * 6378137.0e0 * cos(radians(({lat1} + {lat2}) / 2.0e0)))"
    north = f"(radians({lat2} - {lat1}) * 6378137.0e0)"
    return f"sqrt({east} * {east} + {north} * {north} + ({alt2} - {alt1}) * ({alt2} - {alt1}))"


def haversine(lat1, lon1, lat2, lon2) -> str:
    a = f"sin((radians({lat2}) - radians({lat1})) / 2.0e0)"
    b = f"sin(radians({lon2} - {lon1}) / 2.0e0)"
    chord = f"({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b})"
    return f"(2.0e0 * 6371008.8e0 * asin(least(1.0e0, sqrt({chord}))))"


def ecef(lat, lon, h) -> tuple[str, str, str]:
    e2 = repr((1 / 298.257223563) * (2 - 1 / 298.257223563))
    n = f"(6378137.0e0 / sqrt(1.0e0 - {e2} * sin(radians({lat})) * sin(radians({lat}))))"
    return (
        f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1.0e0 - {e2}) + {h}) * sin(radians({lat})))",
    )


def enu_from_ecef(dx, dy, dz, lat0, lon0) -> tuple[str, str, str]:
    sp, cp = f"sin(radians({lat0}))", f"cos(radians({lat0}))"
    sl, cl = f"sin(radians({lon0}))", f"cos(radians({lon0}))"
    return (
        f"(-{sl} * {dx} + {cl} * {dy})",
        f"(-{sp} * {cl} * {dx} - {sp} * {sl} * {dy} + {cp} * {dz})",
        f"({cp} * {cl} * {dx} + {cp} * {sl} * {dy} + {sp} * {dz})",
    )


def rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names.split())


RESAMPLED = """
    ordered_t AS (SELECT flight_id, sample_id, time_s, latitude, longitude, altitude_m,
                  row_number() OVER (PARTITION BY flight_id ORDER BY time_s, sample_id) AS rn FROM telemetry),
    kept AS (
        SELECT flight_id, rn, time_s FROM ordered_t WHERE rn = 1
        UNION ALL
        SELECT n.flight_id, n.rn, n.time_s FROM kept k, LATERAL (
            SELECT o.flight_id, o.rn, o.time_s FROM ordered_t o
            WHERE o.flight_id = k.flight_id AND o.rn > k.rn AND o.time_s - k.time_s >= {gap}
            ORDER BY o.rn LIMIT 1) n)
"""
