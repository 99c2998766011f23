"""Geodesy as column expressions (WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# WGS84 ellipsoid and the two mean radii used by the distance rules.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
EQUATORIAL_RADIUS_M = 6378137.0
MEAN_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111320.0
METRES_PER_DEGREE_LAT = 110540.0
UTM_SCALE = 0.9996


def local_distance(lat1, lon1, alt1, lat2, lon2, alt2) -> Column:
    """3-D distance with an equirectangular ground plane at the mid latitude."""
    mid = F.radians((lat1 + lat2) / 2.0)
    north = F.radians(lat2 - lat1) * EQUATORIAL_RADIUS_M
    east = F.radians(lon2 - lon1) * EQUATORIAL_RADIUS_M * F.cos(mid)
    up = alt2 - alt1
    return F.sqrt(east * east + north * north + up * up)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = F.sin((p2 - p1) / 2.0)
    across = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half * half + F.cos(p1) * F.cos(p2) * across * across
    return 2.0 * MEAN_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def planar(lat, lon, lat0, lon0, lat_metres: float = METRES_PER_DEGREE) -> tuple[Column, Column]:
    """East and north metres from an origin on a local plane."""
    east = (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0))
    return east, (lat - lat0) * lat_metres


def ecef(lat, lon, height) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)
    s, c = F.sin(p), F.cos(p)
    n = F.lit(WGS84_A) / F.sqrt(1.0 - WGS84_E2 * s * s)
    return (n + height) * c * F.cos(l), (n + height) * c * F.sin(l), (n * (1.0 - WGS84_E2) + height) * s


def enu(lat, lon, height, lat0, lon0, height0) -> tuple[Column, Column, Column]:
    """Geodetic point to east, north, up metres at an origin, through ECEF."""
    x, y, z = ecef(lat, lon, height)
    x0, y0, z0 = ecef(lat0, lon0, height0)
    dx, dy, dz = x - x0, y - y0, z - z0
    p, l = F.radians(lat0), F.radians(lon0)
    sp, cp, sl, cl = F.sin(p), F.cos(p), F.sin(l), F.cos(l)
    east = -sl * dx + cl * dy
    north = -sp * cl * dx - sp * sl * dy + cp * dz
    up = cp * cl * dx + cp * sl * dy + sp * dz
    return east, north, up


def enu_to_ecef(e, n, u, lat0, lon0, height0) -> tuple[Column, Column, Column]:
    x0, y0, z0 = ecef(lat0, lon0, height0)
    p, l = F.radians(lat0), F.radians(lon0)
    sp, cp, sl, cl = F.sin(p), F.cos(p), F.sin(l), F.cos(l)
    return (
        x0 - sl * e - sp * cl * n + cp * cl * u,
        y0 + cl * e - sp * sl * n + cp * sl * u,
        z0 + cp * n + sp * u,
    )


def with_geodetic(df, x: Column, y: Column, z: Column, prefix: str = ""):
    """Add ``lat``, ``lon``, ``height`` from ECEF by six fixed latitude refinements.

    Each round is its own projection step so the expression tree stays small.
    """
    lat, h, p = f"{prefix}_lat_r", f"{prefix}_h", f"{prefix}_p"
    out = df.withColumn(p, F.sqrt(x * x + y * y)).withColumn(f"{prefix}_z", z)
    out = out.withColumn(f"{prefix}_lon_r", F.atan2(y, x))
    out = out.withColumn(lat, F.atan2(F.col(f"{prefix}_z"), F.col(p) * (1.0 - WGS84_E2)))
    for _ in range(6):
        s = F.sin(F.col(lat))
        n = F.lit(WGS84_A) / F.sqrt(1.0 - WGS84_E2 * s * s)
        out = out.withColumn(f"{prefix}_n", n)
        out = out.withColumn(h, F.col(p) / F.cos(F.col(lat)) - F.col(f"{prefix}_n"))
        out = out.withColumn(
            lat,
            F.atan2(
                F.col(f"{prefix}_z"),
                F.col(p) * (1.0 - WGS84_E2 * F.col(f"{prefix}_n") / (F.col(f"{prefix}_n") + F.col(h))),
            ),
        )
    # math constants keep the division the same in both engines
    out = out.withColumn(f"{prefix}lat", F.col(lat) * F.lit(180.0 / math.pi))
    out = out.withColumn(f"{prefix}lon", F.col(f"{prefix}_lon_r") * F.lit(180.0 / math.pi))
    out = out.withColumn(f"{prefix}height", F.col(h))
    return out.drop(p, f"{prefix}_z", f"{prefix}_lon_r", lat, h, f"{prefix}_n")


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 6.0) + 1


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def _krueger() -> tuple[float, list[float]]:
    """Rectifying radius and forward series terms in the third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Published transverse Mercator series coefficients, order six.
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    return radius, alpha


KRUEGER_RADIUS, KRUEGER_ALPHA = _krueger()


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in the point's own zone (Krueger series, order six)."""
    e = math.sqrt(WGS84_E2)
    p = F.radians(lat)
    central = F.radians(utm_zone(lon) * 6 - 183)
    dl = F.radians(lon) - central
    t = F.tan(p)
    sigma = F.sinh(e * F.atanh(e * t / F.sqrt(1.0 + t * t)))
    tau = t * F.sqrt(1.0 + sigma * sigma) - sigma * F.sqrt(1.0 + t * t)
    xi0 = F.atan2(tau, F.cos(dl))
    eta0 = F.asinh(F.sin(dl) / F.sqrt(tau * tau + F.cos(dl) * F.cos(dl)))
    xi, eta = xi0, eta0
    for j, a in enumerate(KRUEGER_ALPHA, start=1):
        xi = xi + a * F.sin(2.0 * j * xi0) * F.cosh(2.0 * j * eta0)
        eta = eta + a * F.cos(2.0 * j * xi0) * F.sinh(2.0 * j * eta0)
    east = 500000.0 + UTM_SCALE * KRUEGER_RADIUS * eta
    north = UTM_SCALE * KRUEGER_RADIUS * xi + F.when(lat < 0, F.lit(10000000.0)).otherwise(F.lit(0.0))
    return east, north


# Grid reference letters.
MGRS_BANDS = "CDEFGHJKLMNPQRSTUVWXX"
MGRS_COLUMN_SETS = ("STUVWXYZ", "ABCDEFGH", "JKLMNPQR")
MGRS_ROW_LETTERS = "ABCDEFGHJKLMNPQRSTUV"


def mgrs(lat: Column, lon: Column, easting: Column, northing: Column) -> Column:
    """Grid reference with one metre digits, spaced as zone-band, square, east, north."""
    zone = utm_zone(lon).cast("int")
    band = F.substring(F.lit(MGRS_BANDS), (F.floor((lat + 80.0) / 8.0) + 1).cast("int"), F.lit(1))
    hundred_e = F.floor(easting / 100000.0).cast("int")
    column = F.lit(None).cast("string")
    for i, letters in enumerate(MGRS_COLUMN_SETS):
        column = F.when(zone % 3 == i, F.substring(F.lit(letters), hundred_e, F.lit(1))).otherwise(column)
    shift = F.when(zone % 2 == 0, F.lit(5)).otherwise(F.lit(0))
    row_index = F.pmod(F.floor(northing / 100000.0).cast("int") + shift, F.lit(20)) + 1
    row = F.substring(F.lit(MGRS_ROW_LETTERS), row_index.cast("int"), F.lit(1))
    east_digits = F.lpad(F.pmod(F.floor(easting), F.lit(100000)).cast("string"), 5, "0")
    north_digits = F.lpad(F.pmod(F.floor(northing), F.lit(100000)).cast("string"), 5, "0")
    return F.concat(zone.cast("string"), band, F.lit(" "), column, row, F.lit(" "), east_digits, F.lit(" "), north_digits)


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    value = deg + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)


def decimal_to_dms(value: Column) -> tuple[Column, Column, Column]:
    """Whole degrees, whole minutes and millionths of a second, half-even rounded."""
    a = F.abs(value)
    deg = F.floor(a)
    rest = (a - deg) * 60.0
    minutes = F.floor(rest)
    return deg, minutes, F.rint((rest - minutes) * 60.0 * 1000000.0).cast("bigint")
