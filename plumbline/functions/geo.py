"""Geodesy: spherical closed forms as columns, and WGS84 geodesics by Vincenty's series over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean earth radius; WGS84 semi-major axis and flattening; metres of a degree of latitude.
RADIUS_M = 6_371_008.8
A, FLAT = 6_378_137.0, 1 / 298.257223563
DEGREE_M = 111_320.0


def metres_to_degrees(lat: Column, north: Column, east: Column) -> tuple[Column, Column]:
    """(degrees of latitude, of longitude); the latter null within a millionth of a metre per degree at the poles."""
    per = DEGREE_M * F.cos(F.radians(lat))
    return north / DEGREE_M, F.when(F.abs(per) >= 1e-9, east / per)


def _within_one(x: Column) -> Column:
    """x, or the nearer of -1 and 1 where rounding went beyond. Null stays null, which least() and greatest() would not keep."""
    return F.when(x > 1, 1.0).when(x < -1, -1.0).otherwise(x)


def sphere_forward(lat: Column, lon: Column, bearing: Column, distance: Column) -> tuple[Column, Column]:
    """The point at a distance along a great circle."""
    p, b, d = F.radians(lat), F.radians(bearing), distance / RADIUS_M
    s = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    to = F.asin(_within_one(s))
    return F.degrees(to), lon + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * s))


def sphere_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """(distance by haversines, bearing at the start)."""
    p, q, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(dl / 2), 2)
    bearing = F.degrees(F.atan2(F.sin(dl) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(dl)))
    return 2 * RADIUS_M * F.asin(_within_one(F.sqrt(h))), F.pmod(bearing, F.lit(360.0))


def _series(u2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return a, b


def _correction(b, sin_s, cos_s, cos_2m):
    return b * sin_s * (cos_2m + b / 4 * (cos_s * (2 * cos_2m**2 - 1) - b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))


def wgs84_forward(lat, lon, bearing, distance):
    """Vincenty's direct solution on arrays: latitude and longitude of the end."""
    lat, lon, bearing, s = (np.asarray(x, float) for x in (lat, lon, bearing, distance))
    b_axis = A * (1 - FLAT)
    az = np.radians(bearing)
    tan_u = (1 - FLAT) * np.tan(np.radians(lat))
    cos_u = 1 / np.sqrt(1 + tan_u**2)
    sin_u = tan_u * cos_u
    s1 = np.arctan2(tan_u, np.cos(az))
    sin_a = cos_u * np.sin(az)
    cos2_a = 1 - sin_a**2
    a, b = _series(cos2_a * (A**2 - b_axis**2) / b_axis**2)
    sigma = first = s / (b_axis * a)
    for _ in range(30):
        cos_2m = np.cos(2 * s1 + sigma)
        sigma = first + _correction(b, np.sin(sigma), np.cos(sigma), cos_2m)
    cos_2m, sin_s, cos_s = np.cos(2 * s1 + sigma), np.sin(sigma), np.cos(sigma)
    x = sin_u * sin_s - cos_u * cos_s * np.cos(az)
    to = np.arctan2(sin_u * cos_s + cos_u * sin_s * np.cos(az), (1 - FLAT) * np.hypot(sin_a, x))
    lam = np.arctan2(sin_s * np.sin(az), cos_u * cos_s - sin_u * sin_s * np.cos(az))
    c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
    d = lam - (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
    return np.degrees(to), lon + np.degrees(d)


def wgs84_inverse(lat1, lon1, lat2, lon2):
    """Vincenty's inverse solution on arrays: distance and bearing at the start. Near antipodes, where the series does not settle, the sphere's."""
    lat1, lon1, lat2, lon2 = (np.asarray(x, float) for x in (lat1, lon1, lat2, lon2))
    b_axis = A * (1 - FLAT)
    big = np.radians(lon2 - lon1)
    tan1, tan2 = (1 - FLAT) * np.tan(np.radians(lat1)), (1 - FLAT) * np.tan(np.radians(lat2))
    cos1, cos2 = 1 / np.sqrt(1 + tan1**2), 1 / np.sqrt(1 + tan2**2)
    sin1, sin2 = tan1 * cos1, tan2 * cos2
    lam, moved = big, np.ones_like(big)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sin_l, cos_l = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(cos2 * sin_l, cos1 * sin2 - sin1 * cos2 * cos_l)
            cos_s = sin1 * sin2 + cos1 * cos2 * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, cos1 * cos2 * sin_l / np.where(sin_s > 0, sin_s, 1), 0.0)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a > 1e-15, cos_s - 2 * sin1 * sin2 / np.where(cos2_a > 1e-15, cos2_a, 1), 0.0)
            c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
            fresh = big + (1 - c) * FLAT * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
            moved, lam = np.abs(fresh - lam), fresh
            if not (moved > 1e-13).any():
                break
        a, b = _series(cos2_a * (A**2 - b_axis**2) / b_axis**2)
        distance = b_axis * a * (sigma - _correction(b, sin_s, cos_s, cos_2m))
        bearing = np.degrees(np.arctan2(cos2 * sin_l, cos1 * sin2 - sin1 * cos2 * cos_l)) % 360
    lost = ~(moved <= 1e-9) | ~np.isfinite(distance)
    p, q, dl = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(dl / 2) ** 2
    round_ = 2 * RADIUS_M * np.arcsin(np.minimum(np.sqrt(h), 1))
    return np.where(lost, round_, distance), np.where(lost, np.degrees(np.arctan2(np.sin(dl) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(dl))) % 360, bearing)


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def geodesic_forward(lat: pd.Series, lon: pd.Series, bearing: pd.Series, distance: pd.Series) -> pd.DataFrame:
    a, b = wgs84_forward(lat, lon, bearing, distance)
    return pd.DataFrame({"lat": a, "lon": b})


@F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("bearing", T.DoubleType())]))
def geodesic_inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    a, b = wgs84_inverse(lat1, lon1, lat2, lon2)
    return pd.DataFrame({"distance": a, "bearing": b})


def to_local(lat0: Column, lon0: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(east, north) metres by azimuthal-equidistant projection about an origin, on the sphere."""
    d, b = sphere_inverse(lat0, lon0, lat, lon)
    return d * F.sin(F.radians(b)), d * F.cos(F.radians(b))


def from_local(lat0: Column, lon0: Column, east: Column, north: Column) -> tuple[Column, Column]:
    return sphere_forward(lat0, lon0, F.degrees(F.atan2(east, north)), F.hypot(east, north))


@F.pandas_udf(T.StructType([T.StructField("east", T.DoubleType()), T.StructField("north", T.DoubleType())]))
def geodesic_to_local(lat0: pd.Series, lon0: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
    """(east, north) metres by azimuthal-equidistant projection about an origin, on the ellipsoid."""
    d, b = wgs84_inverse(lat0, lon0, lat, lon)
    return pd.DataFrame({"east": d * np.sin(np.radians(b)), "north": d * np.cos(np.radians(b))})


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def geodesic_from_local(lat0: pd.Series, lon0: pd.Series, east: pd.Series, north: pd.Series) -> pd.DataFrame:
    a, b = wgs84_forward(lat0, lon0, np.degrees(np.arctan2(east, north)), np.hypot(east, north))
    return pd.DataFrame({"lat": a, "lon": b})


#: The scale on a zone's middle meridian, and what is added to eastings, and to northings in the south.
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _mercator() -> tuple[float, float, list[float], list[float]]:
    """Third flattening, radius of the rectified meridian, and the series of the transverse Mercator projection and of its inverse, to the fourth order in the third flattening."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ahead = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return n, radius, ahead, back


def utm_forward(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) metres in a UTM zone on WGS84."""
    n, radius, ahead, _ = _mercator()
    k = 2 * np.sqrt(n) / (1 + n)
    dl, s = F.radians(lon - (6.0 * zone - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.atanh(s * k) * k)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))
    north, east = xi, eta
    for j, a in enumerate(ahead, 1):
        north, east = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a, east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
    return east * (UTM_SCALE * radius) + UTM_EAST, north * (UTM_SCALE * radius) + (UTM_SOUTH if south else 0.0)


def utm_inverse(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lat, lon) of a place in a UTM zone. The latitude comes from the conformal one by the steps of Newton's method."""
    n, radius, _, back = _mercator()
    e = 2 * np.sqrt(n) / (1 + n)
    xi0, eta0 = (northing - (UTM_SOUTH if south else 0.0)) / (UTM_SCALE * radius), (easting - UTM_EAST) / (UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(back, 1):
        xi, eta = xi - F.sin(xi0 * (2 * j)) * F.cosh(eta0 * (2 * j)) * b, eta - F.cos(xi0 * (2 * j)) * F.sinh(eta0 * (2 * j)) * b
    # tangents of the conformal latitude wanted, and of the latitude
    want = F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))

    def step(t: Column) -> Column:
        root = F.sqrt(t * t + 1)
        sigma = F.sinh(F.atanh(t / root * e) * e)
        got = t * F.sqrt(sigma * sigma + 1) - sigma * root
        slope = (F.sqrt(got * got + 1) * F.sqrt(t * t + 1)) * (1 - e * e) / (1 + (1 - e * e) * t * t)
        return t - (got - want) / slope

    tan = F.aggregate(F.sequence(F.lit(1), F.lit(4)), want, lambda t, _: step(t))
    return F.degrees(F.atan(tan)), F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6.0 * zone - 183)
