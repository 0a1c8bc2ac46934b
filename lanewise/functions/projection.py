"""Longitude/latitude to UTM and back, and areas on the globe, as Column expressions.

The projection is the Krueger series of third order on the WGS84 ellipsoid (errors below
a millimetre inside a zone). All zones use the northern codes ``32600 + zone``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import _rotated, point

# --- fixed values: WGS84 and UTM ---------------------------------------------------
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
# ----------------------------------------------------------------------------------

_n = FLATTENING / (2 - FLATTENING)
_e2 = FLATTENING * (2 - FLATTENING)
_e = math.sqrt(_e2)
MERIDIAN_RADIUS = SEMI_MAJOR / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ALPHA = [
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16,
    13 * _n**2 / 48 - 3 * _n**3 / 5,
    61 * _n**3 / 240,
]
BETA = [
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96,
    _n**2 / 48 + _n**3 / 15,
    17 * _n**3 / 480,
]
DELTA = [
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3,
    7 * _n**2 / 3 - 8 * _n**3 / 5,
    56 * _n**3 / 15,
]


def utm_zone(lon, lat=None) -> Column:
    """Zone number; with a latitude, the wider zones around Norway and Svalbard apply."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    zone = (F.floor((lon + 180.0) / 6.0).cast("int") % 60) + 1
    if lat is None:
        return zone
    lat = F.col(lat) if isinstance(lat, str) else lat
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = (lat >= 72) & (lat <= 84)
    return (
        F.when(norway, F.lit(32))
        .when(svalbard & (lon >= 0) & (lon < 9), F.lit(31))
        .when(svalbard & (lon >= 9) & (lon < 21), F.lit(33))
        .when(svalbard & (lon >= 21) & (lon < 33), F.lit(35))
        .when(svalbard & (lon >= 33) & (lon < 42), F.lit(37))
        .otherwise(zone)
    )


def utm_epsg(lon, lat=None) -> Column:
    return (F.lit(32600) + utm_zone(lon, lat)).cast("int")


def _central_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def to_utm(lon: Column, lat: Column, zone: Column) -> Column:
    """Point ``struct(x, y)`` in metres."""
    phi = F.radians(lat)
    lam = F.radians(lon - _central_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _e * F.atanh(_e * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        x = x + a * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        y = y + a * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    k = SCALE * MERIDIAN_RADIUS
    return point(x * k + FALSE_EASTING, y * k)


def from_utm(x: Column, y: Column, zone: Column) -> Column:
    """Point ``struct(x = longitude, y = latitude)`` in degrees."""
    k = SCALE * MERIDIAN_RADIUS
    xi, eta = y / k, (x - FALSE_EASTING) / k
    xi2, eta2 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi2 = xi2 - b * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
        eta2 = eta2 - b * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + d * F.sin(chi * (2.0 * j))
    lam = F.atan2(F.sinh(eta2), F.cos(xi2))
    return point(F.degrees(lam) + _central_meridian(zone), F.degrees(phi))


def line_to_utm(line: Column, zone: Column) -> Column:
    return F.transform(line, lambda p: to_utm(p["x"], p["y"], zone))


def line_from_utm(line: Column, zone: Column) -> Column:
    return F.transform(line, lambda p: from_utm(p["x"], p["y"], zone))


def polygon_to_utm(rings: Column, zone: Column) -> Column:
    return F.transform(rings, lambda r: line_to_utm(r, zone))


# Equal-area ("authalic") sphere of the ellipsoid: q is twice the normalised zone area.
_Q_POLE = 1 + (1 - _e2) / (2 * _e) * math.log((1 + _e) / (1 - _e))
AUTHALIC_RADIUS_2 = SEMI_MAJOR**2 * _Q_POLE / 2


def _authalic_sine(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    es = s * _e
    q = (1 - _e2) * (s / (1.0 - es * es) + F.atanh(es) / _e)
    return q / _Q_POLE


def geodesic_area(rings: Column) -> Column:
    """Square metres of a longitude/latitude polygon, holes taken off.

    Uses the equal-area sphere of the ellipsoid with edges straight in (longitude,
    authalic sine); for edges of a few kilometres the result agrees with a geodesic
    polygon to about one part in a million.
    """

    def of_ring(ring):
        terms = F.zip_with(
            ring,
            _rotated(ring),
            lambda p, q: F.radians(q["x"] - p["x"]) * (_authalic_sine(p["y"]) + _authalic_sine(q["y"])),
        )
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)) / 2.0 * AUTHALIC_RADIUS_2

    return F.aggregate(
        F.transform(rings, lambda r, i: of_ring(r) * F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
