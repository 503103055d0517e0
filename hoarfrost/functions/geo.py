"""Map coordinates and grid positions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid; UTM scale and false easting.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm(lat: Column, lon: Column, zone: int = 17) -> tuple[Column, Column]:
    """(easting, northing) in metres of northern latitudes by Krueger's series; millimetres within the zone."""
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e2 = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e2 * F.atanh(e2 * s))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * _RADIUS * x, SCALE * _RADIUS * y


def wgs84(east: Column, north: Column, zone: int = 17) -> tuple[Column, Column]:
    """(lat, lon) in degrees of UTM metres on the northern half."""
    xi, eta = north / (SCALE * _RADIUS), (east - EASTING) / (SCALE * _RADIUS)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(x), F.cos(y)))


def pixel(x: Column, y: Column, west: float, north: float, cell: float = 100.0) -> tuple[Column, Column]:
    """(row, col) of the pixel whose centre is nearest, halves to even."""
    return F.rint((north - y) / cell - 0.5).cast("int"), F.rint((x - west) / cell - 0.5).cast("int")


def centre(row: Column, col: Column, west: float, north: float, cell: float = 100.0) -> tuple[Column, Column]:
    """(x, y) of a pixel's centre."""
    return west + (col + 0.5) * cell, north - (row + 0.5) * cell


def point(text: Column) -> Column:
    """'lat,lon' as (lat, lon) in degrees; null unless it is two numbers in range."""
    parts = F.split(text, ",")
    lat, lon = (F.trim(F.get(parts, F.lit(k))).try_cast("double") for k in (0, 1))
    return F.when((F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def degrees_per_metre(lat: Column) -> tuple[Column, Column]:
    """Degrees of latitude and of longitude that a metre is at a latitude, on a sphere of the ellipsoid's axis."""
    north = 180 / (math.pi * AXIS)
    return F.lit(north), north / F.cos(F.radians(lat))
