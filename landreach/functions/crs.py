"""Transverse Mercator (zone 36 south) as column expressions, by the published Krüger n-series."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: WGS84 and zone 36 south (EPSG:32736).
A_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
K0, LON0, FALSE_EAST, FALSE_NORTH = 0.9996, 33.0, 500_000.0, 10_000_000.0

N = FLATTENING / (2 - FLATTENING)
RADIUS = A_AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
C = 2 * math.sqrt(N) / (1 + N)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


def _series(coefficients: tuple[float, ...], one, other, u: Column, v: Column) -> Column:
    terms = [F.lit(c) * one(F.lit(2.0 * j) * u) * other(F.lit(2.0 * j) * v) for j, c in enumerate(coefficients, 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def utm_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres from degrees; null for a null coordinate."""
    phi, dlam = F.radians(lat), F.radians(lon - F.lit(LON0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(C) * F.atanh(F.lit(C) * s))
    xi, eta = F.atan2(t, F.cos(dlam)), F.atanh(F.sin(dlam) / F.sqrt(F.lit(1.0) + t * t))
    east = F.lit(FALSE_EAST) + F.lit(K0 * RADIUS) * (eta + _series(ALPHA, F.cos, F.sinh, xi, eta))
    north = F.lit(FALSE_NORTH) + F.lit(K0 * RADIUS) * (xi + _series(ALPHA, F.sin, F.cosh, xi, eta))
    return east, north


def utm_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees from metres; null for a null coordinate."""
    xi, eta = (y - F.lit(FALSE_NORTH)) / F.lit(K0 * RADIUS), (x - F.lit(FALSE_EAST)) / F.lit(K0 * RADIUS)
    xi1 = xi - _series(BETA, F.sin, F.cosh, xi, eta)
    eta1 = eta - _series(BETA, F.cos, F.sinh, xi, eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.lit(LON0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)
