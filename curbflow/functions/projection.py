"""Inverse Lambert conformal conic projection as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS 1980 ellipsoid and the New York Long Island state plane (EPSG:2263).
SEMI_MAJOR_M = 6378137.0
INVERSE_FLATTENING = 298.257222101
FALSE_EASTING_FT = 984250.0
FALSE_NORTHING_FT = 0.0
CENTRAL_MERIDIAN = -74.0
STANDARD_PARALLELS = (40.66666666666666, 41.03333333333333)
ORIGIN_LATITUDE = 40.16666666666666
FOOT_M = 0.3048006096012192

LATITUDE_STEPS = 5  # the last step is below 1e-12 rad for this region


def _constants() -> tuple[float, float, float, float]:
    """Eccentricity, cone constant, scale F times radius, and rho at the origin."""
    flattening = 1 / INVERSE_FLATTENING
    ecc = math.sqrt(flattening * (2 - flattening))

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (ecc * math.sin(phi)) ** 2)

    def t(phi):
        s = ecc * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (ecc / 2)

    p1, p2 = (math.radians(p) for p in STANDARD_PARALLELS)
    cone = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    radius = SEMI_MAJOR_M * m(p1) / (cone * t(p1) ** cone)
    return ecc, cone, radius, radius * t(math.radians(ORIGIN_LATITUDE)) ** cone


def plane_to_lonlat(x_ft: Column, y_ft: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of plane feet."""
    ecc, cone, radius, rho0 = _constants()
    x = (x_ft - FALSE_EASTING_FT) * FOOT_M
    y = F.lit(rho0) - (y_ft - FALSE_NORTHING_FT) * FOOT_M
    t = F.pow(F.sqrt(x * x + y * y) / radius, F.lit(1 / cone))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(LATITUDE_STEPS):
        s = F.sin(phi) * ecc
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(ecc / 2)))
    return F.degrees(F.atan2(x, y)) / cone + CENTRAL_MERIDIAN, F.degrees(phi)
