"""Transverse Mercator and conformal conic projections as Columns.

A projection is a list of stages, each from two Columns to two Columns. Whoever
applies them keeps the values between stages, so no expression is repeated.
Longitudes are taken as they are (no wrap at 180 degrees), and ellipsoids of
WGS84 and NAD83 count as one datum.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from math import atan, atanh, cos, exp, log, radians, sin, sinh, sqrt
from typing import NamedTuple

from pyspark.sql import Column, functions as F

Stage = Callable[[Column, Column], tuple[Column, Column]]

#: Fixed-point steps from isometric latitude; each leaves a hundredth of the error or less.
LATITUDE_STEPS = 7


class Ellipsoid(NamedTuple):
    a: float
    inverse_flattening: float

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return sqrt(f * (2 - f))

    @property
    def n(self) -> float:
        return 1 / (2 * self.inverse_flattening - 1)

    def isometric(self, lat: float) -> float:
        s = sin(radians(lat))
        return atanh(s) - self.e * atanh(self.e * s)

    def to_isometric(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        s = F.sin(F.radians(lat))
        return F.radians(lon), F.atanh(s) - F.atanh(s * self.e) * self.e

    def from_isometric(self, lam: Column, psi: Column) -> tuple[Column, Column]:
        s = F.tanh(psi)
        for _ in range(LATITUDE_STEPS):
            s = F.tanh(psi + F.atanh(s * self.e) * self.e)
        return F.degrees(lam), F.degrees(F.asin(s))


class TransverseMercator(NamedTuple):
    """Series in the third flattening to its fourth power; ``unit`` is the metres of a unit."""

    lon0: float
    lat0: float
    scale: float
    east: float
    north: float
    ellipsoid: Ellipsoid
    unit: float = 1.0

    def _series(self) -> tuple[float, list[float], list[float]]:
        n = self.ellipsoid.n
        radius = self.scale * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        # Published coefficients of the series and of its inverse.
        forward = [
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4,
            49561 / 161280 * n**4,
        ]
        inverse = [
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4,
            1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        ]
        return radius, forward, inverse

    def _origin(self) -> float:
        chi = atan(sinh(self.ellipsoid.isometric(self.lat0)))
        return chi + sum(a * sin(2 * j * chi) for j, a in enumerate(self._series()[1], 1))

    @staticmethod
    def _add(xi: Column, eta: Column, terms: list[float]) -> tuple[Column, Column]:
        north, east = xi, eta
        for j, a in enumerate(terms, 1):
            north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
            east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        return north, east

    def forward(self) -> list[Stage]:
        radius, terms, _ = self._series()

        def on_sphere(lam, psi):
            d = lam - radians(self.lon0)
            return F.atan2(F.sinh(psi), F.cos(d)), F.atanh(F.sin(d) / F.cosh(psi))

        def to_plane(xi, eta):
            north, east = self._add(xi, eta, terms)
            return (
                (east * radius + self.east) / self.unit,
                ((north - self._origin()) * radius + self.north) / self.unit,
            )

        return [self.ellipsoid.to_isometric, on_sphere, to_plane]

    def inverse(self) -> list[Stage]:
        radius, _, terms = self._series()

        def from_plane(x, y):
            return (y * self.unit - self.north) / radius + self._origin(), (x * self.unit - self.east) / radius

        def to_sphere(xi, eta):
            return self._add(xi, eta, [-b for b in terms])

        def to_isometric(xi, eta):
            return F.atan2(F.sinh(eta), F.cos(xi)) + radians(self.lon0), F.atanh(F.sin(xi) / F.cosh(eta))

        return [from_plane, to_sphere, to_isometric, self.ellipsoid.from_isometric]


class ConformalConic(NamedTuple):
    """Two standard parallels ``lat1`` and ``lat2`` (equal ones for a single parallel)."""

    lon0: float
    lat0: float
    lat1: float
    lat2: float
    east: float
    north: float
    ellipsoid: Ellipsoid
    unit: float = 1.0

    def cone(self) -> tuple[float, float, float]:
        """Constant of the cone, radius at the equator, radius at the origin."""
        ell = self.ellipsoid

        def parallel(lat):
            return cos(radians(lat)) / sqrt(1 - (ell.e * sin(radians(lat))) ** 2)

        n = sin(radians(self.lat1))
        if self.lat1 != self.lat2:
            n = log(parallel(self.lat1) / parallel(self.lat2)) / (ell.isometric(self.lat2) - ell.isometric(self.lat1))
        equator = ell.a * parallel(self.lat1) * exp(n * ell.isometric(self.lat1)) / n
        return n, equator, equator * exp(-n * ell.isometric(self.lat0))

    def forward(self) -> list[Stage]:
        n, equator, origin = self.cone()

        def polar(lam, psi):
            return (lam - radians(self.lon0)) * n, F.exp(psi * -n) * equator

        def to_plane(angle, r):
            return (
                (r * F.sin(angle) + self.east) / self.unit,
                (F.lit(origin + self.north) - r * F.cos(angle)) / self.unit,
            )

        return [self.ellipsoid.to_isometric, polar, to_plane]

    def inverse(self) -> list[Stage]:
        n, equator, origin = self.cone()
        sign = 1.0 if n > 0 else -1.0

        def from_plane(x, y):
            return (x * self.unit - self.east) * sign, (F.lit(origin + self.north) - y * self.unit) * sign

        def to_isometric(dx, dy):
            return (
                F.atan2(dx, dy) / n + radians(self.lon0),
                (F.lit(log(abs(equator))) - F.log(F.hypot(dx, dy))) / n,
            )

        return [from_plane, to_isometric, self.ellipsoid.from_isometric]


# Parameters of public coordinate systems.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
SURVEY_FOOT = 1200 / 3937
CONICS = {
    "EPSG:3034": ConformalConic(10.0, 52.0, 35.0, 65.0, 4_000_000.0, 2_800_000.0, GRS80),
    "EPSG:3089": ConformalConic(
        -85.75, 36 + 1 / 3, 37 + 1 / 12, 38 + 2 / 3, 1_500_000.0, 3_280_833.333 * SURVEY_FOOT, GRS80, SURVEY_FOOT
    ),
}


def projection(crs: str) -> TransverseMercator | ConformalConic | None:
    """The projection of a code: conics above, and UTM zones of WGS84 and NAD83 by their numbers."""
    if crs in CONICS:
        return CONICS[crs]
    zone = re.fullmatch(r"EPSG:(326|327|269)(\d\d)", crs)
    if not zone or not 1 <= int(zone[2]) <= (23 if zone[1] == "269" else 60):
        return None
    north = 10_000_000.0 if zone[1] == "327" else 0.0
    ellipsoid = GRS80 if zone[1] == "269" else WGS84
    return TransverseMercator(6.0 * int(zone[2]) - 183, 0.0, 0.9996, 500_000.0, north, ellipsoid)
