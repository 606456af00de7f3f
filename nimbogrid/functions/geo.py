"""Distances, map projections and vector geometry as column expressions; angles in degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Haversine distance."""
    half = lambda v: F.sin(F.radians(v) / 2) ** 2
    h = half(lat1 - lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1 - lon2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def destination(lon: Column, lat: Column, azimuth: Column, distance: Column, radius: float = EARTH_RADIUS) -> tuple[Column, Column]:
    """(lon, lat) of the point at a distance in a direction."""
    d, a, p = distance / radius, F.radians(azimuth), F.radians(lat)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a))
    return lon + F.degrees(F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))), F.degrees(lat2)


@dataclass(frozen=True)
class Projection:
    """NONE, LC (Lambert conformal), PS (polar stereographic), MER (Mercator) or EC (equidistant cylindrical).

    (lon0, lat0) is put at (x0, y0). lat1 (and lat2 for LC) are true to scale.
    """

    kind: str
    lon0: float
    lat0: float
    lat1: float = 30.0
    lat2: float = 60.0
    x0: float = 0.0
    y0: float = 0.0
    radius: float = EARTH_RADIUS

    def _cone(self) -> tuple[float, float]:
        """Cone constant and scale of the conic ones."""
        a, b = math.radians(self.lat1), math.radians(self.lat2)
        half = lambda p: math.tan(math.pi / 4 - p / 2)
        if self.kind == "PS":
            return 1.0, 1 + math.sin(a)
        n = math.sin(a) if abs(a - b) < 1e-12 else math.log(math.cos(a) / math.cos(b)) / math.log(half(a) / half(b))
        return n, math.cos(a) / (n * half(a) ** n)

    def _origin(self) -> float:
        p = math.radians(self.lat0)
        if self.kind in ("LC", "PS"):
            n, f = self._cone()
            return self.radius * f * math.tan(math.pi / 4 - p / 2) ** n
        k = math.cos(math.radians(self.lat1))
        return self.radius * k * math.log(math.tan(math.pi / 4 + p / 2)) if self.kind == "MER" else self.radius * p

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        p, dl = F.radians(lat), F.radians(lon - self.lon0)
        if self.kind == "NONE":
            return self.x0 + self.radius * dl, self.y0 + self.radius * F.radians(lat - self.lat0)
        if self.kind in ("LC", "PS"):
            n, f = self._cone()
            rho = self.radius * f * F.pow(F.tan(math.pi / 4 - p / 2), F.lit(n))
            return self.x0 + rho * F.sin(n * dl), self.y0 + self._origin() - rho * F.cos(n * dl)
        k = math.cos(math.radians(self.lat1))
        y = self.radius * k * F.ln(F.tan(math.pi / 4 + p / 2)) if self.kind == "MER" else self.radius * p
        return self.x0 + self.radius * k * dl, self.y0 + y - self._origin()

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = x - self.x0, y - self.y0
        if self.kind == "NONE":
            return self.lon0 + F.degrees(u / self.radius), self.lat0 + F.degrees(v / self.radius)
        if self.kind in ("LC", "PS"):
            n, f = self._cone()
            w = self._origin() - v
            rho = F.sqrt(u * u + w * w)
            lat = F.degrees(math.pi / 2 - 2 * F.atan(F.pow(rho / (self.radius * f), F.lit(1 / n))))
            return self.lon0 + F.degrees(F.atan2(u, w) / n), lat
        k = math.cos(math.radians(self.lat1))
        w = v + self._origin()
        lat = F.degrees(2 * F.atan(F.exp(w / (self.radius * k))) - math.pi / 2) if self.kind == "MER" else F.degrees(w / self.radius)
        return self.lon0 + F.degrees(u / (self.radius * k)), lat

    def factor(self, lat: Column) -> Column:
        """Map scale factor in the east-west direction."""
        p = F.radians(lat)
        if self.kind == "NONE":
            return F.lit(1.0) + 0 * lat
        if self.kind in ("LC", "PS"):
            n, f = self._cone()
            return n * f * F.pow(F.tan(math.pi / 4 - p / 2), F.lit(n)) / F.cos(p)
        return math.cos(math.radians(self.lat1)) / F.cos(p)

    def rotation(self, lon: Column) -> tuple[Column, Column]:
        """(cos, sin) of the angle from the map's y axis to north."""
        n = self._cone()[0] if self.kind in ("LC", "PS") else 0.0
        a = n * F.radians(lon - self.lon0)
        return F.cos(a), F.sin(a)


def rotate(u: Column, v: Column, cos: Column, sin: Column) -> tuple[Column, Column]:
    """Wind on the map to eastward and northward wind."""
    return u * cos - v * sin, u * sin + v * cos


def grid_index(x: Column, dx: float, origin: float = 0.0) -> Column:
    """Fractional index, 1 at half a cell from the origin."""
    return (x - origin) / dx + 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def angle(a: Column, b: Column) -> Column:
    """In radians."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Area of the plane triangle between three points in space."""
    minus = lambda p, q: F.zip_with(p, q, lambda x, y: x - y)
    return norm(cross(minus(b, a), minus(c, a))) / 2
