"""Grids, map projections and areas as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Grid:
    """Cells of ``px`` by ``px`` from the corner (x0, y0); rows count downwards."""

    x0: float
    y0: float
    px: float

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.px).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.px).cast("int")

    def x(self, c: Column) -> Column:
        return self.x0 + (c + 0.5) * self.px

    def y(self, r: Column) -> Column:
        return self.y0 - (r + 0.5) * self.px


def snap_down(x: Column, px: float) -> Column:
    return F.floor(x / px) * px


def snap_up(x: Column, px: float) -> Column:
    return F.ceil(x / px) * px


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60)).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def utm_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 in the point's own UTM zone, by the transverse Mercator series to sixth order."""
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep2 = e2 / (1 - e2)
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = a / F.sqrt(1 - e2 * sin * sin)
    t, c = tan * tan, ep2 * cos * cos
    d = cos * F.radians(lon - (zone * 6 - 183))
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    x = k0 * n * (d + (1 - t + c) * d**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * d**5 / 120) + 500000.0
    y = k0 * (m + n * tan * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * d**6 / 720))
    return x, F.when(lat < 0, y + 10000000.0).otherwise(y)


def pixel_area(width: Column, height: Column, lat: Column | None = None) -> Column:
    """Area of a cell in square metres; with ``lat`` the sides are degrees."""
    area = F.abs(width * height)
    return area if lat is None else area * 111132.92 * 111412.84 * F.cos(F.radians(lat))


def iho_order(rmse: Column, depth: Column) -> Column:
    """Survey order that a 95 % uncertainty of 1.96 RMSE meets at a depth."""
    limit = {k: F.sqrt(F.lit(a * a) + (F.lit(b) * depth) ** 2) for k, a, b in (("Special Order", 0.25, 0.0075), ("Order 1a/1b", 0.5, 0.013), ("Order 2", 1.0, 0.023))}
    tvu = rmse * 1.96
    out = F.lit("Out of Spec")
    for name, most in reversed(limit.items()):
        out = F.when(tvu <= most, name).otherwise(out)
    return out


def scene_weight(r2: Column, rmse: Column) -> Column:
    floor = F.lit(0.001)
    return F.greatest(floor, r2) / (F.greatest(floor, rmse) + 0.001)


