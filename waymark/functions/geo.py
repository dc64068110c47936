"""Plane geometry, bearings, reprojection and map tiles as column expressions."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published parameters of EPSG:2326 (International 1924, transverse
# Mercator) and its position-vector shift to WGS 84.
INTL_A, INTL_F = 6378388.0, 1 / 297.0
LAT0, LON0 = math.radians(22 + 18 / 60 + 43.68 / 3600), math.radians(114 + 10 / 60 + 42.80 / 3600)
FALSE_EAST, FALSE_NORTH = 836694.05, 819069.80
SHIFT = (-162.619, -276.959, -161.764)
TURN = tuple(math.radians(s / 3600) for s in (0.067753, -2.243648, -1.158828))
SCALE = 1 - 1.094246e-6
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563


def js_round(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, as floor(x + 0.5)."""
    unit = 10.0**digits
    return F.floor(x * F.lit(unit) + F.lit(0.5)) / F.lit(unit)


def compass(dx: Column, dy: Column) -> Column:
    """Bearing in [0, 360), clockwise from north, of an east-north vector."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def cell(v: Column, size: float) -> Column:
    """Number of the grid cell of a coordinate."""
    return F.floor(v / F.lit(size))


def projected(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Nearest point of a segment to a point, and the distance."""
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    qx, qy = ax + t * dx, ay + t * dy
    return qx, qy, F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


#: The grid's own area in metres, and the degree of the polynomials over it.
AREA_X, AREA_Y, DEGREE = (785000.0, 880000.0), (785000.0, 870000.0), 8


def exact_wgs84(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitude and latitude by the published series and shift; numpy, for fitting and tests."""
    e2 = INTL_F * (2 - INTL_F)
    ep = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    quarter = INTL_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    arc = quarter * LAT0 - INTL_A * ((3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * LAT0) - (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * LAT0) + 35 * e2**3 / 3072 * math.sin(6 * LAT0))
    mu = (arc + y - FALSE_NORTH) / quarter
    p = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * np.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * np.sin(4 * mu) + 151 * e1**3 / 96 * np.sin(6 * mu) + 1097 * e1**4 / 512 * np.sin(8 * mu)
    c, t, w = ep * np.cos(p) ** 2, np.tan(p) ** 2, 1 - e2 * np.sin(p) ** 2
    d = (x - FALSE_EAST) * np.sqrt(w) / INTL_A
    lat = p - np.tan(p) * w / (1 - e2) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep - 3 * c**2) * d**6 / 720)
    lon = LON0 + (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep + 24 * t**2) * d**5 / 120) / np.cos(p)
    r = INTL_A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    px, py, pz = r * np.cos(lat) * np.cos(lon), r * np.cos(lat) * np.sin(lon), r * (1 - e2) * np.sin(lat)
    rx, ry, rz = TURN
    u = SHIFT[0] + SCALE * (px - rz * py + ry * pz)
    v = SHIFT[1] + SCALE * (rz * px + py - rx * pz)
    h = SHIFT[2] + SCALE * (rx * py - ry * px + pz)
    f2, polar = WGS_F * (2 - WGS_F), WGS_A * (1 - WGS_F)
    q = np.hypot(u, v)
    b = np.arctan2(h * WGS_A, q * polar)
    return np.degrees(np.arctan2(v, u)), np.degrees(np.arctan2(h + f2 / (1 - f2) * polar * np.sin(b) ** 3, q - f2 * WGS_A * np.cos(b) ** 3))


@functools.cache
def _polynomials() -> tuple[np.ndarray, np.ndarray]:
    """Coefficients [i, j] of u**i * v**j for longitude and latitude, fitted to the exact transform at Chebyshev nodes."""
    nodes = np.cos((np.arange(24) + 0.5) * math.pi / 24)
    u, v = (g.ravel() for g in np.meshgrid(nodes, nodes))
    lng, lat = exact_wgs84(sum(AREA_X) / 2 + u * (AREA_X[1] - AREA_X[0]) / 2, sum(AREA_Y) / 2 + v * (AREA_Y[1] - AREA_Y[0]) / 2)
    powers = [(i, j) for i in range(DEGREE + 1) for j in range(DEGREE + 1 - i)]
    terms = np.stack([u**i * v**j for i, j in powers], 1)
    out = []
    for target in (lng, lat):
        c = np.zeros((DEGREE + 1, DEGREE + 1))
        for (i, j), value in zip(powers, np.linalg.lstsq(terms, target, rcond=None)[0], strict=True):
            c[i, j] = value
        out.append(c)
    return out[0], out[1]


def wgs84_sql(x: str = "x", y: str = "y") -> dict[str, str]:
    """SQL of ``lng`` and ``lat`` from EPSG:2326 metres, the same arithmetic in any engine.

    Polynomials rather than the trigonometric series: they agree within the
    grid's area to a billionth of a degree, cost no trigonometry, and stay small
    when the optimizer pushes a predicate through them.
    """
    u = f"(({x} - {sum(AREA_X) / 2:.1f}e0) / {(AREA_X[1] - AREA_X[0]) / 2:.1f}e0)"
    v = f"(({y} - {sum(AREA_Y) / 2:.1f}e0) / {(AREA_Y[1] - AREA_Y[0]) / 2:.1f}e0)"

    def horner(values: list[str], name: str) -> str:
        out = values[-1]
        for value in reversed(values[:-1]):
            out = f"({value} + {name} * {out})"
        return out

    made = {}
    for name, c in zip(("lng", "lat"), _polynomials(), strict=True):
        rows = [horner([f"({c[i, j]:.17e})" for j in range(DEGREE + 1 - i)], v) for i in range(DEGREE + 1)]
        made[name] = horner(rows, u)
    return made


def to_wgs84(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with ``lng`` and ``lat`` of its EPSG:2326 metres.

    The polynomials hold within AREA_X and AREA_Y, the grid's own area; a place
    far outside is no place of this grid, and its degrees mean nothing.
    """
    return df.withColumns({name: F.expr(text) for name, text in wgs84_sql(x, y).items()})


def metre_bounds(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """Bounds in EPSG:2326 metres (least x, least y, greatest x, greatest y) that hold a box of degrees, a little widened.

    The corners go back by Newton steps on the exact transform; the margin of a metre and
    a twentieth of the box covers the bend of its edges.
    """
    lng, lat = np.array([west, east, west, east]), np.array([south, south, north, north])
    x, y = np.full(4, sum(AREA_X) / 2), np.full(4, sum(AREA_Y) / 2)
    for _ in range(12):
        (a, b), (ax, bx), (ay, by) = exact_wgs84(x, y), exact_wgs84(x + 1, y), exact_wgs84(x, y + 1)
        xx, xy, yx, yy = ax - a, ay - a, bx - b, by - b
        u, v, det = lng - a, lat - b, xx * yy - xy * yx
        x, y = x + (u * yy - v * xy) / det, y + (v * xx - u * yx) / det
    margin = [1.0 + (c.max() - c.min()) / 20 for c in (x, y)]
    return float(x.min() - margin[0]), float(y.min() - margin[1]), float(x.max() + margin[0]), float(y.max() + margin[1])


def tile_x(lng: Column, z: Column) -> Column:
    """Web-Mercator tile column."""
    return F.floor((lng + F.lit(180.0)) / F.lit(360.0) * F.pow(F.lit(2.0), z)).cast("long")


def tile_y(lat: Column, z: Column) -> Column:
    """Web-Mercator tile row."""
    r = F.radians(lat)
    return F.floor((F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.lit(math.pi)) / F.lit(2.0) * F.pow(F.lit(2.0), z)).cast("long")


def register(spark: SparkSession) -> None:
    """Temporary SQL functions; the analyzer inlines them."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION js_round(x DOUBLE) RETURNS DOUBLE RETURN floor(x + 0.5D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION compass(dx DOUBLE, dy DOUBLE) RETURNS DOUBLE RETURN pmod(degrees(atan2(dx, dy)), 360.0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tile_x(lng DOUBLE, z INT) RETURNS BIGINT RETURN floor((lng + 180.0D) / 360.0D * pow(2.0D, z))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tile_y(lat DOUBLE, z INT) RETURNS BIGINT RETURN floor((1.0D - ln(tan(radians(lat)) + 1.0D / cos(radians(lat))) / pi()) / 2.0D * pow(2.0D, z))")
