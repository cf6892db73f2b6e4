"""Geometry and orientation as column expressions. Angles are in degrees."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR_M = 6_378_137.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Clockwise from north, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))) + 360, F.lit(360.0))


def section(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> tuple[Column, Column]:
    """Distance along a line from its start, and signed offset (positive to the right)."""
    length = math.hypot(x1 - x0, y1 - y0)
    ux, uy = (x1 - x0) / length, (y1 - y0) / length
    return (x - x0) * ux + (y - y0) * uy, (x - x0) * uy - (y - y0) * ux


def in_corridor(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float, width: float) -> Column:
    """Within `width` of the segment; the box around it is tested first."""
    along, _ = section(x, y, x0, y0, x1, y1)
    length = math.hypot(x1 - x0, y1 - y0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(length), along))
    px, py = x0 + t * ((x1 - x0) / length), y0 + t * ((y1 - y0) / length)
    box = x.between(min(x0, x1) - width, max(x0, x1) + width) & y.between(min(y0, y1) - width, max(y0, y1) + width)
    return box & (F.pow(x - px, 2) + F.pow(y - py, 2) <= width * width)


def directions(azimuth: Column, dip: Column) -> tuple[Column, Column, Column]:
    """North, east and up of a hole that dips below the horizon where dip is negative."""
    a, d = F.radians(azimuth), F.radians(dip)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def straight_end(x: Column, y: Column, z: Column, azimuth: Column, dip: Column, depth: Column) -> tuple[Column, Column, Column]:
    n, e, u = directions(azimuth, dip)
    return x + depth * e, y + depth * n, z + depth * u


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR_M, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * MERCATOR_M


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point."""
    n = 1 << zoom
    up = F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat)))
    clamp = lambda c: F.least(F.greatest(F.floor(c).cast("int"), F.lit(0)), F.lit(n - 1))
    return clamp((lon + 180) / 360 * n), clamp((1 - up / math.pi) / 2 * n)


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """Axial key `q:r` of the hexagon (pointy top, `size` from centre to corner) that holds
    a planar point. Not an H3 index."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    qq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    rr2 = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.concat_ws(":", qq.cast("long"), rr2.cast("long"))


def resolution(zoom: Column) -> Column:
    return F.when(zoom <= 5, 5).when(zoom <= 10, 7).otherwise(9)


def stereonet(trend: Column, plunge: Column, equal_area: bool = True) -> tuple[Column, Column]:
    """Lower-hemisphere projection of a line on the unit circle."""
    c = F.radians(90 - plunge)
    r = math.sqrt(2) * F.sin(c / 2) if equal_area else F.tan(c / 2)
    return r * F.sin(F.radians(trend)), r * F.cos(F.radians(trend))


def pole(dip: Column, dip_direction: Column) -> tuple[Column, Column]:
    """Trend and plunge of a plane's pole."""
    return F.pmod(dip_direction + 180, F.lit(360.0)), 90 - dip


def true_orientation(alpha: Column, beta: Column, azimuth: Column, dip: Column) -> tuple[Column, Column]:
    """True dip and dip direction of a plane measured on core by alpha and beta. The plane's
    normal is a sum of three directions of the hole: along it (as far as alpha is small),
    towards the high side of the core and sideways, level to the right. A flat plane has
    direction 0."""
    along, high, side = directions(azimuth, dip), directions(azimuth, dip + 90), directions(azimuth + 90, F.lit(0.0))
    opening = F.sin(F.radians(alpha))
    parts = ((F.cos(F.radians(alpha)), along), (-opening * F.cos(F.radians(beta)), high), (opening * F.sin(F.radians(beta)), side))
    return steepest(*(reduce(operator.add, (size * way[k] for size, way in parts)) for k in range(3)))


def steepest(north: Column, east: Column, up: Column) -> tuple[Column, Column]:
    """Dip and dip direction of the plane with this normal, turned downwards; the direction
    is measured from east, as in the definition that results have to equal."""
    level = F.hypot(north, east)
    turned = F.when(up > 0, F.atan2(-north, -east)).otherwise(F.atan2(north, east))
    return F.degrees(F.atan2(level, F.abs(up))), F.when(level < 1e-9, 0.0).otherwise(F.pmod(F.degrees(turned), F.lit(360.0)))


def long_section(x: Column, y: Column, x0: float, y0: float, azimuth: float) -> tuple[Column, Column]:
    """Along and across a reference azimuth."""
    a = math.radians(azimuth)
    return (x - x0) * math.sin(a) + (y - y0) * math.cos(a), (x - x0) * math.cos(a) - (y - y0) * math.sin(a)


# WGS 84 and the UTM grid (fixed values).
SEMI_MAJOR, FLATTENING, SCALE = 6_378_137.0, 1 / 298.257223563, 0.9996
_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) by the third-order series in the third
    flattening; good to millimetres within a zone."""
    p, d = F.radians(lat), F.radians(lon - (6 * zone - 183))
    k = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(F.sin(p)) - k * atanh(k * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1)), F.lit(0.0))
    return 500_000 + SCALE * _RECTIFYING * east, SCALE * _RECTIFYING * north


def from_utm(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude."""
    xi, eta = northing / (SCALE * _RECTIFYING), (easting - 500_000) / (SCALE * _RECTIFYING)
    x = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BACK, 1)), F.lit(0.0))
    e = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BACK, 1)), F.lit(0.0))
    c = F.asin(F.sin(x) / F.cosh(e))
    lat = c + sum((d * F.sin(2 * j * c) for j, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
    return 6 * zone - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)


def hex_parent(q: Column, r: Column) -> tuple[Column, Column]:
    """The axial key of the larger hexagon (of seven) that a hexagon belongs to. Parents' centres
    are the hexagons 2a - b, a + 3b; each other hexagon touches exactly one of these. With the
    place among the seven known from q + 5r modulo 7, all is whole numbers."""
    place = F.pmod(q + 5 * r, F.lit(7))
    step = lambda of: F.element_at(F.array(*map(F.lit, of)), (place + 1).cast("int"))
    a, b = q - step([0, 1, 0, 1, -1, 0, -1]), r - step([0, 0, -1, -1, 1, 1, 0])
    return ((3 * a + b) / 7).cast("long"), ((2 * b - a) / 7).cast("long")
