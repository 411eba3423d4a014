"""Planar and spherical geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def bucket(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cell_id(row: Column, col: Column) -> Column:
    """One long of a cell: the row above, the low 32 bits of the column below."""
    return F.shiftleft(row.cast("long"), 32).bitwiseOR(col.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def cell_of_id(cell: Column) -> tuple[Column, Column]:
    """Row and column of a cell_id; negative columns come back negative."""
    low = cell.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(cell, 32), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)


def gap_to_cell(x: Column, y: Column, row: Column, col: Column, size: float) -> Column:
    """Distance from a point to the closed square of a cell; cell (row, col) is [col*s, (col+1)*s] x [-(row+1)*s, -row*s]."""
    left, top = col * F.lit(float(size)), -row * F.lit(float(size))
    dx = F.greatest(left - x, x - (left + F.lit(float(size))), F.lit(0.0))
    dy = F.greatest((top - F.lit(float(size))) - y, y - top, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def slippy_tile(lat: Column, lon: Column, zoom: int = 17) -> tuple[Column, Column]:
    """Web-map tile (x, y) of a position."""
    n = float(1 << zoom)
    x = F.floor((lon + 180.0) / 360.0 * n).cast("long")
    rad = F.radians(lat)
    y = F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n).cast("long")
    return x, y


def tiles_around(lat: Column, lon: Column, radius_m: float, zoom: int = 17) -> Column:
    """Array of (tx, ty): all tiles that a circle may touch."""
    dlat = math.degrees(radius_m / EARTH_M)
    dlon = F.lit(dlat) / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    x0, y1 = slippy_tile(lat - dlat, lon - dlon, zoom)
    x1, y0 = slippy_tile(lat + dlat, lon + dlon, zoom)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6).cast("int") % 60 + 1


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres of a degree of latitude and of longitude: series in the cosines of multiples of the latitude."""
    p = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * p) + 1.175 * F.cos(4 * p) - 0.0023 * F.cos(6 * p), 111412.84 * F.cos(p) - 93.5 * F.cos(3 * p) + 0.118 * F.cos(5 * p)


def utm_forward(lat: Column, lon: Column, zone_lon: Column) -> tuple[Column, Column]:
    """Transverse Mercator easting and northing (WGS 84, northern hemisphere) about a central meridian, by the third-order Krueger series."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - k * F.atanh(k * s))
    d = F.radians(lon - zone_lon)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((alpha[j - 1] * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j in (1, 2, 3)), F.lit(0.0))
    north = xi + sum((alpha[j - 1] * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j in (1, 2, 3)), F.lit(0.0))
    return 500000 + 0.9996 * a * east, 0.9996 * a * north


def choose_grid(lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> dict:
    """Projection for metre work of an extent: polar, one UTM zone, or a conic of two parallels."""
    lat, lon = (lat_min + lat_max) / 2, (lon_min + lon_max) / 2
    if max(abs(lat_min), abs(lat_max)) > 75:
        return {"kind": "polar", "epsg": 3413 if lat > 0 else 3031}
    if lon_max - lon_min <= 6 and lat_max - lat_min <= 8:
        return {"kind": "utm", "epsg": (32600 if lat >= 0 else 32700) + int((lon + 180) // 6) % 60 + 1}
    third = (lat_max - lat_min) / 6
    return {"kind": "lcc", "lat_0": lat, "lon_0": lon, "lat_1": lat_min + third, "lat_2": lat_max - third}
