"""Coordinate systems of a study: which ones are in metres, checks of degrees, the conic projection, distortion, bounds in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, E2 = 6378137.0, 0.0066943799901413165
E1 = math.sqrt(E2)
DEGREES = {4326, 4258, 4269, 4267, 4283, 4490}


def in_degrees(epsg: int | None) -> bool:
    return epsg in DEGREES


def in_metres(epsg: int | None) -> bool:
    """Whether a known code is projected with axes in metres; unknown ones aren't taken to be."""
    if epsg is None or in_degrees(epsg):
        return False
    return 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 or 25828 <= epsg <= 25838 or epsg in {3857, 3413, 3031, 3035, 3978, 2154, 27700, 5070, 3395}


def outside_degrees(x: Column, y: Column) -> Column:
    return (F.abs(x) > 180.001) | (F.abs(y) > 90.001)


def check_degrees(df: DataFrame, epsg: int | None, x: str = "x", y: str = "y") -> DataFrame:
    """Rows of a layer tagged as degrees; coordinates that can't be degrees are an error when the rows are read."""
    if not in_degrees(epsg):
        return df
    fault = F.raise_error(F.lit(f"coordinates tagged as degrees (EPSG {epsg}) are beyond 180 and 90: they look like metres"))
    return df.withColumn(x, F.when(outside_degrees(F.col(x), F.col(y)), fault.cast("double")).otherwise(F.col(x)))


def normalised(df: DataFrame, epsg: int | None, x: str = "x", y: str = "y") -> tuple[DataFrame, int | None]:
    """Any system in degrees as EPSG 4326, after the check (its datum's shift of a metre or so is left out); one in metres as it is. A layer without
    a system is taken to be in degrees."""
    if epsg is None:
        return check_degrees(df, 4326, x, y), 4326
    return (check_degrees(df, epsg, x, y), 4326) if in_degrees(epsg) else (df, epsg)


def conic(x0: float, x1: float, y0: float, y1: float) -> dict[str, float]:
    """Conic of two parallels, a sixth of the height inside the extent (degrees)."""
    h = y1 - y0
    return {"lat_1": y0 + h / 6, "lat_2": y1 - h / 6, "lat_0": (y0 + y1) / 2, "lon_0": (x0 + x1) / 2}


def _constants(c: dict[str, float]) -> tuple[float, float, float]:
    """n, F times the radius, and the radius at the origin, of an ellipsoidal conic."""
    m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - E1 * math.sin(p)) / (1 + E1 * math.sin(p))) ** (E1 / 2)
    p1, p2, p0 = (math.radians(c[k]) for k in ("lat_1", "lat_2", "lat_0"))
    n = math.sin(p1) if abs(p1 - p2) < 1e-12 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = A * m(p1) / (n * t(p1) ** n)
    return n, f, f * t(p0) ** n


def conic_forward(lat: Column, lon: Column, c: dict[str, float]) -> tuple[Column, Column]:
    """Easting and northing of a conic."""
    n, f, r0 = _constants(c)
    p = F.radians(lat)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - E1 * F.sin(p)) / (1 + E1 * F.sin(p)), F.lit(E1 / 2))
    r, a = f * F.pow(t, F.lit(n)), n * F.radians(lon - c["lon_0"])
    return r * F.sin(a), r0 - r * F.cos(a)


def conic_inverse(x: Column, y: Column, c: dict[str, float]) -> tuple[Column, Column]:
    """Latitude and longitude of a conic's easting and northing (five rounds, below a micrometre)."""
    n, f, r0 = _constants(c)
    r = F.sqrt(x * x + (r0 - y) * (r0 - y)) * (1 if n > 0 else -1)
    t = F.pow(r / f, F.lit(1 / n))
    p = math.pi / 2 - 2 * F.atan(t)
    for _ in range(5):
        p = math.pi / 2 - 2 * F.atan(t * F.pow((1 - E1 * F.sin(p)) / (1 + E1 * F.sin(p)), F.lit(E1 / 2)))
    return F.degrees(p), F.degrees(F.atan2(x, r0 - y) / n) + c["lon_0"]


def conic_scale(lat: float, c: dict[str, float]) -> float:
    """Planar metres of a metre on the ellipsoid, at a latitude: 1 at both parallels."""
    n, f, _ = _constants(c)
    p = math.radians(lat)
    t = math.tan(math.pi / 4 - p / 2) / ((1 - E1 * math.sin(p)) / (1 + E1 * math.sin(p))) ** (E1 / 2)
    return n * f * t**n / (A * math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2))


def utm_scale(lat: float, lon: float, middle: float | None = None) -> float:
    """The same of a transverse Mercator zone (to the fourth order in the distance from its middle)."""
    middle = 6 * math.floor(lon / 6) + 3 if middle is None else middle
    p, c = math.radians(lat), E2 / (1 - E2) * math.cos(math.radians(lat)) ** 2
    t, a = math.tan(p) ** 2, math.radians(lon - middle) * math.cos(p)
    return 0.9996 * (1 + (1 + c) * a * a / 2 + (5 - 4 * t + 42 * c + 13 * c * c - 28 * E2 / (1 - E2)) * a**4 / 24)


def polar_scale(lat: float) -> float:
    """The same of a polar stereographic system that is true at 70 degrees."""
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - E1 * math.sin(p)) / (1 + E1 * math.sin(p))) ** (E1 / 2)
    m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
    p, true = math.radians(abs(lat)), math.radians(70)
    if p > math.pi / 2 - 1e-9:
        return m(true) / t(true) * math.sqrt((1 + E1) ** (1 + E1) * (1 - E1) ** (1 - E1)) / 2
    return m(true) * t(p) / (t(true) * m(p))


def distortion(x0: float, x1: float, y0: float, y1: float) -> tuple[dict, float]:
    """The projection of an extent in degrees and its largest deviation from scale 1 on a grid of three by three; over 0.02 deserves a warning."""
    from .geometry import choose_grid

    grid = choose_grid(y0, y1, x0, x1)
    lats, lons = [y0, (y0 + y1) / 2, y1], [x0, (x0 + x1) / 2, x1]
    if grid["kind"] == "utm":
        middle = 6 * math.floor(lons[1] / 6) + 3
        scale = lambda lat, lon: utm_scale(lat, lon, middle)
    elif grid["kind"] == "lcc":
        made = conic(x0, x1, y0, y1)
        scale = lambda lat, lon: conic_scale(lat, made)
    else:
        scale = lambda lat, lon: polar_scale(lat)
    return grid, max(abs(1 / scale(lat, lon) - 1) for lat in lats for lon in lons)


def bounds(df: DataFrame, x: str = "x", y: str = "y") -> tuple[float, float, float, float] | None:
    """Least x, least y, greatest x, greatest y; None of an empty table."""
    r = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return None if r[0] is None else tuple(r)


def raster_bounds_degrees(info: dict, c: dict[str, float] | None = None) -> tuple[float, float, float, float] | None:
    """(left, bottom, right, top) in degrees of a raster's metadata: as it is for one in degrees, through the inverse conic for one in its metres;
    None without a known system."""
    left, top = info["x0"], info["y0"]
    right, bottom = left + info["width"] * info["size_x"], top - info["height"] * info["size_y"]
    if in_degrees(info.get("epsg")):
        return left, bottom, right, top
    if c is None:
        return None
    n, f, r0 = _constants(c)

    def back(x: float, y: float) -> tuple[float, float]:
        r = math.copysign(math.hypot(x, r0 - y), n)
        t = (r / f) ** (1 / n)
        p = math.pi / 2 - 2 * math.atan(t)
        for _ in range(6):
            p = math.pi / 2 - 2 * math.atan(t * ((1 - E1 * math.sin(p)) / (1 + E1 * math.sin(p))) ** (E1 / 2))
        return math.degrees(math.atan2(x, r0 - y) / n) + c["lon_0"], math.degrees(p)

    edge = [back(left + (right - left) * i / 20, y) for i in range(21) for y in (bottom, top)] + [back(x, bottom + (top - bottom) * i / 20) for i in range(21) for x in (left, right)]
    lon, lat = zip(*edge)
    return min(lon), min(lat), max(lon), max(lat)
