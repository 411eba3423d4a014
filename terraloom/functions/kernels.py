"""Distance kernels, thin-plate radial function and disc-blend curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = ("none", "uniform", "linear", "gaussian")


def check_kernel(kernel: str, radius: float, plateau: float = 0.0, sigma: float = 35.0) -> None:
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r} isn't one of {', '.join(KERNELS)}")
    if kernel != "none" and radius <= 0:
        raise ValueError("the radius must be positive")
    if kernel == "linear" and not 0 <= plateau < radius:
        raise ValueError("the plateau must be at least 0 and below the radius")
    if kernel == "gaussian" and sigma <= 0:
        raise ValueError("sigma must be positive")


def kernel_weight(d: Column, kernel: str, radius: float = 100.0, plateau: float = 0.0, sigma: float = 35.0) -> Column:
    """Weight at a distance within reach: 1 for none and uniform, linear from the plateau to 0 at the radius, or a Gaussian."""
    check_kernel(kernel, radius, plateau, sigma)
    if kernel == "linear":
        return F.when(d <= plateau, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (F.lit(float(radius)) - d) / F.lit(float(radius - plateau))))
    if kernel == "gaussian":
        return F.exp(F.lit(-0.5) * (d / F.lit(float(sigma))) * (d / F.lit(float(sigma))))
    return F.lit(1.0)


def thin_plate(r: Column) -> Column:
    return F.when(r > 0, r * r * F.log(r)).otherwise(F.lit(0.0))


def ladder_radii(low: int, high: int, count: int | None = None, step: int | None = None, log: bool = False) -> list[int]:
    """Ascending distinct whole radii, by step or by count, in equal steps or equal ratios."""
    if step:
        return list(range(low, high + 1, step))
    points = np.geomspace(low, high, count) if log else np.linspace(low, high, count)
    return sorted({int(round(p)) for p in points})


def blend_weight(radii: np.ndarray, k: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Weight by distance of a blend of discs: the sum over discs that reach d of k / area, 1 at 0."""
    area = np.square(np.asarray(radii, float))
    w = np.array([(k[radii >= x] / area[radii >= x]).sum() for x in np.atleast_1d(d)])
    return w / (k / area).sum()


def blend_quantiles(radii: np.ndarray, k: np.ndarray, shares: tuple[float, ...] = (0.5, 0.9)) -> list[float]:
    """Distances within which these shares of a disc blend's weight lie; piecewise linear in the square of the distance."""
    radii, k = np.asarray(radii, float), np.asarray(k, float) / np.sum(k)
    area = radii**2
    inside = lambda a: float((k * np.minimum(a, area) / area).sum())
    knots = np.concatenate([[0.0], np.sort(area)])
    have = np.array([inside(a) for a in knots])
    return [float(np.sqrt(np.interp(s, have, knots))) for s in shares]


def log_widths(radii: np.ndarray) -> np.ndarray:
    """Trapezoid widths in the logarithm of the radius."""
    x = np.log(np.asarray(radii, float))
    if len(x) == 1:
        return np.ones(1)
    edge = np.concatenate([[x[0]], (x[1:] + x[:-1]) / 2, [x[-1]]])
    return np.diff(edge)


def radius_bounds(low: float, high: float, step: float) -> tuple[int, int, int]:
    """Whole bounds and step of a radius search, in order, from 1; the upper one is a whole number of steps above the lower."""
    step = max(1, round(step))
    a, b = sorted((max(1, round(low)), round(high)))
    return a, a + max(0, b - a) // step * step, step
