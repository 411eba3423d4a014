"""Sampling grids of clustered points, the tiles that cover them, and window widths of smoothers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geometry import distance

from .spatial import radius_components


def buffered_components(points: DataFrame, key: str, buffer: float) -> DataFrame:
    """(key, component) of the dissolved buffers: points whose discs touch are one; points at one place count once."""
    return radius_components(points, key, 2 * buffer)


def clustered_grid(points: DataFrame, key: str, buffer: float, step: float) -> DataFrame:
    """(row, col, cluster_id, x, y): cells of a grid anchored at 0, 0 whose middle lies in a point's buffer, with the component of the buffers.
    A middle within reach of two points has them in one component, so a cell has one cluster."""
    low = lambda c: F.floor((c - buffer) / step - 0.5).cast("long")
    high = lambda c: F.ceil((c + buffer) / step - 0.5).cast("long")
    near = points.join(buffered_components(points, key, buffer), key).select("x", "y", "component").distinct()
    cells = near.withColumn("col", F.explode(F.sequence(low(F.col("x")), high(F.col("x"))))).withColumn("row", F.explode(F.sequence(low(-F.col("y")), high(-F.col("y")))))
    cells = cells.withColumn("cx", (F.col("col") + 0.5) * step).withColumn("cy", -(F.col("row") + 0.5) * step)
    inside = cells.where(distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")) <= float(buffer))
    return inside.groupBy("row", "col", F.col("component").alias("cluster_id")).agg(F.first("cx").alias("x"), F.first("cy").alias("y"))


def planar_tiles(cells: DataFrame, size: float) -> DataFrame:
    """(cluster_id, tile_row, tile_col, cells, bounds) of the tiles, counted from each cluster's own corner, that hold any cell."""
    corner = cells.groupBy("cluster_id").agg(F.min("x").alias("x0"), F.max("y").alias("y0"))
    at = cells.join(corner, "cluster_id").withColumn("tile_col", F.floor((F.col("x") - F.col("x0")) / size).cast("long")).withColumn("tile_row", F.floor((F.col("y0") - F.col("y")) / size).cast("long"))
    tiles = at.groupBy("cluster_id", "tile_row", "tile_col", "x0", "y0").agg(F.count("*").alias("cells"))
    left, top = F.col("x0") + F.col("tile_col") * size, F.col("y0") - F.col("tile_row") * size
    return tiles.select("cluster_id", "tile_row", "tile_col", "cells", left.alias("left"), (top - size).alias("bottom"), (left + size).alias("right"), top.alias("top"))


def quadrants(tiles: DataFrame) -> DataFrame:
    """Each tile's bounds as four."""
    mx, my = (F.col("left") + F.col("right")) / 2, (F.col("bottom") + F.col("top")) / 2
    boxes = F.array(*(F.struct(F.lit(n).alias("quadrant"), a.alias("left"), b.alias("bottom"), c.alias("right"), d.alias("top")) for n, (a, b, c, d) in enumerate(((F.col("left"), my, mx, F.col("top")), (mx, my, F.col("right"), F.col("top")), (F.col("left"), F.col("bottom"), mx, my), (mx, F.col("bottom"), F.col("right"), my)))))
    return tiles.select(*[c for c in tiles.columns if c not in ("left", "bottom", "right", "top")], F.inline(boxes))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.5) -> np.ndarray:
    """Local quadratic regression with tricube weights of the nearest share of points."""
    k = max(4, int(np.ceil(span * len(x))))
    out = np.empty(len(at))
    for i, p in enumerate(at):
        d = np.abs(x - p)
        h = max(float(np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]), 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        m = np.column_stack([np.ones(len(x)), x - p, (x - p) ** 2])
        out[i] = np.linalg.lstsq(np.sqrt(w)[:, None] * m, np.sqrt(w) * y, rcond=None)[0][0]
    return out


def first_crossing(grid: np.ndarray, curve: np.ndarray) -> float | None:
    """Where a curve first falls through 0, by linear interpolation."""
    for i in range(1, len(grid)):
        if curve[i - 1] > 0 >= curve[i]:
            return float(grid[i - 1] + (grid[i] - grid[i - 1]) * curve[i - 1] / (curve[i - 1] - curve[i]))
    return None


def effective_bandwidth(xy: np.ndarray, weights_of: Callable[[int], np.ndarray], sample: int = 50, span: float = 0.5, seed: int = 0) -> float | None:
    """Distance at which the weights that a smoother gives to other places first reach 0, as a curve over a sample of places."""
    rng = np.random.default_rng(seed)
    d, w = [], []
    for j in rng.choice(len(xy), min(sample, len(xy)), replace=False):
        d.append(np.hypot(*(xy - xy[j]).T))
        w.append(weights_of(int(j)))
    d, w = np.concatenate(d), np.concatenate(w)
    if len(d) > 4000:
        keep = rng.choice(len(d), 4000, replace=False)
        d, w = d[keep], w[keep]
    grid = np.linspace(0, float(np.quantile(d, 0.9)), 60)
    return first_crossing(grid, loess(d, w, grid, span))


def smoother_weights(basis: np.ndarray, penalty: np.ndarray, lam: float) -> Callable[[int], np.ndarray]:
    """Columns of the smoother's matrix, one at a time."""
    h = np.linalg.solve(basis.T @ basis + lam * np.diag(penalty) + 1e-10 * np.eye(basis.shape[1]), basis.T)
    return lambda j: basis @ h[:, j]


def variogram_match(observed: DataFrame, drawn: DataFrame) -> DataFrame:
    """Observed variogram (bin, n_pairs, gamma) beside the median and the 5 to 95 per cent band of surrogates' (draw, bin, gamma)."""
    p = lambda q: F.percentile("gamma", F.lit(q))
    band = drawn.groupBy("bin").agg(p(0.5).alias("surrogate_median"), p(0.05).alias("surrogate_p05"), p(0.95).alias("surrogate_p95"), F.count("*").alias("n_surrogates"))
    return observed.join(band, "bin", "left")
