"""Exposure of points, lines and polygons to the cells of a square grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.geometry import cell_id, gap_to_cell
from terraloom.functions.kernels import check_kernel, kernel_weight


def point_cells(points: DataFrame, key: str, size: float, kernel: str = "none", radius: float = 100.0, plateau: float = 0.0, sigma: float = 35.0) -> DataFrame:
    """(key, row, col, cell, weight): each closed cell that holds a point (an edge is in two, a corner in four) or, with a kernel, lies within
    its radius; the weights of a key's points add up. Points are spread by key over the shuffle partitions before they become cells: a small file is one
    task, which would hold the cells of all of its points, and the sums need no further shuffle."""
    check_kernel(kernel, radius, plateau, sigma)
    reach = 0.0 if kernel == "none" else float(radius)
    first = lambda c: F.ceil((c - reach) / size).cast("long") - 1
    last = lambda c: F.floor((c + reach) / size).cast("long")
    spread = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    cells = spread.withColumn("col", F.explode(F.sequence(first(F.col("x")), last(F.col("x"))))).withColumn("row", F.explode(F.sequence(first(-F.col("y")), last(-F.col("y")))))
    near = cells.withColumn("d", gap_to_cell(F.col("x"), F.col("y"), F.col("row"), F.col("col"), size)).where(F.col("d") <= reach)
    out = near.withColumn("w", kernel_weight(F.col("d"), kernel, radius, plateau, sigma)).where("w > 0")
    return out.groupBy(key, "row", "col").agg(F.sum("w").alias("weight")).withColumn("cell", cell_id(F.col("row"), F.col("col")))


def clip_segment(x0: float, y0: float, x1: float, y1: float, box: tuple[float, float, float, float]) -> tuple[float, float] | None:
    """Part (from, to) of a segment inside a closed box, or None."""
    t0, t1, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
    for p, q in ((-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)):
        if p == 0:
            if q < 0:
                return None
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return (t0, t1) if t0 <= t1 else None


def line_passes(xy: np.ndarray, box: tuple[float, float, float, float]) -> int:
    """How often a line goes through a closed box: pieces that touch are one pass."""
    passes, end = 0, None
    for i in range(len(xy) - 1):
        part = clip_segment(*xy[i], *xy[i + 1], box)
        if part is None:
            end = None
            continue
        joined = end is not None and end == 1.0 and part[0] == 0.0
        passes += not joined
        end = part[1]
    return passes


def inside_polygon(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of points against a closed ring."""
    out = np.zeros(len(x), bool)
    for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
        crosses = (y0 > y) != (y1 > y)
        if crosses.any():
            at = (x1 - x0) * (y - y0) / np.where(y1 == y0, 1.0, y1 - y0) + x0
            out ^= crosses & (x < at)
    return out


def ring_clip_area(ring: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Area of a ring inside a box, by cutting it along each side in turn."""
    points = [tuple(p) for p in ring[:-1]]
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for i, p in enumerate(points):
            q = points[i - 1]
            p_in, q_in = sign * (p[axis] - bound) >= 0, sign * (q[axis] - bound) >= 0
            if p_in != q_in:
                t = (bound - q[axis]) / (p[axis] - q[axis])
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if p_in:
                out.append(p)
        points = out
        if not points:
            return 0.0
    a = np.array([*points, points[0]])
    return abs(float((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum())) / 2


def segment_gap(xy: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Least distance from a line to a box."""
    corners = np.array([(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])])
    best = np.inf
    for a, b in zip(xy[:-1], xy[1:]):
        if clip_segment(*a, *b, box):
            return 0.0
        ab = b - a
        t = np.clip(((corners - a) @ ab) / max(float(ab @ ab), 1e-300), 0, 1)
        best = min(best, float(np.hypot(*(corners - a - t[:, None] * ab).T).min()))
        for p in (a, b):
            best = min(best, float(np.hypot(max(box[0] - p[0], p[0] - box[2], 0), max(box[1] - p[1], p[1] - box[3], 0))))
    return best


def part_cells(kind: str, xy: np.ndarray, size: float, reach: float) -> Iterator[tuple[int, int, float, int]]:
    """(row, col, distance, times) of the cells that a line or polygon part passes, shares an interior with, or has within reach."""
    low, high = xy.min(axis=0) - reach, xy.max(axis=0) + reach
    for col in range(int(np.ceil(low[0] / size)) - 1, int(np.floor(high[0] / size)) + 1):
        for row in range(int(np.ceil(-high[1] / size)) - 1, int(np.floor(-low[1] / size)) + 1):
            box = (col * size, -(row + 1) * size, (col + 1) * size, -row * size)
            if kind == "line":
                n = line_passes(xy, box)
                d = 0.0 if n else segment_gap(xy, box)
            else:
                n = int(ring_clip_area(xy, box) > 1e-9 * size * size)
                d = 0.0 if n else segment_gap(xy, box)
            if n:
                yield row, col, 0.0, n
            elif reach and d <= reach:
                yield row, col, d, 1


def shape_cells(shapes: DataFrame, key: str, size: float, kernel: str = "none", radius: float = 100.0, plateau: float = 0.0, sigma: float = 35.0) -> DataFrame:
    """Cells of lines and polygons: shapes has key, kind ('line' or 'polygon') and xy (array of structs x, y), a row for each part. The geometry
    kernel is NumPy in an Arrow stage; weights and their sums are built in."""
    check_kernel(kernel, radius, plateau, sigma)
    reach = 0.0 if kernel == "none" else float(radius)
    kind_of = dict(shapes.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, r, c, d, n) for k, kind, xy in zip(frame["k"], frame["kind"], frame["xy"]) for r, c, d, n in part_cells(kind, np.array([(p["x"], p["y"]) for p in xy], float), size, reach)]
            yield pd.DataFrame(rows, columns=["k", "row", "col", "d", "times"])

    cells = shapes.select(F.col(key).alias("k"), "kind", "xy").mapInPandas(run, f"k {kind_of}, row long, col long, d double, times long")
    weighted = cells.withColumn("w", kernel_weight(F.col("d"), kernel, radius, plateau, sigma) * F.col("times")).where("w > 0")
    return weighted.groupBy(F.col("k").alias(key), "row", "col").agg(F.sum("w").alias("weight")).withColumn("cell", cell_id(F.col("row"), F.col("col")))


def exposure_frame(cells: DataFrame, channels: dict[str, DataFrame], key: str) -> DataFrame:
    """Cells with a column for each channel, whose tables have (row, col, value)."""
    out = cells
    for name, table in channels.items():
        out = out.join(table.select("row", "col", F.col("value").alias(name)), ["row", "col"], "left")
    return out


def anchored_grid(ring: list[tuple[float, float]], size: float) -> Iterator[tuple[int, int, float, float]]:
    """(row, col, x, y) of the grid cells whose middle lies in a ring; the grid is anchored at 0, 0, so ids don't depend on the area."""
    xy = np.array(ring, float)
    cols = np.arange(int(np.floor(xy[:, 0].min() / size)), int(np.floor(xy[:, 0].max() / size)) + 1)
    rows = np.arange(int(np.floor(-xy[:, 1].max() / size)), int(np.floor(-xy[:, 1].min() / size)) + 1)
    r, c = (g.ravel() for g in np.meshgrid(rows, cols, indexing="ij"))
    x, y = (c + 0.5) * size, -(r + 0.5) * size
    k = inside_polygon(x, y, xy)
    yield from zip(r[k].tolist(), c[k].tolist(), x[k].tolist(), y[k].tolist())
