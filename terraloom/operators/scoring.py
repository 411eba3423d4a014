"""Association scores: from the Gram where they can be, in NumPy on bounded samples where they need all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gram import gram, incremental_r2
from .panel import complete
from .splits import exposure_groups, qcut, running

#: Rows up to which a score over all pairs of rows is worked out (its matrices are this squared).
PAIR_ROWS = 5000
#: Rows up to which one that needs no pairs, but all values in order, is worked out on the driver, eight bytes a value.
ALL_ROWS = 20_000_000


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged: distinct values are counted first, and a running sum of the counts ranks them."""
    counts = running(df.groupBy(column).agg(F.count("*").alias("_c")), [F.col(column)], F.col("_c"), "_upto")
    return df.join(counts.select(column, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name)), column)


def score_r2(df: DataFrame, y: str, x: str, controls: list[str]) -> float:
    return incremental_r2(gram(df, [*controls, x, y]), y, x, controls)


def score_spearman(df: DataFrame, y: str, x: str, controls: list[str]) -> float:
    """Absolute correlation of the residuals of ranks on ranked controls."""
    ranked = complete(df, [y, x, *controls]).select(y, x, *controls)
    for i, c in enumerate([y, x, *controls]):
        ranked = average_rank(ranked, c, f"_r{i}")
    g = gram(ranked, [f"_r{i}" for i in range(2 + len(controls))])
    yy, xy, xx = g.residual("_r0", "_r1", [f"_r{i}" for i in range(2, 2 + len(controls))])
    return abs(xy) / (yy * xx) ** 0.5 if g.n >= 3 and yy > 1e-12 and xx > 1e-12 else 0.0


def residual_column(df: DataFrame, column: str, controls: list[str], name: str) -> DataFrame:
    """Residuals on [1, *controls] as a column expression of the solved coefficients."""
    beta = gram(df, [*controls, column]).solve(column, controls)[0]
    fit = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], controls)), F.lit(float(beta[0])))
    return df.withColumn(name, F.col(column) - fit)


def score_nrmse(df: DataFrame, y: str, x: str, controls: list[str]) -> float:
    """Root mean square difference of both sides' residuals scaled from 0 to 1; infinite without spread."""
    rows = complete(df, [y, x, *controls])
    for c, n in ((y, "_y"), (x, "_x")):
        rows = residual_column(rows, c, controls, n)
    b = rows.agg(F.min("_y"), F.max("_y"), F.min("_x"), F.max("_x"), F.count("*")).first()
    if b[4] < 3 or b[1] <= b[0] or b[3] <= b[2]:
        return float("inf")
    d = (F.col("_y") - b[0]) / (b[1] - b[0]) - (F.col("_x") - b[2]) / (b[3] - b[2])
    return rows.agg(F.sqrt(F.avg(d * d))).first()[0]


def score_mutual_info(df: DataFrame, y: str, x: str, controls: list[str] = [], bins: int = 10) -> float:  # noqa: B006
    """Plug-in mutual information, in nats, of the quantile bins of both."""
    rows = qcut(qcut(complete(df, [y, x]), y, bins, "_a"), x, bins, "_b")
    cells = {(r[0], r[1]): r[2] for r in rows.groupBy("_a", "_b").count().collect()}  # bins squared at most
    n = sum(cells.values())
    if n < 3:
        return 0.0
    a, b = {}, {}
    for (i, j), c in cells.items():
        a[i], b[j] = a.get(i, 0) + c, b.get(j, 0) + c
    return float(sum(c / n * np.log(c * n / (a[i] * b[j])) for (i, j), c in cells.items()))


def score_quartile_contrast(df: DataFrame, y: str, x: str, controls: list[str]) -> float:
    """Absolute adjusted difference of the outcome between the top and the lowest group."""
    rows = exposure_groups(complete(df, [y, x, *controls]), x)
    top = rows.agg(F.max("quartile")).first()[0]
    if not top:
        return 0.0
    names = [f"_q{k}" for k in range(1, top + 1)]
    rows = rows.withColumns({n: (F.col("quartile") == k).cast("double") for k, n in enumerate(names, 1)})
    return abs(float(gram(rows, [*names, *controls, y]).solve(y, [*names, *controls])[0][len(names)]))


def bounded_rows(df: DataFrame, columns: list[str], limit: int = PAIR_ROWS) -> np.ndarray:
    """Rows for a score over all pairs; refuses more than `limit`."""
    rows = complete(df, columns).select(*columns).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a score over all pairs takes {limit} rows at most; sample first")
    return np.array([list(r) for r in rows], float).reshape(-1, len(columns))


def u_centre(d: np.ndarray) -> np.ndarray:
    n = len(d)
    row = d.sum(axis=1)
    out = d - row[:, None] / (n - 2) - row[None, :] / (n - 2) + row.sum() / ((n - 1) * (n - 2))
    np.fill_diagonal(out, 0.0)
    return out


def distances(v: np.ndarray) -> np.ndarray:
    v = v.reshape(len(v), -1)
    return np.sqrt(np.maximum(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2), 0))


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Distance correlation (biased, as its square root)."""
    if len(x) < 3:
        return 0.0
    centre = lambda d: d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()
    a, b = centre(distances(x)), centre(distances(y))
    scale = (a * a).mean() * (b * b).mean()
    return float(np.sqrt(max(0.0, (a * b).mean()) / np.sqrt(scale))) if scale > 0 else 0.0


def distance_sums(x: np.ndarray) -> np.ndarray:
    """Sum over j of |x_i - x_j| for each i."""
    order = np.argsort(x, kind="stable")
    v, n = x[order], len(x)
    upto = np.cumsum(v)
    out = np.empty(n)
    out[order] = (2 * np.arange(n) + 2 - n) * v - 2 * upto + upto[-1]
    return out


def distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over all i, j of |x_i - x_j| |y_i - y_j|, by merges of runs ordered by y: no pairs, so O(n) of memory."""
    x, y = x - x.mean(), y - y.mean()
    by_x, n = np.argsort(x, kind="stable"), len(x)
    x, y = x[by_x], y[by_x]
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    # over j < i in the order of x, those with y_j below y_i: their number, sums of x, y and xy
    terms, below, width = np.stack([np.ones(n), x, y, x * y]), np.zeros((4, n)), 1
    order = np.arange(n)
    while width < n:
        order = order[np.argsort(order // (2 * width) * n + rank[order], kind="stable")]
        left = order // width % 2 == 0
        upto = np.cumsum(np.where(left, terms[:, order], 0.0), axis=1)
        start = order // (2 * width) * (2 * width)
        before = np.concatenate([np.zeros((4, 1)), upto], axis=1)[:, start]
        below[:, order[~left]] += (upto - before)[:, ~left]
        width *= 2
    c, sx, sy, sxy = below
    concordant = (c * x * y - x * sy - y * sx + sxy).sum()
    # all pairs, with their signs, and the concordant ones twice
    return float(2 * (2 * concordant - n * (x * y).sum()))


def fast_distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """`distance_correlation` of two columns without distance matrices."""
    n = len(x)
    if n < 3 or not x.var() or not y.var():
        return 0.0
    a, b = distance_sums(x), distance_sums(y)
    mean = lambda p, q, u, v: distance_products(p, q) / n**2 - 2 * (u @ v) / n**3 + u.sum() * v.sum() / n**4
    scale = mean(x, x, a, a) * mean(y, y, b, b)
    return float(np.sqrt(max(0.0, mean(x, y, a, b)) / np.sqrt(scale))) if scale > 0 else 0.0


def fast_partial_distance_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    """`partial_distance_correlation` on one control without distance matrices: products of U-centred matrices from their row sums."""
    n = len(x)
    if n < 4:
        return 0.0
    sums = {k: distance_sums(v) for k, v in (("x", x), ("y", y), ("z", z))}
    columns = {"x": x, "y": y, "z": z}

    def dot(p: str, q: str) -> float:
        u, v = sums[p], sums[q]
        return distance_products(columns[p], columns[q]) - 2 * (u @ v) / (n - 2) + u.sum() * v.sum() / ((n - 1) * (n - 2))

    own = {k: dot(k, k) if columns[k].var() else 0.0 for k in columns}
    r = lambda p, q: float(np.clip(dot(p, q) / np.sqrt(s), -1, 1)) if (s := own[p] * own[q]) > 0 else 0.0
    xy, xz, yz = r("x", "y"), r("x", "z"), r("y", "z")
    den = np.sqrt(1 - xz * xz) * np.sqrt(1 - yz * yz)
    return (xy - xz * yz) / den if den > 0 else 0.0


def all_rows(df: DataFrame, columns: list[str]) -> np.ndarray:
    """All complete rows, eight bytes a value, for scores that need no pairs; refuses more than ALL_ROWS."""
    rows = complete(df, columns)
    if rows.limit(ALL_ROWS + 1).count() > ALL_ROWS:
        raise ValueError(f"a score over all values in order takes {ALL_ROWS} rows at most; sample first")
    table = rows.select(*(F.col(c).cast("double").alias(str(i)) for i, c in enumerate(columns))).toArrow()
    return np.stack([c.to_numpy() for c in table.columns], axis=1) if len(table) else np.empty((0, len(columns)))


def partial_distance_correlation(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    if len(x) < 4:
        return 0.0
    a, b, c = (u_centre(distances(v)) for v in (x, y, z))
    r = lambda p, q: float(np.clip((p * q).sum() / np.sqrt(s), -1, 1)) if (s := (p * p).sum() * (q * q).sum()) > 0 else 0.0
    xy, xz, yz = r(a, b), r(a, c), r(b, c)
    den = np.sqrt(1 - xz * xz) * np.sqrt(1 - yz * yz)
    return (xy - xz * yz) / den if den > 0 else 0.0


def score_distance(df: DataFrame, y: str, x: str, controls: list[str]) -> float:
    if len(controls) > 1:
        v = bounded_rows(df, [y, x, *controls])
        return partial_distance_correlation(v[:, 1], v[:, 0], v[:, 2:])
    v = all_rows(df, [y, x, *controls])
    return fast_partial_distance_correlation(v[:, 1], v[:, 0], v[:, 2]) if controls else fast_distance_correlation(v[:, 1], v[:, 0])


SCORES = {"r2": score_r2, "spearman": score_spearman, "nrmse": score_nrmse, "mutual_info": score_mutual_info, "quartile_contrast": score_quartile_contrast, "distance": score_distance}
LOWER_IS_BETTER = {"nrmse"}


def score(metric: str, df: DataFrame, y: str, x: str, controls: list[str] = []) -> float:  # noqa: B006
    if metric not in SCORES:
        raise KeyError(f"no score {metric!r}; there are {', '.join(SCORES)}")
    return SCORES[metric](df, y, x, controls)
