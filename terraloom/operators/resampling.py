"""Resampled scores: permutations and multiplicities as a dimension of one job, and block designs for many weighted fits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .gram import Gram, gram
from .panel import complete
from .scoring import bounded_rows, distances, residual_column, u_centre
from .splits import draw, numbered

# permutations


def steps(n: int, count: int, seed: int = 0) -> list[tuple[int, int]]:
    """(a, b) of `count` maps i -> (a i + b) mod n that take each place once; a and b come from a fixed recurrence."""
    out, state = [], (seed * 7919 + 12345) % 2147483648
    while len(out) < count:
        state = (state * 1103515245 + 12345) % 2147483648
        a = state % max(n - 1, 1) + 1
        state = (state * 1103515245 + 12345) % 2147483648
        while gcd(a, n) != 1:
            a = a % max(n - 1, 1) + 1
        out.append((a, state % n))
    return out


def permuted_products(rows: DataFrame, key: str, moved: str, fixed: list[str], permutations: int, seed: int = 0) -> DataFrame:
    """(replicate, one sum of products with `moved`, permuted, for each fixed column). Rows stand in the order of their draws; in a replicate row i
    takes the value of row (a i + b) mod n. One join and one aggregation for all replicates, however many."""
    placed = numbered(rows.select(key, moved, *fixed, draw(F.col(key), seed).alias("_u")), [F.col("_u"), F.col(key)], "_i").withColumn("_i", F.col("_i") - 1)
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "replicate long, " + ", ".join(f"`{c}` double" for c in fixed))
    maps = F.array(*(F.struct(F.lit(k).alias("replicate"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, (a, b) in enumerate(steps(n, permutations, seed))))
    sent = placed.select("_i", *fixed, F.explode(maps).alias("m")).select(F.col("m.replicate").alias("replicate"), ((F.col("m.a") * F.col("_i") + F.col("m.b")) % n).alias("_j"), *fixed)
    values = placed.select(F.col("_i").alias("_j"), F.col(moved).alias("_v"))
    return sent.join(values, "_j").groupBy("replicate").agg(*(F.sum(F.col("_v") * F.col(c)).alias(c) for c in fixed))


def permutation_r2(df: DataFrame, y: str, x: str, controls: list[str], key: str, permutations: int = 999, seed: int = 0) -> dict:
    """Permutation test of the incremental R2: the outcome's residuals on the controls are permuted (Freedman and Lane). Under a permutation the
    fitted part stays, so the score needs only the products of the permuted residuals with [1, controls, x] and their own, which don't change."""
    rows = residual_column(complete(df, [y, x, *controls]).select(key, y, x, *controls), y, controls, "_e").withColumn("_one", F.lit(1.0))
    g = gram(rows, [*controls, x, y, "_e"])
    names = ["1", *controls]
    inverse = np.linalg.pinv(g.part(names, names), rcond=1e-13, hermitian=True)
    on = inverse @ g.part(names, [x])[:, 0]  # x on the controls
    _, xy, xx = g.residual(y, x, controls)
    ee, sst = float(g.part(["_e"], ["_e"])[0, 0]), g.sst(y)
    if g.n < 3 or sst <= 0 or xx <= 0:
        return {"observed": 0.0, "p": None, "permutations": 0, "scores": []}
    sums = permuted_products(rows, key, "_e", ["_one", *controls, x], permutations, seed).collect()
    fitted = g.solve(y, controls)[0]
    scores = []
    for r in sums:
        own = np.array([r[c] for c in ["_one", *controls]], float)  # permuted residuals with [1, controls]
        e_x = r[x] - float(on @ own)  # with the exposure's residual
        left = ee - float(own @ inverse @ own)  # what the controls leave of them
        total = float(fitted @ g.part(names, names) @ fitted) + 2 * float(fitted @ own) + ee - (float(g.part(["1"], names)[0] @ fitted) + own[0]) ** 2 / g.n
        scores.append(e_x * e_x / (xx * total) if left > 0 and total > 0 else 0.0)
    scores = [float(s) for s in scores]
    observed = xy * xy / (xx * sst)
    hits = sum(s >= observed - 1e-15 for s in scores)
    return {"observed": observed, "p": float(hits + 1) / (len(scores) + 1), "permutations": len(scores), "scores": scores}


# replicates of bounded rows, on the executors


def replicated(spark: SparkSession, count: int, body: Callable[[int], list[float]], names: list[str]) -> DataFrame:
    """(replicate, names) of a function of the replicate's number, in tasks; what it closes over is bounded by its maker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = np.array([body(i) for i in ids], float).reshape(len(ids), len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, i]) for i in range(len(names)))], ["replicate", *names])

    tasks = max(1, min(count, spark.sparkContext.defaultParallelism))
    return spark.range(0, count, 1, tasks).mapInArrow(run, "replicate long, " + ", ".join(f"`{n}` double" for n in names))


def pdcor_of(xx: float, yy: float, zz: float, xy: float, xz: float, yz: float) -> float:
    """Partial distance correlation of six products of U-centred distances."""
    r = lambda p, s: float(np.clip(p / np.sqrt(s), -1, 1)) if s > 0 else 0.0
    a, b, c = r(xy, xx * yy), r(xz, xx * zz), r(yz, yy * zz)
    den = np.sqrt(1 - b * b) * np.sqrt(1 - c * c)
    return (a - b * c) / den if den > 0 else 0.0


class DistanceScorer:
    """Partial distance correlation of many resamples or permutations of the same bounded rows: distance matrices are made once, a resample takes
    their rows and columns, a permutation of one side keeps the other two as they are."""

    def __init__(self, y: np.ndarray, x: np.ndarray, z: np.ndarray, others: dict[str, np.ndarray] | None = None):
        self.raw = {"y": distances(y), "x": distances(x), "z": distances(z)} | {k: distances(v) for k, v in (others or {}).items()}
        self.centred = {k: u_centre(v) for k, v in self.raw.items()}

    def at(self, exposure: str = "x", rows: np.ndarray | None = None) -> float:
        """On all rows, or on a resample of them."""
        y, x, z = (self.centred[k] if rows is None else u_centre(self.raw[k][np.ix_(rows, rows)]) for k in ("y", exposure, "z"))
        dot = lambda a, b: float((a * b).sum())
        return pdcor_of(dot(x, x), dot(y, y), dot(z, z), dot(x, y), dot(x, z), dot(y, z))

    def surrogate(self, order: np.ndarray, exposure: str = "x") -> float:
        """With the outcome's rows in another order."""
        y, x, z = self.centred["y"][np.ix_(order, order)], self.centred[exposure], self.centred["z"]
        dot = lambda a, b: float((a * b).sum())
        return pdcor_of(dot(x, x), dot(y, y), dot(z, z), dot(x, y), dot(x, z), dot(y, z))


def pdcor_bootstrap(df: DataFrame, y: str, exposures: list[str], controls: list[str], replicates: int = 200, seed: int = 0) -> DataFrame:
    """(replicate, one score for each exposure) over the same resamples of all exposures; PAIR_ROWS rows at most."""
    v = bounded_rows(df, [y, *controls, *exposures])
    v = v[np.lexsort(v.T)]
    k = 1 + len(controls)
    made: list[DistanceScorer] = []

    def body(i: int) -> list[float]:
        if not made:
            made.append(DistanceScorer(v[:, 0], v[:, k], v[:, 1:k], {e: v[:, k + j] for j, e in enumerate(exposures)}))
        rows = np.random.default_rng([seed, i]).integers(0, len(v), len(v))
        return [made[0].at(e, rows) for e in exposures]

    return replicated(df.sparkSession, replicates, body, exposures)


def pdcor_permutation(df: DataFrame, y: str, x: str, controls: list[str], permutations: int = 199, seed: int = 0) -> dict:
    """Permutation p of the partial distance correlation, the outcome permuted; PAIR_ROWS rows at most."""
    v = bounded_rows(df, [y, *controls, x])
    v = v[np.lexsort(v.T)]
    made: list[DistanceScorer] = []

    def scorer() -> DistanceScorer:
        if not made:
            made.append(DistanceScorer(v[:, 0], v[:, -1], v[:, 1:-1]))
        return made[0]

    observed = DistanceScorer(v[:, 0], v[:, -1], v[:, 1:-1]).at()
    body = lambda i: [scorer().surrogate(np.random.default_rng([seed, i]).permutation(len(v)))]
    r = replicated(df.sparkSession, permutations, body, ["score"]).agg(F.count_if(F.col("score") >= observed), F.count("*")).first()
    return {"observed": observed, "p": (r[0] + 1) / (r[1] + 1), "permutations": r[1]}


def residual_scorer(metric: str) -> Callable[[np.ndarray, np.ndarray], float]:
    """Score of two columns of residuals: distance correlation, or the root mean square difference of both scaled from 0 to 1."""
    from .scoring import fast_distance_correlation

    def nrmse(a: np.ndarray, b: np.ndarray) -> float:
        if len(a) < 3 or np.ptp(a) <= 0 or np.ptp(b) <= 0:
            return float("inf")
        return float(np.sqrt((((a - a.min()) / np.ptp(a) - (b - b.min()) / np.ptp(b)) ** 2).mean()))

    return {"distance": fast_distance_correlation, "nrmse": nrmse}[metric]


def residual_replicates(df: DataFrame, metric: str, y: str, x: str, controls: list[str], key: str, replicates: int = 200, seed: int = 0, permute: bool = False, rows: int = 200_000) -> DataFrame:
    """(replicate, score) of resampled or, with `permute`, permuted residuals on the controls; `rows` rows at most go to each task."""
    made = complete(df, [y, x, *controls]).select(key, y, x, *controls)
    for c, n in ((y, "_y"), (x, "_x")):
        made = residual_column(made, c, controls, n)
    v = bounded_rows(made.select(F.col(key).cast("double").alias("_k"), "_y", "_x"), ["_k", "_y", "_x"], rows)
    v = v[np.argsort(v[:, 0], kind="stable")][:, 1:]
    score = residual_scorer(metric)

    def body(i: int) -> list[float]:
        rng = np.random.default_rng([seed, i])
        if permute:
            return [score(v[rng.permutation(len(v)), 0], v[:, 1])]
        at = rng.integers(0, len(v), len(v))
        return [score(v[at, 0], v[at, 1])]

    return replicated(df.sparkSession, replicates, body, ["score"])


# many weighted fits


def orthonormal(a: np.ndarray, rtol: float = 1e-10) -> np.ndarray:
    """Orthonormal basis of the columns' space; directions under `rtol` of the largest are left out."""
    if not a.size:
        return np.zeros((len(a), 0))
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    return u[:, s > rtol * max(float(s[0]), 1e-300)] if len(s) and s[0] > 0 else np.zeros((len(a), 0))


def smooth_blocks(s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of the blocks of a block-diagonal matrix: columns that share a row with a value are in one block."""
    parent = list(range(s.shape[1]))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    there = s != 0
    for row in there:
        at = np.flatnonzero(row)
        for j in at[1:]:
            parent[root(int(j))] = root(int(at[0]))
    groups: dict[int, list[int]] = {}
    for j in range(s.shape[1]):
        groups.setdefault(root(j), []).append(j)
    return [(np.flatnonzero(there[:, cols].any(axis=1)), np.array(cols)) for cols in groups.values()]


class BlockDesign:
    """Dense columns beside a block-diagonal smooth, for many weighted fits: each block's columns are taken out of the dense ones (and of the
    outcomes) block by block, so a fit solves small systems, never one as wide as the smooth."""

    def __init__(self, dense: np.ndarray, smooth: np.ndarray):
        self.dense, self.smooth, self.blocks = dense, smooth, smooth_blocks(smooth)

    def products(self, weights: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Weighted products of [dense, values] after the smooth has been taken out."""
        z = np.column_stack([self.dense, values])
        m = (z * weights[:, None]).T @ z
        for rows, cols in self.blocks:
            b, w = self.smooth[np.ix_(rows, cols)], weights[rows]
            cross = (b * w[:, None]).T @ z[rows]
            m -= cross.T @ np.linalg.pinv((b * w[:, None]).T @ b, rcond=1e-10, hermitian=True) @ cross
        return m

    def r2(self, weights: np.ndarray, y: np.ndarray, x: np.ndarray) -> float:
        """Incremental R2 of x beside the dense columns and the smooth, in the weighted rows."""
        m, k = self.products(weights, np.column_stack([y, x])), self.dense.shape[1]
        a = m[k:, k:] - m[k:, :k] @ np.linalg.pinv(m[:k, :k], rcond=1e-10, hermitian=True) @ m[:k, k:]
        sst = float((weights * (y - np.average(y, weights=weights)) ** 2).sum())
        return float(a[0, 1] ** 2 / (a[1, 1] * sst)) if a[1, 1] > 1e-12 and sst > 0 else 0.0


def row_weights(rows: np.ndarray, n: int) -> np.ndarray:
    """How often each of n rows is in each resample (a row of `rows`)."""
    out = np.zeros((len(rows), n))
    for i, r in enumerate(rows):
        out[i] = np.bincount(r, minlength=n)
    return out


def jackknife(whole: Gram, parts: list[Gram], statistic: Callable[[Gram], float]) -> np.ndarray:
    """The statistic without each part in turn, by subtraction of its products."""
    return np.array([statistic(Gram(whole.columns, whole.matrix - p.matrix, whole.n - p.n)) for p in parts])
