"""Regressions from sums of products: one aggregation gives the Gram matrix of [1, columns], NumPy solves it. Rows never leave the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.tails import chi2_upper, t_quantile, t_two_sided

from .panel import complete


@dataclass
class Gram:
    """Sums of products of [1, *columns], weighted, and the number of rows."""

    columns: list[str]
    matrix: np.ndarray
    n: int

    def at(self, names: list[str]) -> list[int]:
        return [0 if c == "1" else 1 + self.columns.index(c) for c in names]

    def part(self, rows: list[str], cols: list[str]) -> np.ndarray:
        return self.matrix[np.ix_(self.at(rows), self.at(cols))]

    def solve(self, y: str, x: list[str]) -> tuple[np.ndarray, float, int]:
        """Coefficients of y on [1, *x], residual sum of squares, rank."""
        names = ["1", *x]
        a, b = self.part(names, names), self.part(names, [y])[:, 0]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        inverse = np.linalg.pinv(a / np.outer(scale, scale), rcond=1e-12, hermitian=True)
        beta = inverse @ (b / scale) / scale
        return beta, max(0.0, float(self.part([y], [y])[0, 0] - beta @ b)), int(np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-10, hermitian=True))

    def sst(self, y: str) -> float:
        return float(self.part([y], [y])[0, 0] - self.part(["1"], [y])[0, 0] ** 2 / self.matrix[0, 0])

    def r2(self, y: str, x: list[str]) -> float:
        total = self.sst(y)
        return 1 - self.solve(y, x)[1] / total if total > 0 else 0.0

    def residual(self, y: str, x: str, controls: list[str]) -> tuple[float, float, float]:
        """Sums of products of the residuals of y and x on the controls: yy, xy, xx."""
        names = ["1", *controls]
        inverse = np.linalg.pinv(self.part(names, names), rcond=1e-13, hermitian=True)
        s = self.part([y, x], [y, x]) - self.part([y, x], names) @ inverse @ self.part(names, [y, x])
        return float(s[0, 0]), float(s[0, 1]), float(s[1, 1])


def product_columns(columns: list[str], weight: Column | None = None) -> list[Column]:
    values = [F.lit(1.0), *(F.col(c).cast("double") for c in columns)]
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(w * values[i] * values[j]).alias(f"_{i}_{j}") for i in range(len(values)) for j in range(i, len(values))]


def from_row(row, columns: list[str]) -> Gram:
    k = len(columns) + 1
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"_{i}_{j}"] or 0.0
    return Gram(columns, m, int(row["_n"]))


#: Columns up to which the products are sums that Spark generates code for; wider tables are multiplied in NumPy, an Arrow batch at a time.
NARROW = 20


def wide_sums(rows: DataFrame, by: str | None, columns: list[str], weight: Column | None) -> DataFrame:
    """(by, _n, _m): the number of complete rows and the products of [1, *columns] as one array for each group. Each partition gives one array a
    group, whatever its rows; these are added up in two steps, so that no task takes the arrays of all partitions."""
    k = len(columns) + 1
    group = (F.col(by) if by else F.lit(0)).alias("_g")
    chosen = rows.select(group, (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"), *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)))

    def out(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([m for _, m in held.values()], pa.list_(pa.float64()))], ["_g", "_n", "_m"])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])], axis=1)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            whole = np.isfinite(x).all(axis=1) & np.isfinite(w)
            groups = batch.column(0).dictionary_encode()
            code = groups.indices.to_numpy(zero_copy_only=False)
            for i, key in enumerate(groups.dictionary.to_pylist()):
                at = whole & (code == i)
                own = held.setdefault(key, [0, np.zeros(k * k)])
                own[0] += int(at.sum())
                own[1] += ((x[at] * w[at, None]).T @ x[at]).ravel()
        if held:
            yield out(held, batch.schema.field(0).type)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = held.setdefault(key, [0, np.zeros(k * k)])
                own[0] += batch.column(1)[i].as_py()
                own[1] += batch.column(2)[i].values.to_numpy()
        if held:
            yield out(held, batch.schema.field(0).type)

    schema = f"_g {chosen.dtypes[0][1]}, _n long, _m array<double>"
    parts = chosen.where("_g is not null").mapInArrow(multiply, schema).withColumn("_p", F.spark_partition_id() % 64)
    return parts.repartition("_p", "_g").drop("_p").mapInArrow(add, schema).repartition("_g").mapInArrow(add, schema)


def _wide(row, columns: list[str]) -> Gram:
    k = len(columns) + 1
    return Gram(columns, np.array(row["_m"], float).reshape(k, k), int(row["_n"]))


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> Gram:
    """Gram matrix of the complete rows, of those with a positive weight if there is one (scaled to mean 1)."""
    if len(columns) > NARROW:
        row = wide_sums(df if weight is None else df.where(F.col(weight) > 0), None, columns, F.col(weight) if weight else None).first()
        out = _wide(row, columns) if row else Gram(columns, np.zeros((len(columns) + 1,) * 2), 0)
    else:
        rows = complete(df, columns if weight is None else [*columns, weight])
        rows = rows if weight is None else rows.where(F.col(weight) > 0)
        out = from_row(rows.agg(F.count("*").alias("_n"), *product_columns(columns, F.col(weight) if weight else None)).first(), columns)
    if weight and out.matrix[0, 0] > 0:
        out.matrix *= out.n / out.matrix[0, 0]
    return out


def grams_by(df: DataFrame, by: str, columns: list[str], weight: Column | None = None) -> dict:
    """Gram of each group; for groups that are few by design (replicates, splits, folds)."""
    if len(columns) > NARROW:
        return {r["_g"]: _wide(r, columns) for r in wide_sums(df, by, columns, weight).collect()}
    rows = complete(df, columns).groupBy(by).agg(F.count("*").alias("_n"), *product_columns(columns, weight)).collect()
    return {r[by]: from_row(r, columns) for r in rows}


def incremental_r2(g: Gram, y: str, x: str, controls: list[str]) -> float:
    if g.n < 3 or g.sst(y) <= 0:
        return 0.0
    _, xy, xx = g.residual(y, x, controls)
    return xy * xy / (xx * g.sst(y)) if xx > 1e-12 * max(g.part([x], [x])[0, 0], 1e-300) else 0.0


def partial_slope(g: Gram, y: str, x: str, controls: list[str], level: float = 0.95) -> dict:
    """Slope of standardised residuals with its exact t interval."""
    yy, xy, xx = g.residual(y, x, controls)
    if yy <= 0 or xx <= 0:
        return dict.fromkeys(("beta", "se", "df", "low", "high", "p"))
    rank = g.solve(y, controls)[2] - 1
    beta, df = xy / (xx * yy) ** 0.5, g.n - rank - 2
    se = (max(0.0, 1 - beta * beta) / df) ** 0.5 if df > 0 else float("nan")
    q = t_quantile(0.5 + level / 2, df) if df > 0 else float("nan")
    return {"beta": beta, "se": se, "df": df, "low": beta - q * se, "high": beta + q * se, "p": t_two_sided(beta / se, df) if se else 0.0}


def raw_slope(g: Gram, y: str, x: str, controls: list[str], scale: float = 1.0) -> dict:
    """Slope in the outcome's units for each `scale` of the exposure."""
    yy, xy, xx = g.residual(y, x, controls)
    if xx <= 0:
        return dict.fromkeys(("slope", "se", "df", "p"))
    b, df = xy / xx, g.n - g.solve(y, controls)[2] - 1
    se = (max(0.0, yy - b * xy) / df / xx) ** 0.5 if df > 0 else float("nan")
    return {"slope": b * scale, "se": se * scale, "df": df, "p": t_two_sided(b / se, df) if se else 0.0}


def weighted_slope(df: DataFrame, y: str, x: str, controls: list[str], weight: str) -> dict:
    """Weighted least squares with a variance that allows for unequal spread (HC1): the Gram, then one aggregation of weighted residuals."""
    g = gram(df, [*controls, x, y], weight)
    names = ["1", *controls]
    inverse = np.linalg.pinv(g.part(names, names), hermitian=True)
    on = inverse @ g.part(names, [x, y])
    _, xy, xx = g.residual(y, x, controls)
    if xx <= 0:
        return dict.fromkeys(("slope", "se", "df", "p", "n_effective"))
    b = xy / xx
    fit = lambda k: sum((F.lit(float(on[i, k])) * (F.col(c) if c != "1" else F.lit(1.0)) for i, c in enumerate(names)), F.lit(0.0))
    rows = complete(df, [*controls, x, y, weight]).where(F.col(weight) > 0)
    rx = F.col(x) - fit(0)
    e = F.col(y) - fit(1) - F.lit(b) * rx
    w = F.col(weight)
    r = rows.agg(F.sum(F.pow(w * rx * e, 2)).alias("meat"), F.avg(w).alias("mean"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("kish")).first()
    deg = g.n - g.solve(y, controls)[2] - 1
    se = (r.meat / r.mean**2 / xx**2 * g.n / deg) ** 0.5 if deg > 0 else float("nan")
    return {"slope": b, "se": se, "df": deg, "p": t_two_sided(b / se, deg) if se else 0.0, "n_effective": r.kish}


def vif(g: Gram, columns: list[str]) -> dict[str, float]:
    """1 / (1 - R2) of each column on the others; at most 1e12."""
    return {c: 1 / max(1 - g.r2(c, [o for o in columns if o != c]), 1e-12) for c in columns}


def reduce_vif(g: Gram, columns: list[str], threshold: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Columns left when the worst (leftmost of equals) goes until all are at or below the threshold, and what went."""
    left, gone = list(columns), []
    while len(left) > 1:
        v = vif(g, left)
        worst = max(left, key=lambda c: v[c])
        if v[worst] <= threshold:
            break
        gone.append((worst, v[worst]))
        left.remove(worst)
    return left, gone


def information(g: Gram, y: str, x: list[str]) -> dict:
    """Gaussian AIC and BIC of y on [1, *x]."""
    _, rss, rank = g.solve(y, x)
    like = -g.n / 2 * (np.log(2 * np.pi) + np.log(max(rss, 1e-300) / g.n) + 1)
    return {"n": g.n, "k": rank, "rss": rss, "aic": float(-2 * like + 2 * rank), "bic": float(-2 * like + rank * np.log(g.n))}


def verdict(delta_bic: float) -> str:
    """Evidence bands of a difference in BIC."""
    size = abs(delta_bic)
    band = "none" if size < 2 else "positive" if size < 6 else "strong" if size < 10 else "very strong"
    return band if size < 2 else f"{band} for {'the second' if delta_bic > 0 else 'the first'}"


def ols(df: DataFrame, y: str, x: list[str], cluster: str | None = None, level: float = 0.95) -> dict:
    """Coefficients with classical errors, or errors by cluster (CR1) from the sums of scores of each cluster."""
    g = gram(df, [*x, y])
    beta, rss, rank = g.solve(y, x)
    names = ["1", *x]
    inverse = np.linalg.pinv(g.part(names, names), hermitian=True)
    p = len(names)
    if cluster:
        values = [F.lit(1.0), *(F.col(c) for c in x)]
        e = F.col(y) - sum((F.lit(float(b)) * v for b, v in zip(beta, values)), F.lit(0.0))
        scores = complete(df, [*x, y]).groupBy(cluster).agg(*(F.sum(v * e).alias(f"s{i}") for i, v in enumerate(values)))
        r = scores.agg(F.count("*").alias("g"), *(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m_{i}_{j}") for i in range(p) for j in range(i, p))).first()
        meat = np.array([[r[f"m_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        cov, dof = inverse @ meat @ inverse * (r.g / (r.g - 1)) * ((g.n - 1) / (g.n - p)), r.g - 1
    else:
        dof = g.n - rank
        cov = inverse * rss / dof
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    q = t_quantile(0.5 + level / 2, dof)
    return {"names": names, "beta": beta, "se": se, "cov": cov, "df": dof, "low": beta - q * se, "high": beta + q * se, "p": [t_two_sided(b / s, dof) if s > 0 else float("nan") for b, s in zip(beta, se)]}


def wald(fit: dict, names: list[str]) -> tuple[float, float]:
    """Wald statistic and p of several coefficients at once."""
    at = [fit["names"].index(n) for n in names]
    b, v = np.asarray(fit["beta"])[at], fit["cov"][np.ix_(at, at)]
    stat = float(b @ np.linalg.pinv(v) @ b)
    return stat, chi2_upper(stat, len(at))


def quartile_terms(df: DataFrame, y: str, x: str, controls: list[str], cluster: str | None = None) -> dict:
    """Each group against the lowest, and the trend over group numbers."""
    from .splits import exposure_groups

    grouped = exposure_groups(complete(df, [y, x, *controls]), x)
    top = grouped.agg(F.max("quartile")).first()[0]
    names = [f"q{k}" for k in range(1, (top or 0) + 1)]
    for k, n in enumerate(names, 1):
        grouped = grouped.withColumn(n, (F.col("quartile") == k).cast("double"))
    return {"terms": ols(grouped, y, [*names, *controls], cluster), "trend": ols(grouped.withColumn("trend", F.col("quartile").cast("double")), y, ["trend", *controls], cluster)}


def moderation(df: DataFrame, y: str, x: str, moderator: str, controls: list[str]) -> dict:
    """Interaction, and slopes at the moderator's mean and one SD on either side."""
    m = complete(df, [moderator]).agg(F.avg(moderator).alias("m"), F.stddev_pop(moderator).alias("s")).first()
    fit = ols(df.withColumn("_xm", F.col(x) * F.col(moderator)), y, [x, moderator, "_xm", *controls])
    i, j = fit["names"].index(x), fit["names"].index("_xm")
    slopes = {}
    for label, at in (("low", m.m - m.s), ("mean", m.m), ("high", m.m + m.s)):
        slopes[label] = (fit["beta"][i] + at * fit["beta"][j], float(fit["cov"][i, i] + 2 * at * fit["cov"][i, j] + at * at * fit["cov"][j, j]) ** 0.5)
    return {"interaction": (fit["beta"][j], fit["p"][j]), "slopes": slopes}


def spline_columns(df: DataFrame, x: str, knots: list[float]) -> tuple[DataFrame, list[str]]:
    """Natural cubic basis (truncated powers) beyond the linear term."""
    last, before = knots[-1], knots[-2]
    cube = lambda k: F.pow(F.greatest(F.col(x) - k, F.lit(0.0)), 3)
    d = lambda k: (cube(k) - cube(last)) / (last - k)
    names = [f"_s{i}" for i in range(len(knots) - 2)]
    return df.withColumns({n: (d(k) - d(before)) / F.lit(float((last - knots[0]) ** 2)) for n, k in zip(names, knots)}), names


def spline_test(df: DataFrame, y: str, x: str, controls: list[str], inner: int = 4) -> tuple[float, float]:
    """Wald test of the spline terms beside the linear one."""
    rows = complete(df, [y, x, *controls])
    p = rows.agg(F.percentile(F.col(x), F.array(*(F.lit(0.05 + 0.9 * i / (inner - 1)) for i in range(inner))))).first()[0]
    spread, names = spline_columns(rows, x, sorted(set(p)))
    return wald(ols(spread, y, [x, *names, *controls]), names)


def correlations(g: Gram) -> list[tuple[str, str, float]]:
    """(a, b, r) of each two columns; 0 without spread."""
    out = []
    for i, a in enumerate(g.columns):
        for b in g.columns[i + 1 :]:
            _, ab, bb = g.residual(a, b, [])
            aa = g.sst(a)
            out.append((a, b, float(ab / (aa * bb) ** 0.5) if aa > 0 and bb > 0 else 0.0))
    return out
