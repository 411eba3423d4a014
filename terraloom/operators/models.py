"""Logistic, marginal (GEE) and mixed models. Each step of a fit is one aggregation of sums by row or by entity; the small system is solved on
the driver, so no model takes rows off the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.tails import NORMAL

from .panel import complete


def linear(beta: np.ndarray, x: list[str]) -> Column:
    return sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta[1:], x)), F.lit(float(beta[0])))


def _sums(rows: DataFrame, values: list[Column], weight: Column, residual: Column) -> tuple[np.ndarray, np.ndarray]:
    p = len(values)
    r = rows.agg(*(F.sum(weight * values[i] * values[j]).alias(f"a_{i}_{j}") for i in range(p) for j in range(i, p)), *(F.sum(values[i] * residual).alias(f"s_{i}") for i in range(p))).first()
    return np.array([[r[f"a_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float), np.array([r[f"s_{i}"] for i in range(p)], float)


def scaled(df: DataFrame, y: str, x: list[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Complete rows with standardised columns, their means and SDs."""
    rows = complete(df, [y, *x])
    r = rows.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if x else None
    mean, sd = np.array([r[f"m_{i}"] or 0.0 for i in range(len(x))]), np.array([max(r[f"s_{i}"] or 0.0, 1e-12) for i in range(len(x))])
    return rows.withColumns({c: (F.col(c) - F.lit(float(mean[i]))) / F.lit(float(sd[i])) for i, c in enumerate(x)}), mean, sd


def unscale(beta: np.ndarray, cov: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients in the columns' own units."""
    t = np.diag(np.concatenate([[1.0], 1 / sd]))
    t[0, 1:] = -mean / sd
    return t @ beta, t @ cov @ t.T


def logit(df: DataFrame, y: str, x: list[str], rounds: int = 25) -> dict:
    """Logistic regression by iterated weighted least squares: one aggregation for each round."""
    rows, mean, sd = scaled(df, y, x)
    rows = rows.select(y, *x).persist()
    r = rows.agg(F.count("*"), F.count_distinct(y), F.min(y), F.max(y)).first()
    if r[0] < 10 or r[1] != 2:
        rows.unpersist()
        return {"names": ["1", *x], "beta": None, "se": None, "z": None, "n": r[0]}
    event = (F.col(y) == r[3]).cast("double")
    values, beta = [F.lit(1.0), *map(F.col, x)], np.zeros(len(x) + 1)
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-linear(beta, x)))
        mu = F.least(F.greatest(mu, F.lit(1e-10)), F.lit(1 - 1e-10))
        a, s = _sums(rows, values, mu * (1 - mu), event - mu)
        step = np.linalg.solve(a + 1e-10 * np.eye(len(a)), s)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    rows.unpersist()
    beta, cov = unscale(beta, np.linalg.pinv(a), mean, sd)
    se = np.sqrt(np.diag(cov))
    return {"names": ["1", *x], "beta": beta, "se": se, "z": beta / se, "p": [2 * (1 - NORMAL.cdf(abs(v))) for v in beta / se], "cov": cov, "n": r[0]}


def gee_logit(df: DataFrame, entity: str, y: str, x: list[str], rounds: int = 25) -> dict:
    """Marginal logistic model with exchangeable correlation and sandwich errors, from sums by entity. With V = A^1/2 R(alpha) A^1/2, the inverse
    of R is (I - alpha / (1 + (m-1) alpha) 11') / (1 - alpha), so an entity adds two sums."""
    rows, mean, sd = scaled(df, y, x)
    start = logit(df, y, x)
    if start["beta"] is None:
        return start
    rows = rows.select(entity, y, *x).persist()
    top = rows.agg(F.max(y)).first()[0]
    event = (F.col(y) == top).cast("double")
    beta = np.concatenate([[start["beta"][0] + (start["beta"][1:] * mean).sum()], start["beta"][1:] * sd])
    p, alpha = len(beta), 0.0
    values = [F.lit(1.0), *map(F.col, x)]
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-linear(beta, x)))
        mu = F.least(F.greatest(mu, F.lit(1e-8)), F.lit(1 - 1e-8))
        root = F.sqrt(mu * (1 - mu))
        r = (event - mu) / root
        per = rows.groupBy(entity).agg(F.count("*").alias("m"), F.sum(r).alias("r"), F.sum(r * r).alias("rr"), *(F.sum(root * v).alias(f"d{i}") for i, v in enumerate(values)), *(F.sum(root * v * r).alias(f"e{i}") for i, v in enumerate(values)), *(F.sum(mu * (1 - mu) * values[i] * values[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)))
        t = per.agg(F.sum("m").alias("n"), F.sum("rr").alias("rr"), F.sum((F.col("r") * F.col("r") - F.col("rr")) / 2).alias("cross"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.max("m").alias("most")).first()
        phi = t.rr / max(t.n - p, 1)
        alpha = float(np.clip(t.cross / max(t.pairs - p, 1) / phi, -1 / max(t.most - 1, 1) + 1e-6, 0.99)) if t.pairs else 0.0
        k = F.lit(alpha) / (1 + (F.col("m") - 1) * alpha)
        score = [(F.col(f"e{i}") - k * F.col(f"d{i}") * F.col("r")) / (1 - alpha) for i in range(p)]
        out = per.agg(
            *(F.sum((F.col(f"a{i}_{j}") - k * F.col(f"d{i}") * F.col(f"d{j}")) / (1 - alpha)).alias(f"b{i}_{j}") for i in range(p) for j in range(i, p)),
            *(F.sum(score[i]).alias(f"s{i}") for i in range(p)),
            *(F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)),
        ).first()
        full = lambda c: np.array([[out[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)  # noqa: E731, B023
        bread = np.linalg.pinv(full("b"))
        step = bread @ np.array([out[f"s{i}"] for i in range(p)])
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    rows.unpersist()
    beta, cov = unscale(beta, bread @ full("m") @ bread, mean, sd)
    se = np.sqrt(np.diag(cov))
    return {"names": ["1", *x], "beta": beta, "se": se, "z": beta / se, "alpha": alpha, "cov": cov, "n": t.n}


def _entity_sums(df: DataFrame, entity: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """What the likelihood of a random intercept needs of [1, *x, y]: the whole Gram, and by entity size m the Gram of entity sums."""
    rows = complete(df, columns)
    values = [F.lit(1.0), *map(F.col, columns)]
    k = len(values)
    per = rows.groupBy(entity).agg(F.count("*").alias("m"), *(F.sum(v).alias(f"t{i}") for i, v in enumerate(values)), *(F.sum(values[i] * values[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)))
    sized = per.groupBy("m").agg(F.count("*").alias("entities"), *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"u{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(f"g{i}_{j}").alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).orderBy("m").collect()
    full = lambda r, c: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    gram = sum((full(r, "g") for r in sized), np.zeros((k, k)))
    return np.array([r.m for r in sized]), np.array([full(r, "u") for r in sized]).reshape(-1, k, k), gram, sum(r.entities for r in sized), np.array([r.entities for r in sized])


def mixed(df: DataFrame, entity: str, y: str, x: list[str], reml: bool = True) -> dict:
    """Random-intercept model. Its likelihood at a variance ratio needs only the Gram and, for each entity size, the products of entity sums:
    one job, then a one-dimensional search on the driver."""
    rows, mean, sd = scaled(df, y, x)
    sizes, sums, g, entities, counts = _entity_sums(rows, entity, [*x, y])
    n, p = int(round(g[0, 0])), len(x) + 1
    if n < 6 or entities < 2:
        return {"names": ["1", *x], "beta": None, "t": None, "loglik": None, "n": n}

    def at(ratio: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        shrink = ratio / (1 + ratio * sizes)
        m = g - np.tensordot(shrink, sums, axes=(0, 0))
        a, b, c = m[:p, :p], m[:p, p], m[p, p]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        rss, dof = max(float(c - b @ beta), 1e-12), n - p if reml else n
        logdet = float((np.log1p(ratio * sizes) * counts).sum())
        like = -0.5 * (dof * (np.log(2 * np.pi * rss / dof) + 1) + logdet + (np.linalg.slogdet(a)[1] if reml else 0.0))
        return like, beta, rss / dof, a

    grid = np.concatenate([[0.0], np.logspace(-6, 4, 81)])
    best = max(grid, key=lambda r: at(r)[0])
    low, high = best / 1.5, max(best * 1.5, 1e-7)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if at(a)[0] > at(b)[0] else (a, high)
    ratio = max([(low + high) / 2, best], key=lambda r: at(r)[0])
    like, beta, s2, a = at(ratio)
    beta, cov = unscale(beta, s2 * np.linalg.pinv(a), mean, sd)
    se = np.sqrt(np.diag(cov))
    return {"names": ["1", *x], "beta": beta, "se": se, "t": beta / se, "loglik": like, "sigma2": s2, "tau2": ratio * s2, "n": n, "entities": entities, "cov": cov}


def marginal_r2(df: DataFrame, entity: str, y: str, x: list[str]) -> float:
    """Variance of the fixed part over that of all parts."""
    fit = mixed(df, entity, y, x)
    if fit["beta"] is None:
        return 0.0
    fixed = complete(df, [y, *x]).agg(F.var_pop(linear(fit["beta"], x))).first()[0]
    return fixed / (fixed + fit["tau2"] + fit["sigma2"])


def mixed_scores(df: DataFrame, entity: str, y: str, x: str, controls: list[str]) -> dict:
    """Of one exposure: REML t, drop in marginal R2, likelihood ratio, signed coefficient."""
    full = mixed(df, entity, y, [x, *controls])
    if full["beta"] is None:
        return dict.fromkeys(("tstat", "r2", "lr", "coef"), 0.0)
    ml, null = mixed(df, entity, y, [x, *controls], reml=False), mixed(df, entity, y, controls, reml=False)
    return {"tstat": abs(float(full["t"][1])), "r2": max(0.0, marginal_r2(df, entity, y, [x, *controls]) - marginal_r2(df, entity, y, controls)), "lr": 2 * (ml["loglik"] - null["loglik"]), "coef": float(full["beta"][1])}


def decline_terms(df: DataFrame, entity: str, y: str, x: str, years: str, controls: list[str]) -> dict[str, tuple[float, float]]:
    """Exposure by time: as a whole, and apart for the entity's mean and its deviations. (coefficient, t) of each."""
    from .panel import within_between

    rows = within_between(complete(df, [y, x, years, *controls]), entity, x).withColumns({"_xt": F.col(x) * F.col(years)})
    rows = rows.withColumns({"_bt": F.col("between") * F.col(years), "_wt": F.col("within") * F.col(years)})
    whole = mixed(rows, entity, y, [x, years, "_xt", *controls])
    parts = mixed(rows, entity, y, ["between", "within", years, "_bt", "_wt", *controls])
    pick = lambda f, c: (float(f["beta"][f["names"].index(c)]), float(f["t"][f["names"].index(c)]))
    return {"overall": pick(whole, "_xt"), "between": pick(parts, "_bt"), "within": pick(parts, "_wt")}


def compare_mixed(df: DataFrame, entity: str, y: str, full: list[str], single: str, controls: list[str]) -> dict:
    """AIC and BIC, under maximum likelihood, of all channels and of one."""
    out = {}
    for name, x in (("full", [*full, *controls]), ("single", [single, *controls])):
        f = mixed(df, entity, y, x, reml=False)
        k = len(x) + 3
        out[name] = {"aic": -2 * f["loglik"] + 2 * k, "bic": -2 * f["loglik"] + k * np.log(f["n"])}
    return out | {"delta_bic": out["full"]["bic"] - out["single"]["bic"]}


def covariate_impact(df: DataFrame, entity: str, y: str, x: str, controls: list[str]) -> list[dict]:
    """What each control adds to the random-intercept model: the drop in marginal R2 and the likelihood ratio without it, and the exposure's
    coefficient and t then. All fits are of sums that one aggregation gives."""
    fits = MixedSums(df, entity, [x, *controls, y])
    full, ml = fits.fit(y, [x, *controls]), fits.fit(y, [x, *controls], reml=False)
    if full["beta"] is None:
        return []
    whole, out = fits.marginal_r2(y, [x, *controls]), []
    for c in controls:
        rest = [x, *(o for o in controls if o != c)]
        part, ml_part = fits.fit(y, rest), fits.fit(y, rest, reml=False)
        out.append({"covariate": c, "r2_drop": max(0.0, whole - fits.marginal_r2(y, rest)), "lr": 2 * (ml["loglik"] - ml_part["loglik"]), "coef_without": float(part["beta"][1]), "t_without": float(part["t"][1]), "coef": float(full["beta"][1])})
    return out


class MixedSums:
    """Sums of a panel from which any random-intercept model of its columns follows: by entity size, the products of entity sums and of rows. With
    replicate weights these are the sums of a bootstrap over entities."""

    def __init__(self, df: DataFrame, entity: str, columns: list[str], sums: tuple | None = None):
        self.columns = columns
        self.sizes, self.sums, self.gram, self.entities, self.counts = sums or _entity_sums(df, entity, columns)

    def _part(self, names: list[str]) -> np.ndarray:
        return np.array([0 if n == "1" else 1 + self.columns.index(n) for n in names])

    def fit(self, y: str, x: list[str], reml: bool = True) -> dict:
        at, p = self._part(["1", *x, y]), len(x) + 1
        g, sums = self.gram[np.ix_(at, at)], self.sums[:, at[:, None], at[None, :]]
        n = int(round(g[0, 0]))
        if n < 6 or self.entities < 2:
            return {"names": ["1", *x], "beta": None, "t": None, "loglik": None, "n": n}
        # columns at unit size, so that the small system is well behaved
        size = np.sqrt(np.maximum(np.diag(g) / n, 1e-300))
        size[0] = size[-1] = 1.0
        g, sums = g / np.outer(size, size), sums / np.outer(size, size)

        def at_ratio(ratio: float) -> tuple[float, np.ndarray, float, np.ndarray]:
            m = g - np.tensordot(ratio / (1 + ratio * self.sizes), sums, axes=(0, 0))
            a, b, c = m[:p, :p], m[:p, p], m[p, p]
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            rss, dof = max(float(c - b @ beta), 1e-12), n - p if reml else n
            logdet = float((np.log1p(ratio * self.sizes) * self.counts).sum())
            # the determinant in the columns' own units
            own = np.linalg.slogdet(a)[1] + 2 * np.log(size[:p]).sum() if reml else 0.0
            return -0.5 * (dof * (np.log(2 * np.pi * rss / dof) + 1) + logdet + own), beta, rss / dof, a

        best = max(np.concatenate([[0.0], np.logspace(-6, 4, 81)]), key=lambda r: at_ratio(r)[0])
        low, high = best / 1.5, max(best * 1.5, 1e-7)
        for _ in range(60):
            a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
            low, high = (low, b) if at_ratio(a)[0] > at_ratio(b)[0] else (a, high)
        ratio = max([(low + high) / 2, best], key=lambda r: at_ratio(r)[0])
        like, beta, s2, a = at_ratio(ratio)
        beta, cov = beta / size[:p], s2 * np.linalg.pinv(a) / np.outer(size[:p], size[:p])
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        return {"names": ["1", *x], "beta": beta, "se": se, "t": beta / se, "loglik": like, "sigma2": s2, "tau2": ratio * s2, "n": n, "entities": self.entities, "cov": cov}

    def marginal_r2(self, y: str, x: list[str]) -> float:
        """Variance of the fixed part, from the same sums, over that of all parts."""
        f = self.fit(y, x)
        if f["beta"] is None:
            return 0.0
        at = self._part(["1", *x])
        g, b = self.gram[np.ix_(at, at)], f["beta"]
        fixed = float(b @ g @ b) / f["n"] - (float(g[0] @ b) / f["n"]) ** 2
        return fixed / (fixed + f["tau2"] + f["sigma2"])

    def metrics(self, y: str, x: str, controls: list[str]) -> dict:
        """Of one exposure: REML t, drop in marginal R2, likelihood ratio, coefficient."""
        full = self.fit(y, [x, *controls])
        if full["beta"] is None:
            return dict.fromkeys(("tstat", "r2", "lr", "coef"), 0.0)
        ml, null = self.fit(y, [x, *controls], reml=False), self.fit(y, controls, reml=False)
        return {"tstat": abs(float(full["t"][1])), "r2": max(0.0, self.marginal_r2(y, [x, *controls]) - self.marginal_r2(y, controls)), "lr": 2 * (ml["loglik"] - null["loglik"]), "coef": float(full["beta"][1])}


def entity_bootstrap(df: DataFrame, entity: str, y: str, x: str, controls: list[str], metric: str = "tstat", replicates: int = 200, level: float = 0.95, seed: int = 0) -> dict:
    """Interval of a mixed-model score over resamples of entities. Each entity's sums are weighted by how often a replicate draws it, and the
    replicates are a dimension of the aggregation: rows are read once."""
    from .inference import poisson_weight

    columns = [x, *controls, y]
    rows = complete(df, columns)
    values = [F.lit(1.0), *map(F.col, columns)]
    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    per = rows.groupBy(entity).agg(F.count("*").alias("m"), *(F.sum(v).alias(f"t{i}") for i, v in enumerate(values)), *(F.sum(values[i] * values[j]).alias(f"g{i}_{j}") for i, j in pairs))
    spread = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(F.xxhash64(entity) if dict(df.dtypes)[entity] == "string" else F.col(entity), F.col("replicate"), seed)).where("w > 0")
    sized = spread.groupBy("replicate", "m").agg(F.sum("w").alias("entities"), *(F.sum(F.col("w") * F.col(f"t{i}") * F.col(f"t{j}")).alias(f"u{i}_{j}") for i, j in pairs), *(F.sum(F.col("w") * F.col(f"g{i}_{j}")).alias(f"g{i}_{j}") for i, j in pairs)).collect()
    full = lambda r, c: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    by: dict[int, list] = {}
    for r in sorted(sized, key=lambda r: (r.replicate, r.m)):
        by.setdefault(r.replicate, []).append(r)
    draws = []
    for part in by.values():
        sums = (np.array([r.m for r in part]), np.array([full(r, "u") for r in part]), sum(full(r, "g") for r in part), sum(r.entities for r in part), np.array([r.entities for r in part]))
        draws.append(MixedSums(df, entity, columns, sums).metrics(y, x, controls)[metric])
    observed = MixedSums(df, entity, columns).metrics(y, x, controls)[metric]
    low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2]) if draws else (float("nan"),) * 2
    return {"observed": observed, "low": float(low), "high": float(high), "replicates": len(draws)}


def post_metrics(df: DataFrame, entity: str, y: str, exposures: list[str], controls: list[str]) -> dict[str, dict]:
    """All scores of each exposure on the given (held-out) rows."""
    return {x: MixedSums(df, entity, [x, *controls, y]).metrics(y, x, controls) for x in exposures}


def make_fitter(df: DataFrame, y: str, kind: str = "ols", entity: str | None = None):
    """A function of a list of columns that fits y on them: 'ols' (by `entity`, clustered), 'logit' or 'gee'. All give names, beta, se and cov."""
    from .gram import ols

    fits = {"ols": lambda x: ols(df, y, x, entity), "logit": lambda x: logit(df, y, x), "gee": lambda x: gee_logit(df, entity, y, x)}
    if kind not in fits or (kind == "gee" and entity is None):
        raise ValueError("kind is 'ols', 'logit' or 'gee'; 'gee' needs an entity")
    return fits[kind]
