"""Posterior of a linear index from its Gram alone, and recovery of planted truths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.kernels import blend_quantiles
from terraloom.functions.tails import clopper_pearson

from .gram import Gram, gram
from .search import residual_gram


def cross_products(df: DataFrame, y: str, columns: list[str], controls: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sufficient statistics of the linear likelihood: residual products, scaled to unit spread. One aggregation whatever the rows."""
    g: Gram = gram(df, [*controls, *columns, y])
    a, c, yy = residual_gram(g, y, columns, controls)
    s = np.sqrt(np.maximum(np.diag(a) / g.n, 1e-300))
    return a / np.outer(s, s), c / s / math.sqrt(yy / g.n), float(g.n), g.n


def posterior(a: np.ndarray, c: np.ndarray, n: int, radii: list[float], stats: int, channels: int, draws: int = 800, chains: int = 4, seed: int = 0, center: float = math.log(400), spread: float = 0.7) -> dict:
    """Random-walk Metropolis over weights (uniform on the simplex), effect N(0, 1), noise half-normal(2), a log-normal kernel over radii
    and an aggregator (uniform on the simplex); columns are ordered by channel, radius, statistic."""
    r = np.log(np.asarray(radii, float))
    rng = np.random.default_rng(seed)
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()

    def unpack(v: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray, np.ndarray]:
        w, q = softmax(v[:channels]), softmax(v[channels : channels + stats])
        k = np.exp(-0.5 * ((r - v[-2]) / math.exp(v[-1])) ** 2) / math.exp(v[-1])
        k = k / max(k.sum(), 1e-300)
        return w, v[-4], math.exp(v[-3]), k, q

    def log_density(v: np.ndarray) -> float:
        w, beta, sigma, k, q = unpack(v)
        t = np.einsum("c,r,s->crs", w, k, q).ravel()
        quad = n - 2 * beta * float(t @ c) + beta * beta * float(t @ a @ t)
        prior = np.log(w).sum() + np.log(q).sum() - 0.5 * beta**2 - 0.125 * sigma**2 + v[-3] - 0.5 * ((v[-2] - center) / spread) ** 2 - 0.5 * v[-1] ** 2
        return -n * v[-3] - quad / (2 * sigma * sigma) + prior

    kept = []
    for _ in range(chains):
        v = np.concatenate([rng.normal(0, 0.3, channels + stats), [0.1, 0.0, center, -0.5]])
        now, step, hits = log_density(v), np.full(len(v), 0.15), 0
        step[-4:-2] = 1.5 / math.sqrt(n)
        for i in range(4 * draws):
            new = v + rng.normal(size=len(v)) * step * rng.choice([0.3, 1.0, 2.0])
            cand = log_density(new)
            if math.log(rng.random()) < cand - now:
                v, now, hits = new, cand, hits + 1
            if i < 2 * draws and i % 100 == 99:  # only while warming up
                step *= 1.2 if hits > 35 else 0.8 if hits < 20 else 1.0
                hits = 0
            if i >= 2 * draws and i % 2:
                w, beta, sigma, k, q = unpack(v)
                kept.append(np.concatenate([w, [beta, sigma], k, q]))
    d = np.array(kept)
    names = [*(f"w{i}" for i in range(channels)), "beta", "sigma", *(f"k{int(x)}" for x in radii), *(f"q{i}" for i in range(stats))]
    kernels = d[:, channels + 2 : channels + 2 + len(radii)]
    r50, r90 = np.array([blend_quantiles(np.asarray(radii, float), k) for k in kernels[:: max(1, len(kernels) // 400)]]).T
    row = lambda x: {"mean": float(x.mean()), "low": float(np.quantile(x, 0.025)), "high": float(np.quantile(x, 0.975))}
    return {name: row(d[:, i]) for i, name in enumerate(names)} | {"r50": row(r50), "r90": row(r90)}


def planted(df: DataFrame, columns: list[str], weights: list[float], effect: float, key: str, name: str = "planted", seed: int = 0) -> DataFrame:
    """An outcome with a known index: effect times the standardised index, plus a normal draw of the key's hash (Box-Muller)."""
    m = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    index: Column = sum((F.lit(float(w)) * (F.col(c) - m[f"m{i}"]) / max(m[f"s{i}"] or 0.0, 1e-12) for i, (c, w) in enumerate(zip(columns, weights))), F.lit(0.0))
    u = lambda k: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return df.withColumn(name, F.lit(float(effect)) * index + F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2)))


def plasmode(df: DataFrame, columns: list[str], truths: list[tuple[list[float], float]], controls: list[str], key: str, repeats: int = 5) -> list[dict]:
    """For each planted truth, how often the refit's largest weight is the planted one, the bias of its association, with exact intervals."""
    from .search import simplex_fit

    out = []
    for weights, effect in truths:
        hits, bias = 0, []
        for k in range(repeats):
            made = planted(df, columns, weights, effect, key, seed=k)
            a, c, n, _ = cross_products(made, "planted", columns, controls)
            w, value = simplex_fit(a, c)
            hits += int(np.argmax(w)) == int(np.argmax(weights))
            bias.append(float(np.abs(w - np.array(weights) / sum(weights)).sum() / 2))
        low, high = clopper_pearson(hits, repeats)
        out.append({"effect": effect, "recovered": hits / repeats, "low": low, "high": high, "weight_error": float(np.mean(bias))})
    return out


def grid_posterior(df: DataFrame, y: str, channels: dict[str, list[str]], controls: list[str], prior_sd: float = 1.0, most: int = 4096) -> list[dict]:
    """Joint posterior over the grid of one column for each channel: the weights are the best ones on the simplex, the effect has a normal prior, the
    noise is taken out (a marginal likelihood in closed form), and each combination counts by it. All from one Gram; `most` combinations at most."""
    from itertools import product

    from .search import simplex_fit

    combos = list(product(*channels.values()))
    if len(combos) > most:
        raise ValueError(f"a grid posterior takes {most} combinations at most")
    columns = [*dict.fromkeys(c for cs in channels.values() for c in cs)]
    g = gram(df, [*controls, *columns, y])
    a, c, yy = residual_gram(g, y, columns, controls)
    scale, n, out = np.sqrt(np.maximum(np.diag(a), 1e-300)), g.n, []
    for combo in combos:
        at = [columns.index(k) for k in combo]
        sub, own = a[np.ix_(at, at)] / np.outer(scale[at], scale[at]), c[at] / scale[at]
        w, _ = simplex_fit(sub, own)
        xx, xy = float(w @ sub @ w), float(w @ own) / math.sqrt(yy) if yy > 0 else 0.0
        # z-scored sides: n beta xy is the likelihood's linear part, n xx its precision
        precision = n * xx + 1 / prior_sd**2
        rss = max(n - (n * xy) ** 2 / precision, 1e-12)
        like = -0.5 * math.log(precision * prior_sd**2) - 0.5 * (n - 1) * math.log(rss / n)
        out.append({"columns": combo, "weights": w, "beta": n * xy / precision, "sd": math.sqrt(rss / n / precision), "log": like})
    top = max(o["log"] for o in out)
    total = sum(math.exp(o["log"] - top) for o in out)
    for o in out:
        o["probability"] = math.exp(o.pop("log") - top) / total
    return sorted(out, key=lambda o: (-o["probability"], o["columns"]))


def synergy_design(cells: DataFrame, key: str, channels: list[str], covariates: DataFrame | None = None, weight: str = "weight") -> DataFrame:
    """(key, each term of the channels, covariates): interactions are geometric means by cell first, then weighted means of the entity's cells, so
    they can't be made of the entity's means."""
    from terraloom.functions.composites import key as term_key
    from terraloom.functions.composites import term_value, terms

    values = {c: F.col(c) for c in channels}
    made = {term_key(t): term_value(t, values) for t in terms(tuple(channels))}
    mean = lambda v: F.sum(v * F.col(weight)) / F.nullif(F.sum(F.when(v.isNotNull(), F.col(weight))), F.lit(0.0))
    out = cells.groupBy(key).agg(*(mean(v).alias(n) for n, v in made.items()))
    return out if covariates is None else out.join(covariates, key)


def recovery_summary(records: DataFrame) -> DataFrame:
    """(scenario, effect, metric, value, low, high, n) of replicate records (scenario, effect, beta_true, beta_mean, beta_low, beta_high, excluded):
    power or, without a true effect, false positives with the exact interval; bias and coverage of the effect."""
    by = records.groupBy("scenario", "effect").agg(F.count("*").alias("n"), F.count_if("excluded").alias("hits"), F.max(F.abs("beta_true")).alias("true"), F.avg(F.col("beta_mean") - F.col("beta_true")).alias("bias"), F.avg(((F.col("beta_low") <= F.col("beta_true")) & (F.col("beta_true") <= F.col("beta_high"))).cast("double")).alias("coverage"))

    @F.pandas_udf("low double, high double")
    def exact(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(h), int(m)) for h, m in zip(hits, n)], columns=["low", "high"])

    none = F.lit(None).cast("double")
    made = by.withColumn("i", exact("hits", "n"))
    metrics = F.array(
        F.struct(F.when(F.col("true") == 0, "false_positive_rate").otherwise("power").alias("metric"), (F.col("hits") / F.col("n")).alias("value"), F.col("i.low").alias("low"), F.col("i.high").alias("high")),
        F.struct(F.lit("beta_bias").alias("metric"), F.col("bias").alias("value"), none.alias("low"), none.alias("high")),
        F.struct(F.lit("beta_coverage").alias("metric"), F.col("coverage").alias("value"), none.alias("low"), none.alias("high")),
    )
    rows = made.select("scenario", "effect", "n", "true", F.explode(metrics).alias("m")).where((F.col("true") != 0) | (F.col("m.metric") == "false_positive_rate"))
    return rows.select("scenario", "effect", "m.metric", "m.value", "m.low", "m.high", "n")
