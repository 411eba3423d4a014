"""Resampling inference as a dimension of the query: replicates are weights of rows or clusters, a grouped Gram for each is one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.tails import NORMAL, bca, t_two_sided

from .gram import Gram, complete, from_row, gram, incremental_r2, product_columns
from .splits import draw

#: Cumulative probabilities of a Poisson count of mean 1: a row's weight in a replicate.
POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)])


def poisson_weight(key: Column, replicate: Column, seed: int = 0) -> Column:
    """Times that a key is drawn in a replicate: Poisson of mean 1 from an arithmetic hash (a square modulo a prime, so that replicates aren't
    shifts of each other)."""
    a = F.pmod(key.cast("long") % 1000003 * 69069 + replicate * 7907 + seed * 7919, F.lit(1000003))
    h = F.pmod(a * a + replicate * 104729, F.lit(1000003))
    u = F.pmod(h * 1103515245 + 12345, F.lit(2147483648)) / F.lit(2147483648.0)
    return sum(((u >= float(p)).cast("int") for p in POISSON), F.lit(0))


def replicate_grams(df: DataFrame, columns: list[str], key: str, replicates: int, seed: int = 0) -> list[Gram]:
    """Weighted Grams of replicates. First the Gram of each cluster (`key`), then these times the weights: rows are read once, not once a
    replicate."""
    per = complete(df, columns).groupBy(key).agg(F.count("*").alias("_n"), *product_columns(columns))
    names = [c for c in per.columns if c.startswith("_")]
    spread = per.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", poisson_weight(F.col(key), F.col("replicate"), seed)).where("w > 0")
    rows = spread.groupBy("replicate").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in names)).collect()
    return [from_row(r, columns) for r in sorted(rows, key=lambda r: r.replicate)]


def bootstrap_ci(df: DataFrame, y: str, x: str, controls: list[str], key: str, replicates: int = 400, level: float = 0.95, method: str = "percentile", seed: int = 0, statistic=incremental_r2) -> dict:
    """Observed statistic with its interval; BCa takes its acceleration from leaving out each cluster in turn (bounded by 5,000 clusters)."""
    columns = [*controls, x, y]
    whole = gram(df, columns)
    observed = statistic(whole, y, x, controls)
    draws = np.array([statistic(g, y, x, controls) for g in replicate_grams(df, columns, key, replicates, seed)])
    if method == "bca":
        per = complete(df, columns).groupBy(key).agg(F.count("*").alias("_n"), *product_columns(columns)).limit(5001).collect()
        if len(per) > 5000:
            raise ValueError("BCa takes 5,000 clusters at most")
        left = []
        for r in per:
            part = from_row(r, columns)
            left.append(statistic(Gram(columns, whole.matrix - part.matrix, whole.n - part.n), y, x, controls))
        low, high = bca(observed, draws, np.array(left), level)
    else:
        low, high = np.quantile(draws, [(1 - level) / 2, (1 + level) / 2])
    return {"observed": observed, "low": float(low), "high": float(high), "replicates": len(draws)}


def permutation_p(df: DataFrame, y: str, x: str, controls: list[str], key: str, permutations: int = 99, seed: int = 0) -> dict:
    """Share of permuted residuals of the outcome that score as high (Freedman-Lane), with one added above and below: one job for all permutations."""
    from .resampling import permutation_r2

    out = permutation_r2(df, y, x, controls, key, permutations, seed)
    return {k: out[k] for k in ("observed", "p", "permutations")}


def share_p(statistic: Column, observed: Column) -> Column:
    """Aggregate: one-sided permutation p of a column of permuted statistics."""
    return (F.count_if(statistic >= observed) + 1) / (F.count(statistic) + 1)


def holm_adjust(df: DataFrame, p: str, family: list[str], order: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjusted p in each family; missing ones stay and don't count."""
    w = Window.partitionBy(*family, F.col(p).isNull()).orderBy(p, order)
    rank = F.row_number().over(w)
    m = F.count(p).over(Window.partitionBy(*family))
    raw = df.withColumn("_h", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - rank + 1) * F.col(p))))
    run = F.max("_h").over(Window.partitionBy(*family, F.col(p).isNull()).orderBy(p, order).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(name, F.when(F.col(p).isNotNull(), run)).drop("_h")


def holds(p: Column, low: Column, high: Column) -> Column:
    """p below 0.05, or else the interval leaves out 0, or else unknown."""
    return F.when(p.isNotNull(), p < 0.05).when(low.isNotNull() & high.isNotNull(), (low > 0) | (high < 0))


def split_summary(df: DataFrame, by: list[str], value: str, test_share: float, held: str | None = None) -> DataFrame:
    """Median, spread, share that holds and the corrected t of each quantity over repeated splits."""
    v = F.col(value)
    t = F.avg(v) / F.sqrt(F.var_samp(v) * (1 / F.count(v) + test_share / (1 - test_share)))
    extra = [F.avg(F.col(held).cast("double")).alias("share_holds")] if held else []
    out = df.groupBy(*by).agg(F.count(v).alias("n_splits"), F.percentile(v, F.array(*map(F.lit, (0.5, 0.025, 0.975)))).alias("_p"), F.min(v).alias("min"), F.max(v).alias("max"), *extra, F.when(F.var_samp(v) > 0, t).alias("corrected_t"))
    named = [F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("median", "q025", "q975"))]
    return out.select(*by, "n_splits", *named, "min", "max", *(["share_holds"] if held else []), "corrected_t")


def with_t_p(df: DataFrame, t: str, n: str, name: str = "corrected_p") -> DataFrame:
    """Two-sided p of t with n - 1 degrees of freedom; one row for each quantity, so an Arrow function of few rows."""
    @F.pandas_udf("double")
    def tail(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 2 else t_two_sided(float(a), float(b) - 1) for a, b in zip(ts, ns)])

    return df.withColumn(name, tail(t, n))


def paired_contrast(df: DataFrame, target: str, control: str, x: str, controls: list[str], key: str, replicates: int = 400, seed: int = 0) -> dict:
    """|slope on the target| - |slope on the control|, residuals scaled by their spread in all rows, with a bootstrap over clusters."""
    columns = [*controls, x, target, control]
    whole = gram(df, columns)
    xx = whole.residual(target, x, controls)[2]
    scale = {o: (whole.residual(o, x, controls)[0] / xx) ** 0.5 for o in (target, control)}
    size = lambda g, o: abs(g.residual(o, x, controls)[1] / g.residual(o, x, controls)[2] / scale[o])
    delta = lambda g: size(g, target) - size(g, control)
    draws = np.array([delta(g) for g in replicate_grams(df, columns, key, replicates, seed)])
    return {"delta": delta(whole), "low": float(np.quantile(draws, 0.025)), "high": float(np.quantile(draws, 0.975)), "p": (int((draws <= 0).sum()) + 1) / (len(draws) + 1)}


def specificity(df: DataFrame, target: str, control: str, exposures: tuple[str, str], controls: list[str], key: str, replicates: int = 400, seed: int = 0) -> dict:
    """Difference of two exposures' contrasts over the same resamples."""
    columns = [*controls, *exposures, target, control]
    whole = gram(df, columns)

    def contrast(g: Gram, x: str) -> float:
        out = 0.0
        for o, sign in ((target, 1), (control, -1)):
            yy, _, xx = whole.residual(o, x, controls)
            _, xy, own = g.residual(o, x, controls)
            out += sign * abs(xy / own / (yy / xx) ** 0.5)
        return out

    draws = np.array([contrast(g, exposures[0]) - contrast(g, exposures[1]) for g in replicate_grams(df, columns, key, replicates, seed)])
    return {"delta": contrast(whole, exposures[0]) - contrast(whole, exposures[1]), "low": float(np.quantile(draws, 0.025)), "high": float(np.quantile(draws, 0.975)), "p": (int((draws <= 0).sum()) + 1) / (len(draws) + 1)}


def transfer_test(df: DataFrame, target: str, others: list[str], x: str, controls: list[str]) -> list[dict]:
    """A frozen exposure against its target and each control outcome; controls with p below 0.05 are flagged."""
    from .gram import partial_slope

    g = gram(df, [*controls, x, target, *others])
    return [{"outcome": o, **(r := partial_slope(g, o, x, controls)), "flagged": o != target and r["p"] is not None and r["p"] < 0.05} for o in (target, *others)]


def split_inference(pooled: dict, held: dict, level: float = 0.95) -> dict:
    """The estimate of all rows with the error, interval and p of the held-out ones, and the least effect that these could show."""
    q = NORMAL.inv_cdf(0.5 + level / 2)
    se = held["se"]
    return {"estimate": pooled["slope"], "held_out": held["slope"], "se": se, "low": held["slope"] - q * se, "high": held["slope"] + q * se, "p": held["p"], "least_detectable": 2.8 * se}


def seeded(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("u", draw(F.col(key), seed))


def weighted_r2(df: DataFrame, y: str, x: str, controls: list[str], weight: str) -> float:
    """Incremental R2 of the weighted rows."""
    return incremental_r2(gram(df, [*controls, x, y], weight), y, x, controls)


def r2_difference(df: DataFrame, y: str, exposures: tuple[str, str], controls: list[str], key: str, replicates: int = 400, seed: int = 0) -> dict:
    """Difference of two exposures' incremental R2, with an interval over the same resamples of clusters."""
    columns = [*controls, *exposures, y]
    delta = lambda g: incremental_r2(g, y, exposures[0], controls) - incremental_r2(g, y, exposures[1], controls)
    draws = np.array([delta(g) for g in replicate_grams(df, columns, key, replicates, seed)])
    return {"delta": delta(gram(df, columns)), "low": float(np.quantile(draws, 0.025)), "high": float(np.quantile(draws, 0.975))}
