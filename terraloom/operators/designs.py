"""Designs of regressions: spline expansions, smooth controls, indicator blocks, time interactions, and scores beside a smooth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import Gram, gram, incremental_r2, spline_columns
from .panel import levels
from .splits import quantiles

#: Distinct values from which a covariate is taken as continuous.
SPLINE_FROM = 7


def expand_splines(df: DataFrame, columns: list[str], df_spline: int = 4, least: int = SPLINE_FROM) -> tuple[DataFrame, list[str]]:
    """Natural cubic columns beside each covariate of `least` or more distinct values; the others stay as they are. Knots are exact percentiles."""
    if not columns:
        return df, []
    counts = df.agg(*(F.count_distinct(c).alias(str(i)) for i, c in enumerate(columns))).first()
    out, names = df, []
    for i, c in enumerate(columns):
        names.append(c)
        if counts[i] < least:
            continue
        knots = sorted(set(quantiles(df, c, [0.05 + 0.9 * k / (df_spline - 1) for k in range(df_spline)])))
        if len(knots) < 3:
            continue
        out, made = spline_columns(out, c, knots)
        renamed = {m: f"{c}{m}" for m in made}
        out = out.withColumnsRenamed(renamed)
        names += renamed.values()
    return out, names


def spatial_designs(controls: list[str], smooth: list[str], method: str) -> tuple[list[str], list[str]]:
    """(controls of the outcome, controls of the exposure): the smooth on both sides, on the exposure's alone (`exposure`), or nowhere."""
    if method not in ("both", "exposure", "none"):
        raise ValueError("method is 'both', 'exposure' or 'none'")
    return controls + (smooth if method == "both" else []), controls + (smooth if method != "none" else [])


def r2_over_smooth(g: Gram, y: str, x: str, controls: list[str], smooth: list[str]) -> float:
    """Incremental R2 of x beside controls and smooth, both sides residualised (the exposure's residual alone decides it)."""
    return incremental_r2(g, y, x, [*controls, *smooth])


def score_over_smooth(df: DataFrame, y: str, x: str, controls: list[str], smooth: list[str], method: str = "both") -> float:
    """R2 of y that the exposure's residual adds to the outcome's controls, for each way to control for a smooth."""
    left, right = spatial_designs(controls, smooth, method)
    g = gram(df, [*dict.fromkeys([*left, *right, x, y])])
    if method == "both":
        return r2_over_smooth(g, y, x, controls, smooth)
    # the exposure's residual on its own design, as a combination of columns
    names = ["1", *right]
    import numpy as np

    on = np.linalg.pinv(g.part(names, names), hermitian=True) @ g.part(names, [x])[:, 0]
    every = ["1", *dict.fromkeys([*left, *right, x, y])]
    t = np.zeros((len(every), len(left) + 3))
    for i, c in enumerate(["1", *left, y]):
        t[every.index(c), i] = 1
    t[every.index(x), -1] = 1
    for c, b in zip(names, on):
        t[every.index(c), -1] -= b
    m = t.T @ g.part(every, every) @ t
    made = Gram([*left, y, "_r"], m, g.n)
    return incremental_r2(made, y, "_r", left)


def group_dummies(df: DataFrame, column: str, prefix: str = "") -> tuple[DataFrame, list[str]]:
    """Indicators of all levels but the first, in string order."""
    found = levels(df, column)[1:]
    made = {f"{prefix or column}_{v}": F.coalesce(F.col(column).cast("string") == v, F.lit(False)).cast("double") for v in found}
    return (df.withColumns(made) if made else df), list(made)


TARGETS = ("level", "decline_overall", "decline_between", "decline_within")


def target_design(df: DataFrame, entity: str, x: str, years: str, controls: list[str], target: str = "level", time: bool = True) -> tuple[DataFrame, list[str], str]:
    """Columns of a panel model and the one whose effect is asked for: the exposure's level, or its product with time as a whole, between entities
    or within them."""
    if target not in TARGETS:
        raise ValueError(f"target is one of {', '.join(TARGETS)}")
    from .panel import within_between

    rest = [*([years] if time or target != "level" else []), *controls]
    if target == "level":
        return df, [x, *rest], x
    made = within_between(df, entity, x)
    parts: dict[str, Column] = {"decline_overall": F.col(x) * F.col(years), "decline_between": F.col("between") * F.col(years), "decline_within": F.col("within") * F.col(years)}
    if target == "decline_overall":
        return made.withColumn(target, parts[target]), [x, *rest, target], target
    both = ("decline_between", "decline_within")
    return made.withColumns({k: parts[k] for k in both}), ["between", "within", *rest, *both], target


def relationship_sign(df: DataFrame, y: str, x: str, controls: list[str] = []) -> int:  # noqa: B006
    """Sign of the correlation of the residuals of ranks on ranked controls: 1, -1, or 0 without spread."""
    from .panel import complete
    from .scoring import average_rank

    ranked = complete(df, [y, x, *controls]).select(y, x, *controls)
    for i, c in enumerate([y, x, *controls]):
        ranked = average_rank(ranked, c, f"_r{i}")
    g = gram(ranked, [f"_r{i}" for i in range(2 + len(controls))])
    if g.n < 3:
        return 0
    yy, xy, xx = g.residual("_r0", "_r1", [f"_r{i}" for i in range(2, 2 + len(controls))])
    return 0 if yy <= 1e-12 or xx <= 1e-12 or abs(xy) <= 1e-12 * (yy * xx) ** 0.5 else 1 if xy > 0 else -1


def standardised_sides(df: DataFrame, y: str, columns: list[str], controls: list[str]) -> DataFrame:
    """Complete rows with y and the columns as residuals on the controls, at mean 0 and population SD 1 (0 where a column has no spread): all from
    one Gram, as expressions."""
    from .panel import complete

    every = [*controls, *columns, y]
    rows = complete(df, every)
    g = gram(rows, every)
    made = {}
    for c in (*columns, y):
        beta, rss, _ = g.solve(c, controls)
        fit = sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta[1:], controls)), F.lit(float(beta[0])))
        sd = (rss / max(g.n, 1)) ** 0.5
        made[c] = (F.col(c) - fit) / F.lit(sd) if sd > 1e-12 else F.lit(0.0)
    return rows.withColumns(made)


def collinearity(df: DataFrame, channels: list[str], key: str, threshold: float = 10.0, sample: int = 20_000, merged: dict[str, list[str]] | None = None) -> dict:
    """Variance inflation of channels over raw cells: of `sample` cells at most, those with the least draws of their keys (a stated bound of this
    report). `merged` has channels that are sums of others."""
    from .gram import vif
    from .splits import draw

    made = df.withColumns({k: sum((F.col(c) for c in v[1:]), F.col(v[0])) for k, v in (merged or {}).items()}) if merged else df
    rows = made.orderBy(draw(F.col(key)), key).limit(sample)
    values = vif(gram(rows, channels), channels)
    return {"vif": values, "flagged": sorted(c for c, v in values.items() if v > threshold)}
