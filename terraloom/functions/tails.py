"""Distribution tails and small-sample intervals in NumPy and the standard library (SciPy isn't needed)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500 + int(10 * math.sqrt(max(a, b)))):  # its length grows with the root of the larger
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d if abs(1 + top * d) > tiny else tiny)
            c = 1 + top / c if abs(1 + top / c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5) if df > 0 and math.isfinite(t) else float("nan") if df <= 0 or math.isnan(t) else 0.0


def _solve(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    return _solve(lambda t: 1 - t_two_sided(t, df) / 2 - p, 0.0, 1e4)


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    out = d
    for n in range(1, 1000):
        an = -n * (n - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out


def chi2_upper(x: float, df: float) -> float:
    return 1 - gamma_cdf(x / 2, df / 2) if df > 0 else float("nan")


def binomial_tail(hits: int, n: int, p: float) -> float:
    """Chance of at least so many hits in n draws, term by term in logarithms, as whole binomial coefficients soon exceed a float."""
    if hits <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return math.fsum(term(i) for i in range(hits, n + 1))



def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a binomial share."""
    if n == 0:
        return 0.0, 1.0
    a = (1 - level) / 2
    low = 0.0 if hits == 0 else _solve(lambda p: beta_cdf(p, hits, n - hits + 1) - a, 0.0, 1.0)
    high = 1.0 if hits == n else _solve(lambda p: beta_cdf(p, hits + 1, n - hits) - (1 - a), 0.0, 1.0)
    return low, high


def stop_decision(hits: int, n: int, after: int, low: float, high: float) -> str | None:
    """Once `after` draws are in: 'below' or 'above' if the exact interval lies on one side of the band, else None."""
    if n < after:
        return None
    a, b = clopper_pearson(hits, n)
    return "below" if b < low else "above" if a > high else None


def holm(p: Sequence[float | None]) -> list[float | None]:
    """Step-down adjusted p-values; missing ones stay missing and don't count."""
    known = sorted((v, i) for i, v in enumerate(p) if v is not None and not math.isnan(v))
    out: list[float | None] = [None] * len(p)
    worst = 0.0
    for k, (v, i) in enumerate(known):
        worst = max(worst, min(1.0, (len(known) - k) * v))
        out[i] = worst
    return out


def corrected_t(values: Sequence[float], test_share: float) -> tuple[float, float]:
    """t and p of repeated random splits, whose variance is widened for their overlap."""
    x = np.asarray([v for v in values if v is not None and np.isfinite(v)])
    if len(x) < 2 or np.var(x, ddof=1) == 0:
        return float("nan"), float("nan")
    t = float(x.mean() / math.sqrt(np.var(x, ddof=1) * (1 / len(x) + test_share / (1 - test_share))))
    return t, t_two_sided(t, len(x) - 1)


def bca(observed: float, draws: np.ndarray, jackknife: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval."""
    share = float(np.clip(np.mean(draws < observed), 1e-6, 1 - 1e-6))
    z0 = NORMAL.inv_cdf(share)
    d = jackknife.mean() - jackknife
    scale = 6 * (d**2).sum() ** 1.5
    a = float((d**3).sum() / scale) if scale > 0 else 0.0
    cut = [NORMAL.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (NORMAL.inv_cdf((1 - level) / 2), NORMAL.inv_cdf((1 + level) / 2))]
    low, high = np.quantile(draws, cut)
    return float(low), float(high)
