"""Composite formulas: a registry of Column builders over named channels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNEL_SETS = {"three": ("veg", "terrain", "ndvi"), "two": ("gvi", "ndvi")}
ALIASES = {"veg": ("gvi_veg", "veg"), "terrain": ("gvi_ter", "terrain"), "gvi": ("gvi",), "ndvi": ("ndvi",)}


def terms(channels: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Main terms, then pairs, then the triple."""
    return [c for n in range(1, len(channels) + 1) for c in combinations(channels, n)]


def key(term: tuple[str, ...]) -> str:
    return "_".join(term)


def term_value(term: tuple[str, ...], values: dict[str, Column]) -> Column:
    """A channel, or the geometric mean of several with negatives at 0."""
    if len(term) == 1:
        return values[term[0]]
    product = prod((F.greatest(values[c], F.lit(0.0)) for c in term[1:]), start=F.greatest(values[term[0]], F.lit(0.0)))
    return F.when(product > 0, F.pow(product, F.lit(1.0 / len(term)))).otherwise(F.when(product.isNull(), F.lit(None)).otherwise(F.lit(0.0)))


def weighted_mean(pairs: list[tuple[float, Column]]) -> Column:
    """Sum of weight times value by the sum of weights; null if that isn't positive."""
    total = float(sum(w for w, _ in pairs))
    if total <= 0:
        return F.lit(None).cast("double")
    return sum((F.lit(float(w)) * v for w, v in pairs if w), F.lit(0.0)) / F.lit(total)


def percentile_form(values: dict[str, Column], channels: tuple[str, ...], weights: dict[str, float], power: float = 1.0) -> Column:
    """The older synergy form on percentiles from 0 to 1: powers of the channels and plain products."""
    clipped = {c: F.least(F.greatest(values[c], F.lit(0.0)), F.lit(1.0)) for c in channels}
    parts = [(weights.get(key(t), 0.0), prod((clipped[c] for c in t[1:]), start=F.pow(clipped[t[0]], F.lit(power)) if len(t) == 1 else clipped[t[0]])) for t in terms(channels)]
    return weighted_mean(parts)


@dataclass(frozen=True)
class Formula:
    name: str
    channels: tuple[str, ...]
    form: str
    build: Callable[[dict[str, Column], dict[str, float]], Column]

    def keys(self) -> list[str]:
        return [key(t) for t in (terms(self.channels) if self.form != "weighted" else [(c,) for c in self.channels])]

    def active(self, weights: dict[str, float]) -> tuple[str, ...]:
        """The channels that a set of weights uses: the only columns a query needs."""
        return tuple(c for c in self.channels if any(weights.get(k, 0.0) > 0 and c in k.split("_") for k in self.keys()))


def _formulas() -> dict[str, Formula]:
    out = {}
    for label, channels in CHANNEL_SETS.items():
        simple = lambda v, w, cs=channels: weighted_mean([(w.get(c, 0.0), v[c]) for c in cs])
        synergy = lambda v, w, cs=channels: weighted_mean([(w.get(key(t), 0.0), term_value(t, v)) for t in terms(cs)])
        older = lambda v, w, cs=channels: percentile_form(v, cs, w, w.get("power", 1.0))
        for form, build in (("weighted", simple), ("synergy", synergy), ("percentile", older)):
            out[f"{form}_{label}"] = Formula(f"{form}_{label}", channels, form, build)
    return out


FORMULAS = _formulas()


def composite(name: str, values: dict[str, Column], weights: dict[str, float]) -> Column:
    if name not in FORMULAS:
        raise KeyError(f"no formula {name!r}; there are {', '.join(sorted(FORMULAS))}")
    return FORMULAS[name].build(values, weights)


def formula_for(channels: tuple[str, ...], form: str) -> str:
    for f in FORMULAS.values():
        if set(f.channels) == set(channels) and f.form == form:
            return f.name
    raise KeyError(f"no {form} formula of {channels}")


def standardised(value: Column, center: float, scale: float) -> Column:
    return (value - F.lit(float(center))) / F.lit(max(float(scale), 1e-12))


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by a rational approximation of the error function (error below 1.5e-7), in the JVM."""
    x = F.abs(z) / F.lit(2**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def percentile_of(value: Column, center: float, scale: float) -> Column:
    return normal_cdf(standardised(value, center, scale))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled from 0 to 1; 0 where there is no spread."""
    return F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(0.0))


def resolve(columns: list[str], channel: str) -> str:
    """The column of a channel by its accepted names, in any case."""
    lower = {c.lower(): c for c in columns}
    for name in ALIASES[channel]:
        if name in lower:
            return lower[name]
    raise ValueError(f"no column for {channel}: one of {', '.join(ALIASES[channel])} is needed")


def check_disjoint(aliases: dict[str, tuple[str, ...]] = ALIASES) -> None:
    """Accepted names of different channels mustn't meet, whatever their case."""
    seen: dict[str, str] = {}
    for channel, names in aliases.items():
        for n in {v.lower() for v in names}:
            if n in seen:
                raise ValueError(f"{channel} and {seen[n]} share the name {n}")
            seen[n] = channel
