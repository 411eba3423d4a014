"""Search for an index: best non-negative weights on the Gram, sweep of radius and statistic, reproducibility, gain, calibration."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.tails import corrected_t

from .gram import Gram, grams_by
from .splits import draw


def simplex_fit(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that are at least 0 and add up to 1, with the greatest absolute association w'c / sqrt(w'Gw), over all active sets and both
    signs of c."""
    k, best = len(c), (np.eye(len(c))[0], -1.0)
    for n in range(1, k + 1):
        for active in combinations(range(k), n):
            a = list(active)
            sub = g[np.ix_(a, a)]
            if np.linalg.cond(sub) > 1e12:
                continue
            for sign in (1, -1):
                w = np.linalg.solve(sub, sign * c[a])
                if w.sum() <= 0 or (w / w.sum() < -1e-9).any():
                    continue
                full = np.zeros(k)
                full[a] = np.maximum(w, 0) / np.maximum(w, 0).sum()
                den = full @ g @ full
                value = abs(full @ c) / np.sqrt(den) if den > 0 else 0.0
                if value > best[1] + 1e-12:
                    best = full, float(value)
    return best


def t_of_r(r: float, n: int, lost: int = 2) -> float:
    r = min(abs(r), 1 - 1e-12)
    return r * np.sqrt((n - lost) / (1 - r * r)) if n > lost else 0.0


@dataclass
class Candidate:
    columns: tuple[str, ...]
    weights: np.ndarray
    train: float
    held: float


def residual_gram(g: Gram, y: str, x: list[str], controls: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
    """Products of the residuals of x among themselves and with y, and of y, on the controls."""
    names = ["1", *controls]
    inverse = np.linalg.pinv(g.part(names, names), hermitian=True)
    s = g.part([*x, y], [*x, y]) - g.part([*x, y], names) @ inverse @ g.part(names, [*x, y])
    return s[:-1, :-1], s[:-1, -1], float(s[-1, -1])


def fit_columns(train: Gram, held: Gram, y: str, x: tuple[str, ...], controls: list[str]) -> Candidate:
    """Weights on one part, the absolute t of the index on the other."""
    def parts(gr: Gram) -> tuple[np.ndarray, np.ndarray, float]:
        g, c, yy = residual_gram(gr, y, list(x), controls)
        return g, c, yy

    g, c, yy = parts(train)
    scale = np.sqrt(np.maximum(np.diag(g), 1e-300))
    w, value = simplex_fit(g / np.outer(scale, scale), c / scale)
    gh, ch, yh = parts(held)
    raw = w / scale
    den = raw @ gh @ raw * yh
    r_held = abs(raw @ ch) / np.sqrt(den) if den > 0 else 0.0
    lost = 2 + len(controls)
    return Candidate(x, w, t_of_r(value / np.sqrt(yy) if yy > 0 else 0.0, train.n, lost), t_of_r(r_held, held.n, lost))


def split_grams(df: DataFrame, columns: list[str], group: str, splits: int, share: float, seed: int = 0) -> list[tuple[Gram, Gram]]:
    """Grams of the training and the held-out part of each split: the splits are a dimension, so this is one job."""
    k = F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split")
    rows = df.select(*dict.fromkeys([group, *columns]), k)
    part = F.col("split") * 2 + (draw(F.col(group) + F.col("split") * 104729, seed) < share).cast("int")
    grams = grams_by(rows.withColumn("_part", part), "_part", columns)
    return [(grams[2 * s], grams[2 * s + 1]) for s in range(splits) if 2 * s in grams and 2 * s + 1 in grams]


def simplex_batch(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`simplex_fit` of many problems at once: g is (n, k, k), c is (n, k). Weights (n, k) and associations (n)."""
    n, k = c.shape
    best, weights = np.full(n, -1.0), np.tile(np.eye(k)[0], (n, 1))
    for m in range(1, k + 1):
        for active in combinations(range(k), m):
            a = np.array(active)
            sub = g[:, a[:, None], a[None, :]]
            own = np.einsum("nii->ni", sub).prod(axis=1)
            fit = (own > 0) & (np.linalg.det(sub) > 1e-12 * own)  # columns of unit spread that aren't one another's
            w = np.zeros((n, m))
            if fit.any():
                w[fit] = np.linalg.solve(sub[fit], c[fit][:, a][:, :, None])[:, :, 0]
            for sign in (1, -1):
                v = sign * w
                total = v.sum(axis=1)
                ok = fit & (total > 0)
                share = np.divide(v, total[:, None], out=np.zeros_like(v), where=ok[:, None])
                ok &= (share >= -1e-9).all(axis=1)
                if not ok.any():
                    continue
                full = np.zeros((n, k))
                share = np.maximum(share, 0)
                full[:, a] = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                den = np.einsum("ni,nij,nj->n", full, g, full)
                value = np.divide(np.abs((full * c).sum(axis=1)), np.sqrt(np.maximum(den, 0)), out=np.zeros(n), where=den > 0)
                better = ok & (value > best + 1e-12)
                best[better], weights[better] = value[better], full[better]
    return weights, best


def decode(index: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Positions (n, channels) of a candidate's number among the product of the channels' columns, the last channel fastest."""
    return np.stack(np.unravel_index(index, sizes), axis=1)


def decode_column(column: int, radii: list[float], stats: list[str]) -> tuple[float, str]:
    """Radius and statistic of a channel's column, statistics fastest."""
    return radii[column // len(stats)], stats[column % len(stats)]


def candidate_scores(index: np.ndarray, places: list[list[int]], parts: list[tuple[np.ndarray, np.ndarray]], counts: list[tuple[int, int]], lost: int) -> tuple[np.ndarray, np.ndarray]:
    """Held-out t (n, splits) and mean weights (n, channels) of candidates; parts are the residual products, the outcome last, of each split."""
    at = decode(index, [len(p) for p in places])
    chosen = np.stack([np.asarray(p)[at[:, i]] for i, p in enumerate(places)], axis=1)
    held, weights = np.zeros((len(index), len(parts))), np.zeros(chosen.shape)
    rows, cols = chosen[:, :, None], chosen[:, None, :]
    for s, ((train, test), (_, n)) in enumerate(zip(parts, counts)):
        scale = np.sqrt(np.maximum(np.diag(train)[chosen], 1e-300))
        w, _ = simplex_batch(train[rows, cols] / (scale[:, :, None] * scale[:, None, :]), train[chosen, -1] / scale)
        raw = w / scale
        den = np.einsum("ni,nij,nj->n", raw, test[rows, cols], raw) * test[-1, -1]
        r = np.minimum(np.divide(np.abs((raw * test[chosen, -1]).sum(axis=1)), np.sqrt(np.maximum(den, 0)), out=np.zeros(len(index)), where=den > 0), 1 - 1e-12)
        held[:, s] = r * np.sqrt((n - lost) / (1 - r * r)) if n > lost else 0.0
        weights += w / len(parts)
    return held, weights


def sweep_table(df: DataFrame, y: str, channels: dict[str, list[str]], controls: list[str], group: str, splits: int = 10, share: float = 0.25, seed: int = 0, block: int = 8192) -> DataFrame:
    """candidate, mean, se, weights of every combination of one column of each channel. The rows are read once, for one Gram a split; candidates
    are a range that tasks go through in blocks, so none of them is a step of the driver's."""
    columns = [*dict.fromkeys([c for cs in channels.values() for c in cs])]
    parts = split_grams(df, [*dict.fromkeys([*columns, *controls, y])], group, splits, share, seed)

    def products(g: Gram) -> np.ndarray:
        a, c, yy = residual_gram(g, y, columns, controls)
        return np.block([[a, c[:, None]], [c[None, :], np.array([[yy]])]])

    made, counts = [(products(a), products(b)) for a, b in parts], [(a.n, b.n) for a, b in parts]
    places, total = [[columns.index(c) for c in cs] for cs in channels.values()], prod(len(cs) for cs in channels.values())
    lost = 2 + len(controls)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column(0).to_numpy()
            for i in range(0, len(index), block):
                part = index[i : i + block]
                held, weights = candidate_scores(part, places, made, counts, lost)
                se = held.std(axis=1, ddof=1) / np.sqrt(held.shape[1]) if held.shape[1] > 1 else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held.mean(axis=1)), pa.array(se), pa.array(list(weights), pa.list_(pa.float64()))], ["candidate", "mean", "se", "weights"])

    session = df.sparkSession
    tasks = max(1, min(-(-total // block), session.sparkContext.defaultParallelism))
    return session.range(0, total, 1, tasks).mapInArrow(run, "candidate long, mean double, se double, weights array<double>")


def sweep(df: DataFrame, y: str, channels: dict[str, list[str]], controls: list[str], group: str, splits: int = 10, share: float = 0.25, seed: int = 0, top: int = 10) -> dict:
    """Every combination of one column (radius and statistic) for each channel, by its mean held-out t. Reports the best, the shortlist, and the
    one within a standard error of the best with the least total radius."""
    scored = sweep_table(df, y, channels, controls, group, splits, share, seed).persist()
    names = list(channels.values())
    row = lambda r: {"columns": tuple(names[i][j] for i, j in enumerate(decode(np.array([r.candidate]), [len(n) for n in names])[0])), "mean": r["mean"], "se": r.se, "weights": np.array(r.weights)}
    short = scored.orderBy(F.desc("mean"), "candidate").limit(top).collect()
    radius = lambda c: int("".join(ch for ch in c if ch.isdigit()) or 0)
    # the total radius of a candidate, from its number
    rest, sizes = F.col("candidate"), [len(n) for n in names]
    total = F.lit(0)
    for i in reversed(range(len(sizes))):
        total = total + F.element_at(F.array(*(F.lit(radius(c)) for c in names[i])), (rest % sizes[i]).cast("int") + 1)
        rest = F.floor(rest / sizes[i]).cast("long")
    near = scored.where(F.col("mean") >= short[0]["mean"] - short[0].se).orderBy(total, F.desc("mean"), "candidate").limit(1).collect()
    out = {"best": row(short[0]), "shortlist": [row(r) for r in short], "one_se": row(near[0]), "candidates": prod(sizes)}
    scored.unpersist()
    return out


def choose_form(df: DataFrame, y: str, forms: dict[str, list[str]], controls: list[str], group: str, splits: int = 10, share: float = 0.25, seed: int = 0) -> tuple[str, dict[str, float]]:
    """The form (a list of columns each) with the best mean held-out t."""
    columns = [*dict.fromkeys([*(c for cs in forms.values() for c in cs), *controls, y])]
    parts = split_grams(df, columns, group, splits, share, seed)
    means = {name: float(np.mean([fit_columns(a, b, y, tuple(cs), controls).held for a, b in parts])) for name, cs in forms.items()}
    return max(means, key=lambda k: means[k]), means


def repeated_discovery(df: DataFrame, y: str, channels: dict[str, list[str]], controls: list[str], group: str, repeats: int = 5, seed: int = 0) -> dict:
    """How often repeats of the sweep choose the same columns, and the spread of their weights."""
    found = [sweep(df, y, channels, controls, group, splits=4, seed=seed + 1000 * k)["best"] for k in range(repeats)]
    first = max({f["columns"] for f in found}, key=lambda c: sum(f["columns"] == c for f in found))
    return {"columns": first, "share": sum(f["columns"] == first for f in found) / repeats, "weights": np.array([f["weights"] for f in found])}


def holdout_gain(df: DataFrame, y: str, columns: list[str], controls: list[str], group: str, splits: int = 20, share: float = 0.25, seed: int = 0) -> dict:
    """Held-out t of the index less that of the single channel that is best on the training part, with the corrected t over splits."""
    parts = split_grams(df, [*dict.fromkeys([*columns, *controls, y])], group, splits, share, seed)
    gains = []
    for a, b in parts:
        single = max((fit_columns(a, b, y, (c,), controls) for c in columns), key=lambda f: f.train)
        gains.append(fit_columns(a, b, y, tuple(columns), controls).held - single.held)
    t, p = corrected_t(gains, share)
    return {"gains": gains, "mean": float(np.mean(gains)), "t": t, "p": p}


def null_calibration(df: DataFrame, y: str, columns: list[str], controls: list[str], key: str, nulls: int = 16, seed: int = 0) -> float:
    """Share of permuted outcomes for which the held-out t of a refit index is over 1.96."""
    from .splits import permuted

    hits = 0
    for k in range(nulls):
        shuffled = permuted(df.select(key, y, *columns, *controls), key, y, seed + k).drop(y).withColumnRenamed("permuted", y)
        (a, b), *_ = split_grams(shuffled, [*dict.fromkeys([*columns, *controls, y])], key, 1, 0.5, seed + k)
        hits += fit_columns(a, b, y, tuple(columns), controls).held > 1.96
    return hits / nulls


def concordance(radii: np.ndarray, first: dict[str, np.ndarray], second: dict[str, np.ndarray]) -> dict[str, float]:
    """Half the sum of absolute differences of two tunings' profiles, and the difference of their median distances."""
    from terraloom.functions.kernels import blend_quantiles

    half = lambda a, b: 0.5 * float(np.abs(np.asarray(a) - np.asarray(b)).sum())
    return {"radius": half(first["radius"], second["radius"]), "statistic": half(first["statistic"], second["statistic"]), "r50": blend_quantiles(radii, first["radius"])[0] - blend_quantiles(radii, second["radius"])[0]}
