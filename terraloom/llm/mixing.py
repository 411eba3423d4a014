"""Operator 6, mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

A document falls into a cell of source, language and topic; values that the targets don't name fall into `*`. One aggregation sums the tokens
of each cell, with the partial sums on the map side, so a source that holds a third of all rows is a few rows after it. There are never more
cells than the product of the targets' sizes, a parameter, so the cells may go to the driver, where raking scales them to each marginal in
turn until all fit; marginals that no document falls into are left out and the others scaled up. The factors go back as literals of one map.
Each document's probability is its cell's factor, scaled so that BUDGET of the tokens are kept on average; where that is over 1 the cells are
raked again with 1 as the most, so a level with too few tokens is kept whole and the others share the rest by their targets. `shares` reports
what was reached. A document is sampled if the hash of its identifier and text, as a number from 0 to 1, is less. Hence a row's fate depends on
no other row's order, and is the same in each run. Tokens are what single white-space characters (space, line end, tab) separate.

Cases: a null or empty text has 0 tokens and its cell's probability; a null source or language falls into `*`; an empty table stays empty;
repeated rows have the same fate.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import col, free_name

#: Target shares of the tokens; `*` is everything not named. Sources are balanced among each other only where they are named.
TARGETS = {
    "source": {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)} | {"*": 0.04},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, "*": 0.05},
    "topic": {"prose": 0.85, "lists": 0.05, "table": 0.05, "symbols": 0.05},
}
BUDGET, SEED, ROUNDS, CLOSE, CELLS = 0.6, 6, 200, 1e-9, 100_000


def times(text: Column, chars: str) -> Column:
    """How often ASCII characters are in a text: by what is left without each, which is a scan of bytes, not a regular expression."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def topic(text: Column) -> Column:
    """A coarse topic by form: table (bars between words), symbols, lists (many lines), or prose."""
    n = F.greatest(F.octet_length(text), F.lit(1))
    return F.when(times(text, "|") > 0.05 * n, "table").when(times(text, "%*&#$") > 0.05 * n, "symbols").when(times(text, "\n") > 0.03 * n, "lists").otherwise("prose")


def tokens(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(times(text, " \n\t") + 1).cast("long")


def rake(tokens_of: dict[tuple, float], targets: dict[str, dict[str, float]]) -> dict[tuple, float]:
    """Factor of each cell such that the weighted tokens have the target shares, as near as they can; 1 on average."""
    names = list(targets)
    levels = [list(targets[n]) for n in names]
    start = np.zeros([len(x) for x in levels])
    for cell, n in tokens_of.items():
        start[tuple(levels[i].index(v) for i, v in enumerate(cell))] = n
    if not start.sum():
        return dict.fromkeys(tokens_of, 1.0)
    now = start / start.sum()
    goals = []
    for i, n in enumerate(names):
        there = start.sum(axis=tuple(j for j in range(len(names)) if j != i)) > 0
        goal = np.where(there, np.array([max(0.0, targets[n][v]) for v in levels[i]]), 0.0)
        goals.append(goal / goal.sum() if goal.sum() else there / there.sum())
    for _ in range(ROUNDS):
        off = 0.0
        for i, goal in enumerate(goals):
            have = now.sum(axis=tuple(j for j in range(len(names)) if j != i))
            scale = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            off = max(off, float(np.abs(have - goal).max()))
            now = now * scale.reshape([-1 if j == i else 1 for j in range(len(names))])
        if off < CLOSE:
            break
    factor = np.divide(now * start.sum(), start, out=np.zeros_like(now), where=start > 0)
    return {cell: float(factor[tuple(levels[i].index(v) for i, v in enumerate(cell))]) if n else 1.0 for cell, n in tokens_of.items()}


def reachable(most: np.ndarray, goal: np.ndarray, kept: float) -> np.ndarray:
    """Tokens to keep of each level: the goal's shares of `kept`, none over `most`; what a level lacks goes to the others by their shares."""
    out, open_ = np.zeros_like(most), most > 0
    while open_.any() and kept - out.sum() > CLOSE * kept:
        share = np.where(open_, np.maximum(goal, 1e-12), 0.0)
        out = np.minimum(most, out + share / share.sum() * (kept - out.sum()))
        open_ &= out < most * (1 - 1e-12)
    return out


def calibrate(tokens_of: dict[tuple, float], factors: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """Probability of each cell, at most 1, such that `budget` of the tokens are kept on average. Where no factor is cut it is the factor times
    a number; else the cells are raked again under the cap, to the factors' shares of each marginal as far as its tokens go."""
    total = sum(tokens_of.values())
    if not total or budget <= 0:
        return {c: max(0.0, min(1.0, budget * f)) for c, f in factors.items()}
    cells = list(tokens_of)
    n, f = np.array([tokens_of[c] for c in cells], float), np.array([factors[c] for c in cells])
    chance = budget * f
    if (chance[n > 0] > 1).any() and budget < 1:
        axes = [np.unique([c[i] for c in cells], return_inverse=True)[1] for i in range(len(cells[0]))]
        goals = [reachable(np.bincount(a, n), np.bincount(a, n * f) / total, budget * total) for a in axes]
        chance = np.minimum(chance, 1.0)
        for _ in range(ROUNDS):
            off = 0.0
            for a, goal in zip(axes, goals):
                off = max(off, float(np.abs(np.bincount(a, n * chance) - goal).max()) / total)
                for level, wanted in enumerate(goal):
                    at = np.flatnonzero((a == level) & (n > 0))
                    if len(at):
                        chance[at] = capped(n[at], chance[at], wanted)
            if off < CLOSE:
                break
    return {c: float(min(1.0, p)) for c, p in zip(cells, capped(n, chance, budget * total))}


def capped(n: np.ndarray, chance: np.ndarray, wanted: float) -> np.ndarray:
    """Chances scaled alike and cut at 1 such that `wanted` of the tokens n are kept, or as many as can be."""
    if not (n * chance).sum():
        return chance
    low, high = 0.0, 1.0
    while (n * np.minimum(1.0, high * chance)).sum() < wanted * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if (n * np.minimum(1.0, middle * chance)).sum() < wanted else (low, middle)
    return np.minimum(1.0, high * chance)


def weighted(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, name: str = "__mix") -> DataFrame:
    """docs with the further column `name`, which they mustn't have: a struct of source, lang, topic, tokens, weight, probability, sampled."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name}")
    if np.prod([len(v) for v in targets.values()]) > CELLS:
        raise ValueError(f"the targets have over {CELLS} cells")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    level = {n: (topic(text) if n == "topic" else F.col(n).cast("string")) for n in targets}
    cell = {n: F.when(v.isin([x for x in targets[n] if x != "*"]), v).otherwise(F.lit("*")) for n, v in level.items()}
    missing = [n for n in targets if "*" not in targets[n]]
    full = {n: t if n not in missing else t | {"*": 0.0} for n, t in targets.items()}
    coded = docs.withColumn(name, F.struct(*(cell[n].alias(n) for n in targets), tokens(text).alias("tokens")))
    sums = {tuple(r[:-1]): float(r[-1]) for r in coded.groupBy(*(F.col(f"{name}.{n}").alias(n) for n in targets)).agg(F.sum(f"{name}.tokens")).collect()}
    factors = rake(sums, full)
    chances = calibrate(sums, factors, budget)
    keys = list(sums) or list(product(*([v] for v in ["*"] * len(targets))))
    pairs = [x for k in keys for x in (F.lit("\0".join(k)), F.struct(F.lit(factors.get(k, 1.0)).alias("weight"), F.lit(chances.get(k, budget)).alias("probability")))]
    found = F.element_at(F.create_map(*pairs), F.concat_ws("\0", *(F.col(f"{name}.{n}") for n in targets)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11) / F.lit(float(1 << 53))
    return coded.withColumn(name, F.struct(f"{name}.*", found["weight"].alias("weight"), found["probability"].alias("probability"), (draw < found["probability"]).alias("sampled")))


def shares(mixed: DataFrame, targets: dict[str, dict[str, float]] = TARGETS) -> DataFrame:
    """marginal, level, target, given, reached: shares of the tokens of a `weighted` table, before and after sampling."""
    out = []
    for name in targets:
        level = F.col(f"__mix.{name}")
        sums = mixed.groupBy(level.alias("level")).agg(F.sum("__mix.tokens").alias("given"), F.sum(F.when(F.col("__mix.sampled"), F.col("__mix.tokens")).otherwise(0)).alias("reached"))
        out += [(name, r.level, float(targets[name].get(r.level, 0.0)), r.given, r.reached) for r in sums.collect()]
    total = {n: [sum(r[k] for r in out if r[0] == n) or 1 for k in (3, 4)] for n in targets}
    return mixed.sparkSession.createDataFrame([(n, v, t, g / total[n][0], r / total[n][1]) for n, v, t, g, r in out], "marginal string, level string, target double, given double, reached double")


def draw(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """docs, all columns, of the sampled rows."""
    name = free_name(docs, "__mix")
    return weighted(docs, targets, budget, name=name).where(F.col(f"{name}.sampled")).select(*map(col, docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = weighted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return mixed.select("doc_id", F.col("__mix.source").alias("source"), F.col("__mix.lang").alias("lang"), F.col("__mix.topic").alias("topic"), F.col("__mix.tokens").alias("n_tokens"), F.col("__mix.weight").alias("weight"), F.col("__mix.probability").alias("probability"), F.col("__mix.sampled").alias("sampled"))
