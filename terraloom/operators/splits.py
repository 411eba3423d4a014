"""Bins, blocks, shards and splits. Draws are hashes of identifiers and a seed, so they don't depend on the order of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME, STEP, MODULUS = 1103515245, 12345, 2147483648


def draw(key: Column, seed: int = 0) -> Column:
    """Number from 0 to 1 of a whole-number key: arithmetic that any SQL engine has."""
    return F.pmod((key.cast("long") + seed * 7919) % 1000003 * PRIME + STEP, F.lit(MODULUS)) / F.lit(float(MODULUS))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact linear percentiles of a whole column: distinct values are counted and a running sum of the counts finds the ranks that are asked for. No
    task holds all values, as the buffer of an exact percentile aggregate would."""
    v = F.col(value).cast("double")
    return counted_quantiles(df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count("*").alias("c")), shares)


def counted_quantiles(counts: DataFrame, shares: list[float]) -> list[float]:
    """Exact linear percentiles of values v that are there c times."""
    upto = running(counts, [F.col("v")], F.col("c"), "upto")
    n = upto.agg(F.max("upto")).first()[0]
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    wanted = sorted({int(k) for h in at for k in (h // 1, min(h // 1 + 1, n - 1))})
    hit = F.exists(F.array(*map(F.lit, wanted)), lambda k: (k >= F.col("upto") - F.col("c")) & (k < F.col("upto")))
    found = sorted((r.upto, r.v) for r in upto.where(hit).select("upto", "v").collect())  # two for each share at most
    of = lambda k: next(x for u, x in found if k < u)
    out = []
    for h in at:
        low, high = of(int(h)), of(min(int(h) + 1, n - 1))
        out.append(low if h == int(h) or low == high else (int(h) + 1 - h) * low + (h - int(h)) * high)
    return out



def cuts(df: DataFrame, value: str, n: int) -> list[float]:
    """Exact percentiles that part the values in n; a handful of numbers for the plan."""
    return quantiles(df, value, [i / n for i in range(n + 1)])


def qcut(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Quantile bins closed on the right (ties go down), equal cuts merged, the least value included."""
    edges = sorted(set(cuts(df, value, n)))[1:-1]
    return df.withColumn(name, sum(((F.col(value) > e).cast("int") for e in edges), F.lit(0)))


def exposure_groups(df: DataFrame, value: str, n: int = 4, name: str = "quartile") -> DataFrame:
    """Groups by the number of distinct inner cuts at or below the value (ties go up)."""
    edges = sorted(set(cuts(df, value, n)[1:-1]))
    return df.withColumn(name, sum(((F.col(value) >= e).cast("int") for e in edges), F.lit(0)))


def spatial_blocks(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Dense numbers, row by row, of the occupied blocks of a square grid from the least coordinates. Only distinct blocks are numbered, in ranges."""
    low = df.agg(F.min(x).alias("x"), F.min(y).alias("y")).first()
    at = df.withColumn("_ix", F.floor((F.col(x) - F.lit(low.x)) / size).cast("long")).withColumn("_iy", F.floor((F.col(y) - F.lit(low.y)) / size).cast("long"))
    dense = numbered(at.select("_iy", "_ix").distinct(), [F.col("_iy"), F.col("_ix")], "_b").select("_iy", "_ix", (F.col("_b") - 1).cast("int").alias("block"))
    return at.join(dense, ["_iy", "_ix"]).drop("_iy", "_ix")


def block_size(df: DataFrame, target: int, least: float, rounds: int = 20, x: str = "x", y: str = "y") -> float:
    """Edge whose grid has about `target` occupied blocks, by bisection in the logarithm, at least `least`."""
    b = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    low, high = max(least, 1e-9), max(b[1] - b[0], b[3] - b[2], least) * 1.001
    for _ in range(rounds):
        mid = (low * high) ** 0.5
        n = df.select(F.count_distinct(F.floor((F.col(x) - F.lit(b[0])) / mid), F.floor((F.col(y) - F.lit(b[2])) / mid))).first()[0]
        low, high = (mid, high) if n > target else (low, mid)
        if n == target or high / low < 1.001:
            break
    return max(least, (low * high) ** 0.5)


def default_blocks(n: int) -> int:
    return int(np.clip(n // 15, 9, 200))


def stripe_blocks(blocks: DataFrame, share: float, start: int = 0) -> DataFrame:
    """Distinct blocks with `test`: evenly spaced ones from a start."""
    step = max(1, round(1 / share))
    return blocks.select("block").distinct().withColumn("test", F.col("block") % step == start % step)


def random_blocks(blocks: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Whole blocks in the order of their draws until the share of rows is nearest."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("n"))
    run = running(sizes.withColumn("_d", draw(F.col("block"), seed)), [F.col("_d"), F.col("block")], F.col("n"), "upto")
    goal = F.lit(blocks.count() * share)
    return run.withColumn("test", (F.col("upto") <= goal) | ((F.col("upto") - F.col("n") < goal) & (F.col("upto") - goal < goal - (F.col("upto") - F.col("n"))))).select("block", "n", "test")


def stratified_split(df: DataFrame, key: str, outcome: str, share: float, bins: int = 5, seed: int = 0) -> DataFrame:
    """`test` for the first part of each outcome bin in the order of the draws."""
    binned = qcut(df, outcome, bins)
    w = Window.partitionBy("bin")
    ranked = binned.withColumn("_r", F.row_number().over(w.orderBy(draw(F.col(key), seed), key))).withColumn("_n", F.count("*").over(w))
    return ranked.withColumn("test", F.col("_r") <= F.floor(F.col("_n") * share + 0.5)).drop("_r", "_n")


def grouped_holdout(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """Whole groups held out by their draw."""
    return df.withColumn("test", draw(F.col(group), seed) < share)


def redrawn_holdout(df: DataFrame, group: str, share: float, seed: int = 0, tries: int = 50) -> DataFrame:
    """The same, with the next seed until both sides have rows."""
    for k in range(tries):
        out = grouped_holdout(df, group, share, seed + k)
        if out.agg(F.count_distinct("test")).first()[0] == 2:
            return out
    raise ValueError("no draw leaves rows on both sides")


def shard(df: DataFrame, cluster: str, row: str, col: str, shards: int, block: int = 64) -> DataFrame:
    """Shard of each spatial block by the CRC of its name: the same on any machine."""
    name = F.concat_ws(":", F.col(cluster).cast("string"), F.floor(F.col(row) / block).cast("string"), F.floor(F.col(col) / block).cast("string"))
    return df.withColumn("shard", F.pmod(F.crc32(name), F.lit(shards)).cast("int"))


def area_balanced(df: DataFrame, bin_col: str, area: str, shares: dict[str, float], order: str) -> DataFrame:
    """Greedy split in each outcome bin: each polygon goes where most of the area is still lacking. One bin is one group, which holds ids
    and areas only."""
    names, goals = list(shares), np.array(list(shares.values()), float)

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([area, order], ascending=[False, True])
        have, total, out = np.zeros(len(names)), frame[area].sum(), []
        for a in frame[area]:
            k = int(np.argmax(goals * total - have))
            have[k] += a
            out.append(names[k])
        return frame.assign(split=out)

    slim = df.select(bin_col, order, area)
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes) + ", split string"
    return df.join(slim.groupBy(bin_col).applyInPandas(split, schema).select(order, "split"), order)


def group_blocks(df: DataFrame, group: str, size: float) -> DataFrame:
    """Block of each group by the mean of its points."""
    return spatial_blocks(df.groupBy(group).agg(F.avg("x").alias("x"), F.avg("y").alias("y")), size)


def running(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Running sum of a value over the whole table in an order: sums inside ranges of the order, and the few totals of the ranges before, so no
    task sorts all rows. The bounds of ranges come from a sample that differs from run to run, so the table in its ranges is written to the shared
    folder: the totals and the rows are then of the same ranges, and lost executors don't change them."""
    from terraloom.sources.work import written

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_p").agg(F.sum("_v").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # one row for each range: as many as shuffle partitions
    return ranged.withColumn("_run", inside).join(F.broadcast(totals), "_p").withColumn(name, F.col("_off") + F.col("_run")).drop("_p", "_v", "_run", "_off")


def numbered(df: DataFrame, order: list[Column], name: str, stratum: list[str] = []) -> DataFrame:  # noqa: B006
    """Row numbers from 1, inside strata if given."""
    if stratum:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)).cast("long"))
    return running(df, order, F.lit(1), name)


def permuted(df: DataFrame, key: str, value: str, seed: int, stratum: list[str] = []) -> DataFrame:  # noqa: B006
    """value permuted, inside strata if given: rows in the order of their keys take the values in the order of the draws."""
    own = numbered(df, [F.col(key)], "_r", stratum)
    other = numbered(df.select(*stratum, F.col(value).alias("permuted"), draw(F.col(key), seed).alias("_u"), F.col(key).alias("_k")), [F.col("_u"), F.col("_k")], "_r", stratum)
    return own.join(other.drop("_u", "_k"), [*stratum, "_r"]).drop("_r")
