"""Report tables as DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.tails import clopper_pearson


def tidy(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Quantities of several tables as rows of one, tagged by their name."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("quantity"), *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def counters(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def capture_summary(df: DataFrame, ts: Column, kind: str) -> DataFrame:
    """Counts by kind, by year and by month in one pass (grouping sets)."""
    rows = df.select(F.col(kind).alias("kind"), F.year(ts).alias("year"), F.month(ts).alias("month"))
    return rows.groupingSets([["kind"], ["year"], ["month"]], "kind", "year", "month").agg(F.count("*").alias("n"))


def subset_scores(df: DataFrame, split: str, scores: dict[str, Column]) -> DataFrame:
    """Aggregates over all rows and for each side of a split."""
    return df.groupingSets([[split], []], split).agg(*(c.alias(n) for n, c in scores.items())).withColumn("subset", F.coalesce(F.col(split).cast("string"), F.lit("all"))).drop(split)


def stage_timing(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Stages, longest first, with their share of the whole."""
    total = df.groupBy(stage).agg(F.sum(seconds).alias("seconds"))
    return total.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy())).orderBy(F.desc("seconds"), stage)


def null_summary(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Share of nulls with p below 0.05, with its exact interval."""
    @F.pandas_udf("low double, high double")
    def exact(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(h), int(m)) for h, m in zip(hits, n)], columns=["low", "high"])

    rows = df.groupBy(*by).agg(F.count(p).alias("n"), F.count_if(F.col(p) < 0.05).alias("hits"))
    return rows.withColumn("rate", F.col("hits") / F.col("n")).withColumn("i", exact("hits", "n")).select(*by, "n", "hits", "rate", "i.low", "i.high")


def largest_weight_shares(df: DataFrame, split: str, term: str, weight: str) -> DataFrame:
    """Share of splits in which a term has the largest weight."""
    first = F.row_number().over(Window.partitionBy(split).orderBy(F.desc(weight), term)) == 1
    return df.withColumn("_f", first.cast("double")).groupBy(term).agg(F.avg("_f").alias("share"))


def scale_choice(df: DataFrame, by: list[str], scale: str, criterion: str) -> DataFrame:
    """How often each scale has the least criterion, and the median of the chosen ones."""
    best = df.groupBy(*by).agg(F.min(F.struct(criterion, scale)).alias("b")).select(*by, F.col(f"b.{scale}").alias(scale))
    return best.groupBy(scale).agg(F.count("*").alias("wins"))


def group_record(df: DataFrame, group: str) -> DataFrame:
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    n = F.when(F.col(group).isNotNull(), F.col("n"))
    return sizes.agg(F.count(n).alias("groups"), F.min(n).alias("smallest"), F.max(n).alias("largest"), (F.max(n) / F.sum(n)).alias("largest_share"), F.coalesce(F.sum(F.when(F.col(group).isNull(), F.col("n"))), F.lit(0)).alias("missing"))


def summarise_splits(df: DataFrame, keys: list[str], value: str, test_share: float, family: list[str], held: str | None = None) -> DataFrame:
    """Median, spread, corrected t with its p, and the p adjusted in each family, of every quantity over repeated splits."""
    from .inference import holm_adjust, split_summary, with_t_p

    out = with_t_p(split_summary(df, keys, value, test_share, held), "corrected_t", "n_splits")
    return holm_adjust(out, "corrected_p", family, keys[0])


def scale_summary(df: DataFrame, by: list[str], split: str, scale: str, criterion: str) -> DataFrame:
    """(by, splits, scale chosen most often, the median of the chosen ones): in each split the scale with the least criterion is chosen."""
    chosen = df.groupBy(*by, split).agg(F.min(F.struct(criterion, scale)).alias("b")).select(*by, F.col(f"b.{scale}").cast("double").alias("scale"))
    wins = chosen.groupBy(*by, "scale").agg(F.count("*").alias("wins"))
    most = wins.groupBy(*by).agg(F.max(F.struct("wins", (-F.col("scale")).alias("s"))).alias("m")).select(*by, (-F.col("m.s")).alias("mode"), F.col("m.wins").alias("wins"))
    return chosen.groupBy(*by).agg(F.count("*").alias("splits"), F.percentile("scale", F.lit(0.5)).alias("median")).join(most, by)
