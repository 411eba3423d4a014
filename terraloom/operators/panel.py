"""Panels: long form, baselines, guards, within and between parts, indicator columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.dates import wave_label, years_between


def baseline_years(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Fractional years since the entity's own first date."""
    first = F.min(date).over(Window.partitionBy(entity))
    return df.withColumn("years_since_baseline", years_between(F.col(date), first))


def from_waves(frames: dict[str, DataFrame], entity: str, outcome: str, columns: list[str]) -> DataFrame:
    """Wave tables, one for each label, as one long table; rows without entity or outcome go."""
    if len(set(frames)) != len(frames):
        raise ValueError("a wave label is there twice")
    if lost := [c for c in columns if not any(c in df.columns for df in frames.values())]:
        raise ValueError(f"no wave has {lost}")
    out = None
    for label, df in frames.items():
        part = df.select(F.col(entity).alias("entity_id"), F.lit(label).alias("wave"), F.col(outcome).alias("outcome"), *[c for c in dict.fromkeys(columns) if c not in (entity, outcome) and c in df.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.where(F.col("entity_id").isNotNull() & F.col("outcome").isNotNull())


def from_dates(df: DataFrame, entity: str, outcome: str, date: str, columns: list[str], waves: list[str] | None = None) -> DataFrame:
    """One table with a date, tagged by calendar year."""
    kept = df.where(F.col(entity).isNotNull() & F.col(outcome).isNotNull() & F.col(date).isNotNull())
    out = kept.select(F.col(entity).alias("entity_id"), wave_label(F.col(date)).alias("wave"), F.col(outcome).alias("outcome"), F.col(date).alias("date"), *columns)
    out = out.where(F.col("wave").isin(waves)) if waves else out
    return baseline_years(out, "entity_id", "date")


def duplicate_keys(df: DataFrame, entity: str, wave: str) -> DataFrame:
    """Keys that a panel holds more than once."""
    return df.groupBy(entity, wave).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, entity: str, wave: str) -> DataFrame:
    if duplicate_keys(df, entity, wave).limit(1).count():
        raise ValueError(f"({entity}, {wave}) isn't unique")
    return df


def within_between(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Entity mean and deviation from it."""
    mean = F.avg(value).over(Window.partitionBy(entity))
    return df.withColumn("between", mean).withColumn("within", F.col(value) - F.col("between"))


def within_estimable(df: DataFrame, tolerance: float = 1e-12) -> Column:
    return F.var_pop("within") > tolerance


def placebo(df: DataFrame, wave: str, value: str) -> DataFrame:
    """The exposure replaced by the mean of its wave."""
    return df.withColumn("placebo", F.avg(value).over(Window.partitionBy(wave)))


def period_confounding(df: DataFrame, entity: str, value: str, years: str, limit: float = 0.2) -> DataFrame:
    """Correlation of an entity's deviations in exposure and in time, flagged from `limit`."""
    w = Window.partitionBy(entity)
    dev = df.select((F.col(value) - F.avg(value).over(w)).alias("e"), (F.col(years) - F.avg(years).over(w)).alias("t"))
    return dev.agg(F.corr("e", "t").alias("correlation"), F.count("*").alias("n")).withColumn("flagged", F.abs("correlation") >= limit)


def wave_means(df: DataFrame, wave: str, value: str) -> DataFrame:
    return df.groupBy(wave).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


#: Distinct levels beyond which a column isn't taken as a category: they become columns of the plan.
LEVELS = 200


def levels(df: DataFrame, column: str) -> list[str]:
    found = [r[0] for r in df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(LEVELS + 1).collect()]
    if len(found) > LEVELS:
        raise ValueError(f"{column} has over {LEVELS} levels")
    return found


def one_hot(df: DataFrame, column: str, missing: str = "drop") -> DataFrame:
    """Indicator columns of all levels but the first (in string order); missing rows go, or have a level of their own."""
    if missing not in ("drop", "indicator"):
        raise ValueError("missing is 'drop' or 'indicator'")
    text = F.col(column).cast("string")
    out = df.where(text.isNotNull()) if missing == "drop" else df
    made = {f"{column}_{v}": F.coalesce(text == v, F.lit(False)).cast("double") for v in levels(df, column)[1:]}
    if missing == "indicator":
        made[f"{column}_missing"] = text.isNull().cast("double")
    return out.withColumns(made) if made else out


def period_controls(df: DataFrame, wave: str, area: str | None = None, years: str | None = None) -> DataFrame:
    """Indicators of waves and areas; time goes if the waves span it (each wave has one time)."""
    out = one_hot(df, wave)
    if area:
        out = one_hot(out, area)
    if years and not df.groupBy(wave).agg((F.max(years) - F.min(years)).alias("s")).where("s > 1e-9").limit(1).count():
        out = out.drop(years)
    return out


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where each column is there and finite."""
    tests = []
    for c in dict.fromkeys(columns):
        v = F.col(c).cast("double")
        tests.append(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    while len(tests) > 1:  # in pairs, so that hundreds of columns aren't a chain as deep
        tests = [tests[i] & tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return df.where(tests[0]) if tests else df


def as_binary(df: DataFrame, column: str) -> DataFrame:
    """A column of exactly two values as 0 and 1, the greater one the event."""
    r = df.agg(F.count_distinct(column).alias("n"), F.max(column).alias("m")).first()
    if r.n != 2:
        raise ValueError(f"{column} has {r.n} values, not two")
    return df.withColumn(column, (F.col(column) == r.m).cast("double"))


def usable_weights(df: DataFrame, weight: str) -> DataFrame:
    """Rows whose weight is finite and positive."""
    return complete(df, [weight]).where(F.col(weight) > 0)


def centred(df: DataFrame, value: str, group: str, name: str | None = None) -> DataFrame:
    """Values less their group's mean."""
    return df.withColumn(name or value, F.col(value) - F.avg(value).over(Window.partitionBy(group)))


def projected(df: DataFrame, entity: str, outcome: str, columns: list[str]) -> DataFrame:
    """entity_id, outcome and the named columns, each once, in order."""
    named = {entity: "entity_id", outcome: "outcome"}
    missing = [c for c in (entity, outcome, *columns) if c not in df.columns]
    if missing:
        raise ValueError(f"there is no column {', '.join(missing)}")
    return df.select(*(F.col(c).alias(named.get(c, c)) for c in dict.fromkeys([entity, outcome, *columns])))


def rows_of(df: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows of the given (held-out) entities."""
    return df.join(entities.select(key).distinct(), key, "left_semi")
