"""Rasters as long tables (row, col, value): temporal composites, focal chains, mosaics, statistics, pyramids, points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCERS = {"median": lambda v: F.percentile(v, F.lit(0.5)), "mean": F.avg, "max": F.max, "min": F.min}


def temporal(scenes: DataFrame, reducers: list[str], value: str = "value") -> DataFrame:
    """One pass over the scenes of each pixel for all reducers; masked values are left out."""
    return scenes.groupBy("row", "col").agg(*(REDUCERS[r](F.col(value)).alias(r) for r in reducers))


def scenes_of(scenes: DataFrame, start: Column | str, end: Column | str, cloud_max: float) -> DataFrame:
    """Scenes of a half-open window of time with less cloud than a bound: both reach the scan."""
    return scenes.where((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("cloud") < cloud_max))


def widened(start_day: int, days: int, clear: int, wider_clear: int, least: int = 3) -> tuple[int, int]:
    """The window of days to use: half as wide again on both sides, once, if there are too few clear scenes and that finds more."""
    if clear >= least or wider_clear <= clear:
        return start_day, days
    more = days // 2
    return start_day - more, days + 2 * more


def focal(raster: DataFrame, stat: str, radius: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Statistic of the pixels within a circle of `radius` pixels; each pixel is sent to those that it counts for (no join)."""
    offsets = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    shift = F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("dr"), F.lit(c).cast("long").alias("dc")) for r, c in offsets)))
    sent = raster.select(*by, "row", "col", "value", shift.alias("o")).select(*by, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "value", ((F.col("o.dr") == 0) & (F.col("o.dc") == 0)).alias("own"))
    out = sent.groupBy(*by, "row", "col").agg(REDUCERS[stat](F.col("value")).alias("value"), F.max("own").alias("own"))
    return out.where("own").drop("own")


def apply_chain(scenes: DataFrame, steps: list[tuple[str, ...]], water: DataFrame | None = None) -> DataFrame:
    """Steps of a chain in order; those before the temporal one run on each scene (column scene_id)."""
    from terraloom.functions.bands import mask_water

    df, by = scenes.select("scene_id", "row", "col", "value"), ["scene_id"]
    for step in steps:
        if step[0] == "water_mask":
            df = df.join(water, ["row", "col"], "left").withColumn("value", mask_water(F.col("value"), F.col("occurrence"))).drop("occurrence")
        elif step[0] == "focal":
            df = focal(df, step[1], int(step[2]), by)
        else:
            df, by = df.groupBy("row", "col").agg(REDUCERS[step[1]](F.col("value")).alias("value")), []
    return df


def mosaic(tiles: DataFrame, order: str) -> DataFrame:
    """Tiles in list order, each written whole: the last tile that has a pixel wins, its missing values included."""
    return tiles.groupBy("row", "col").agg(F.max_by(F.struct("value"), order).alias("v")).select("row", "col", "v.value")


def band_statistics(raster: DataFrame, by: list[str] = [], nodata: float | None = None) -> DataFrame:  # noqa: B006
    """Least, greatest, mean, population SD and percentage of valid values."""
    v = F.col("value") if nodata is None else F.nullif(F.col("value"), F.lit(float(nodata)))
    return raster.groupBy(*by).agg(F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), (100.0 * F.count(v) / F.count("*")).alias("valid_percent"))


def overview(raster: DataFrame, factor: int) -> DataFrame:
    """A level of a pyramid: means of squares of pixels."""
    down = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return raster.select(down("row"), down("col"), "value").groupBy("row", "col").agg(F.avg("value").alias("value"))


def to_points(raster: DataFrame, x0: float, y0: float, size: float, nodata: float = -9999.0, places: int = 4) -> DataFrame:
    """Middles of the valid pixels with their rounded values."""
    valid = raster.where(F.col("value").isNotNull() & (F.col("value") != nodata))
    return valid.select("row", "col", (F.lit(x0) + (F.col("col") + 0.5) * size).alias("x"), (F.lit(y0) - (F.col("row") + 0.5) * size).alias("y"), F.bround("value", places).alias("value"))


def to_bands(points: DataFrame, columns: list[str], x0: float, y0: float, size: float) -> DataFrame:
    """Points to pixels, a column for each band: the mean of the points in a pixel."""
    at = points.withColumn("row", F.floor((F.lit(y0) - F.col("y")) / size).cast("long")).withColumn("col", F.floor((F.col("x") - F.lit(x0)) / size).cast("long"))
    return at.groupBy("row", "col").agg(*(F.avg(c).alias(c) for c in columns))
