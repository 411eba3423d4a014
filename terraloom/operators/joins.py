"""Spatial, nearest and as-of joins as equi-joins on grid buckets, so that they shuffle by key and never cross.

A point is sent to the buckets around it (on the side named `left`), the other side stays in its own, and an exact predicate follows. Buckets are
as wide as the reach, so nine are enough. A crowded bucket is a skewed key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.geometry import bucket, distance, haversine_m


def around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """df with a row for each of the nine buckets (_bx, _by) about its point."""
    near = lambda c: F.sequence(bucket(F.col(c), size) - 1, bucket(F.col(c), size) + 1)
    return df.withColumn("_bx", F.explode(near(x))).withColumn("_by", F.explode(near(y)))


def radius_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "mx", ry: str = "my") -> DataFrame:
    """Pairs within `radius` (inclusive), with their distance `d`."""
    own = right.withColumn("_bx", bucket(F.col(rx), radius)).withColumn("_by", bucket(F.col(ry), radius))
    pairs = around(left, lx, ly, radius).join(own, ["_bx", "_by"]).withColumn("d", distance(F.col(lx), F.col(ly), F.col(rx), F.col(ry)))
    return pairs.where(F.col("d") <= float(radius)).drop("_bx", "_by")


def placed(targets: DataFrame, key: str, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """The places (key, x, y) of keys that have one row, and the rows of the others; rows without a place are left out. What depends on the place alone
    is worked out for distinct places and joined back: many keys at one place would each meet the same rows."""
    at = targets.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    kept = at.groupBy(key).agg(F.count("*").alias("_rows"), F.min("x").alias("x"), F.min("y").alias("y"))
    return kept.where("_rows = 1").drop("_rows"), at.join(kept.where("_rows > 1").select(key), key, "left_semi")


def nearest_join(left: DataFrame, right: DataFrame, key: str, values: list[str], reach: float, order: str, **at: str) -> DataFrame:
    """left with the values of the nearest right row within reach (null if none) and its distance; the least `order` of equally near ones. Places meet
    places: of right rows at one place only the least `order` can be the nearest."""
    asked = left.select(key, F.col(at.get("lx", "x")).alias("_x"), F.col(at.get("ly", "y")).alias("_y")).distinct()
    first = right.groupBy(F.col(at.get("rx", "mx")).alias("_mx"), F.col(at.get("ry", "my")).alias("_my")).agg(F.min(F.struct(order, *[v for v in values if v != order])).alias("_o"))
    pairs = radius_join(asked.select("_x", "_y").distinct(), first, reach, "_x", "_y", "_mx", "_my")
    best = pairs.groupBy("_x", "_y").agg(F.min(F.struct("d", "_o")).alias("_n"))
    own = asked.join(best, ["_x", "_y"]).groupBy(key).agg(F.min("_n").alias("_n"))
    return left.join(own, key, "left").select(*left.columns, *(F.col(f"_n._o.{v}").alias(v) for v in values), F.col("_n.d").alias("distance"))


def grid_spacing(points: DataFrame, key: str, reach: float, x: str = "mx", y: str = "my") -> DataFrame:
    """One row: the median distance of points to their nearest neighbour, and half of the diagonal of such a cell. A place of several keys needs no
    search, as each has a neighbour there; the others meet places."""
    from .splits import quantiles

    at = points.select(F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y")).na.drop()
    place = at.groupBy("_x", "_y").agg(F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    other = place.select(F.col("_x").alias("_ox"), F.col("_y").alias("_oy"), F.col("_low").alias("_olow"), F.col("_high").alias("_ohigh"))
    pairs = radius_join(place.where("_low = _high"), other, reach, "_x", "_y", "_ox", "_oy").where("not (_olow = _low and _ohigh = _low)")
    least = pairs.groupBy("_x", "_y").agg(F.min("d").alias("d")).unionByName(place.where("_low <> _high").select("_x", "_y", F.lit(0.0).alias("d")))
    found = quantiles(at.join(least, ["_x", "_y"]).groupBy("_k").agg(F.min("d").alias("d")), "d", [0.5])
    near = points.sparkSession.createDataFrame([(found[0] if found else None,)], "spacing double")
    return near.withColumn("cell_buffer", F.col("spacing") * F.lit(2**0.5 / 2))


def raster_sample(points: DataFrame, raster: DataFrame, x0: float, y0: float, size: float, value: str = "value") -> DataFrame:
    """Value of the pixel that holds each point: rows go down from y0, columns right from x0; null outside or without data."""
    at = points.withColumn("row", F.floor((F.lit(y0) - F.col("y")) / size).cast("long")).withColumn("col", F.floor((F.col("x") - F.lit(x0)) / size).cast("long"))
    return at.join(raster.select("row", "col", value), ["row", "col"], "left")


def zonal_pairs(discs: DataFrame, cells: DataFrame, radii: list[float], size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Discs and the pixels that they touch (closed), with the distance to the pixel's square: `d` decides the ring."""
    reach = float(max(radii)) + size * 2**0.5
    boxed = cells.withColumn("mx", F.lit(x0) + (F.col("col") + 0.5) * size).withColumn("my", F.lit(y0) - (F.col("row") + 0.5) * size)
    pairs = radius_join(discs, boxed, reach)
    out = lambda a, b: F.greatest(F.abs(F.col(a) - F.col(b)) - size / 2, F.lit(0.0))
    return pairs.withColumn("d", F.sqrt(F.pow(out("x", "mx"), 2) + F.pow(out("y", "my"), 2))).where(F.col("d") <= float(max(radii)))


def haversine_nearest(points: DataFrame, panoramas: DataFrame, key: str, pano: str, radius_m: float) -> DataFrame:
    """Nearest panorama within the radius on the sphere; of equally near ones the last. Buckets are rows of latitude as high as the radius, cut
    along the longitude, around the circle, by the width that the radius has at the row. Places meet places, each with its last panorama."""
    high = radius_m / 111_195.0
    row = lambda c: F.floor(F.col(c) / high).cast("long")
    wide = lambda r: high / F.greatest(F.cos(F.radians(F.least(F.abs(r), F.abs(r + 1)) * high + high)), F.lit(0.01))
    column = lambda c, r: F.floor(F.pmod(F.col(c) + 180, F.lit(360.0)) / wide(r)).cast("long")
    turns = lambda r: F.ceil(360.0 / wide(r)).cast("long")  # noqa: E731  the last column may be narrow, so one more is looked into
    asked = points.select(key, "lat", "lon").distinct()
    left = asked.select("lat", "lon").distinct().withColumn("_r", F.explode(F.sequence(row("lat") - 1, row("lat") + 1))).withColumn("_c0", column("lon", F.col("_r")))
    near = F.array_distinct(F.transform(F.sequence(F.col("_c0") - 2, F.col("_c0") + 2), lambda c: F.pmod(c, turns(F.col("_r")))))
    left = left.withColumn("_c", F.explode(near))
    right = panoramas.groupBy("plat", "plon").agg(F.max(pano).alias(pano)).withColumn("_r", row("plat")).withColumn("_c", column("plon", F.col("_r")))
    pairs = left.join(right, ["_r", "_c"]).withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("d") <= radius_m)
    best = pairs.groupBy("lat", "lon").agg(F.min(F.struct("d", (-F.col(pano)).alias("_o"), pano)).alias("_n"))
    own = asked.join(best, ["lat", "lon"]).groupBy(key).agg(F.min("_n").alias("_n"))
    return points.join(own, key, "left").select(*points.columns, F.col(f"_n.{pano}").alias(pano), F.col("_n.d").alias("distance_m"))


def choose_capture(captures: DataFrame, key: str, target_year: Column | int | None, max_gap: int | None = None, months: tuple[int, int] | None = None, hard: bool = False, tie: str = "capture_id") -> DataFrame:
    """One dated capture of each key: the least gap to the target year (none: the most recent), then the later year, then nearest the
    middle of the month window. A hard window leaves only months inside it; a soft one puts them first."""
    from terraloom.functions.dates import in_month_window, month_distance

    df = captures.where(F.col("year").isNotNull())
    gap = F.abs(F.col("year") - (F.lit(target_year) if isinstance(target_year, int) else target_year)) if target_year is not None else F.lit(0)
    df = df.withColumn("year_gap", gap.cast("int"))
    if max_gap is not None:
        df = df.where(F.col("year_gap") <= max_gap)
    order: list[Column] = [F.col("year_gap"), F.desc("year")]
    if months:
        inside = F.coalesce(in_month_window(F.col("month"), *months), F.lit(False))
        df = df.where(inside) if hard else df.withColumn("_in", inside)
        order = ([] if hard else [F.desc("_in")]) + order + [F.coalesce(month_distance(F.col("month"), *months), F.lit(12.0))]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order, tie))).where("_n = 1")
    return ranked.drop("_n", "_in")


def sampling_outcome(found: Column, dated: Column, kept: Column) -> Column:
    """What became of a grid point."""
    return F.when(~found, "no_panorama").when(~dated, "failed").when(~kept, "no_capture_in_window").otherwise("sampled")


def missing_ids(required: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored yet."""
    return required.join(stored.select(*keys).distinct(), keys, "left_anti")


def lookup(plan: DataFrame, store: DataFrame, keys: list[str], channel: str, radius: int, stat: str) -> DataFrame:
    """One (channel, radius, statistic) of a long store for each row of a plan; null when missing."""
    cell = store.where((F.col("channel") == channel) & (F.col("radius") == radius)).select(*keys, F.col(stat).alias("value"))
    return plan.join(cell, keys, "left")


def donor_tiles(missing: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached tiles of the same content key whose rectangle covers a missing one, the least id of several. Both sides meet in grid buckets as wide as
    the widest cached tile, so one content key isn't one bucket."""
    widest = cached.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    size = max(float(widest or 0.0), 1e-9)
    over = lambda a, b: F.sequence(bucket(F.col(a), size), bucket(F.col(b), size))
    held = cached.select(F.col("tile").alias("donor"), "content", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")), F.explode(over("x0", "x1")).alias("_bx"), "y0", "y1").withColumn("_by", F.explode(over("y0", "y1"))).drop("y0", "y1")
    asked = missing.withColumn("_bx", bucket(F.col("x0"), size)).withColumn("_by", bucket(F.col("y0"), size))
    pairs = asked.join(held, ["content", "_bx", "_by"]).where((F.col("_x0") <= F.col("x0")) & (F.col("_y0") <= F.col("y0")) & (F.col("_x1") >= F.col("x1")) & (F.col("_y1") >= F.col("y1")))
    return pairs.groupBy("tile").agg(F.min("donor").alias("donor"))


def crop(metric: DataFrame, target: DataFrame, margin: float) -> DataFrame:
    """Metric points within the target's bounds and a margin; the bounds are one row."""
    b = target.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if b.x0 is None:
        return metric.limit(0)
    return metric.where(F.col("mx").between(b.x0 - margin, b.x1 + margin) & F.col("my").between(b.y0 - margin, b.y1 + margin))
