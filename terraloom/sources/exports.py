"""Outputs of runs: values fit for JSON, entity tables, point layers with their record, mosaics by cluster, tile manifests, unit caches."""

from __future__ import annotations

import json
import math
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import persist_unit, table, write_geojson

__all__ = ["persist_unit", "table"]


def plain(value: Any, depth: int = 0) -> Any:
    """A nested result as JSON has it: NumPy numbers and arrays as numbers and lists, missing and infinite numbers as null, dates as text, keys as
    text; over twenty levels deep as text."""
    if depth > 20:
        return str(value)
    if isinstance(value, dict):
        return {str(k): plain(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list | tuple | set | frozenset):
        return [plain(v, depth + 1) for v in value]
    if hasattr(value, "tolist"):
        return plain(value.tolist(), depth + 1)
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, bool | int | str) or value is None:
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return str(value)


def json_fit(df: DataFrame) -> DataFrame:
    """Attributes as JSON has them: dates and binary as text, NaN and infinite numbers as null, decimals as doubles."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(t, T.BinaryType):
            c = F.hex(c)
        elif isinstance(t, T.DecimalType | T.FloatType | T.DoubleType):
            c = c.cast("double")
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def narrowed(df: DataFrame, keep: list[str] = [], wave: str | None = None) -> DataFrame:  # noqa: B006
    """Doubles as floats, longs as the narrowest whole numbers that hold them, a wave as text; columns in `keep` as they are. One aggregation."""
    whole = [n for n, t in df.dtypes if t in ("bigint", "int", "smallint") and n not in keep]
    b = df.agg(*(f(n).alias(f"{k}{i}") for i, n in enumerate(whole) for k, f in (("a", F.min), ("b", F.max)))).first() if whole else None
    made = {}
    for i, n in enumerate(whole):
        low, high = (b[f"a{i}"] or 0, b[f"b{i}"] or 0)
        made[n] = F.col(n).cast(next(t for t, k in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(1 << k) <= low and high < 1 << k))
    made |= {n: F.col(n).cast("float") for n, t in df.dtypes if t == "double" and n not in keep}
    if wave:
        made[wave] = F.col(wave).cast("string")
    return df.withColumns(made) if made else df


def export_entities(df: DataFrame, path: str, kind: str = "csv") -> None:
    """An entity table as a folder of CSV, GeoJSON lines, JSON lines or Parquet."""
    if kind == "geojson":
        write_geojson(json_fit(df), path)
    elif kind == "csv":
        json_fit(df).write.mode("overwrite").option("header", True).csv(path)
    elif kind == "json":
        json_fit(df).write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("kind is csv, geojson, json or parquet")


def write_record(spark: SparkSession, folder: str, about: dict) -> None:
    """A run's record: one row of JSON."""
    spark.createDataFrame([(json.dumps(plain(about), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def read_record(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(folder).first()[0])


def write_points(df: DataFrame, folder: str, cluster: str, about: dict, x: str = "x", y: str = "y") -> dict:
    """A street survey: the points by cluster (one folder each), as GeoJSON lines, and the record with counts by cluster."""
    df.write.mode("overwrite").partitionBy(cluster).parquet(f"{folder}/points")
    write_geojson(json_fit(df), f"{folder}/geojson", x, y)
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    sizes.write.mode("overwrite").parquet(f"{folder}/index")
    total = sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("points")).first()
    record = about | {"clusters": total.clusters, "points": total.points or 0}
    write_record(df.sparkSession, f"{folder}/record", record)
    return record


def write_mosaics(tiles: DataFrame, folder: str, order: str, cluster: str = "cluster_id", about: dict | None = None) -> DataFrame:
    """Tiles of pixels (cluster, row, col, value) as one mosaic for each cluster, in list order, and an index (cluster, pixels, bounds)."""
    merged = tiles.groupBy(cluster, "row", "col").agg(F.max_by(F.struct("value"), order).alias("v")).select(cluster, "row", "col", "v.value")
    merged.write.mode("overwrite").partitionBy(cluster).parquet(f"{folder}/mosaics")
    made = tiles.sparkSession.read.parquet(f"{folder}/mosaics")
    index = made.groupBy(cluster).agg(F.count("value").alias("pixels"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))
    index.write.mode("overwrite").parquet(f"{folder}/index")
    write_record(tiles.sparkSession, f"{folder}/record", (about or {}) | {"clusters": index.count()})
    return tiles.sparkSession.read.parquet(f"{folder}/index")


def write_tile(pixels: DataFrame, folder: str, tile: str, key: str) -> None:
    """One cache tile: its pixels in a folder of its name, in place of what was there of it, and its key."""
    pixels.withColumn("content", F.lit(key)).withColumn("tile", F.lit(tile)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(folder)


def record_tiles(manifest: DataFrame | None, tiles: DataFrame) -> DataFrame:
    """A manifest of cached tiles (tile, content, x0, y0, x1, y1) with the new ones in place of older ones of their names."""
    return tiles if manifest is None else manifest.join(tiles.select("tile").distinct(), "tile", "left_anti").unionByName(tiles.select(*manifest.columns))


def extend_store(required: DataFrame, stored: DataFrame | None, keys: list[str], compute, path: str, by: list[str]) -> DataFrame:
    """A long store of statistics with the required units: only those that aren't there are computed (compute: missing keys to rows) and written."""
    missing = required.select(*keys).distinct() if stored is None else required.select(*keys).distinct().join(stored.select(*keys).distinct(), keys, "left_anti")
    compute(missing).write.mode("append").partitionBy(*by).parquet(path)
    return required.sparkSession.read.parquet(path)
