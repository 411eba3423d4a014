"""Reading and writing: tables, aliased columns, vector files, metrics by channel and wave, fingerprints, caches, shards."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions.composites import ALIASES, resolve

SUFFIXES = {".geojson": "geojson", ".json": "geojson", ".gpkg": "gpkg", ".parquet": "parquet", ".csv": "csv", ".tif": "raster", ".tiff": "raster"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def format_of(path: str) -> str:
    kind = SUFFIXES.get(Path(path).suffix.lower())
    if kind is None:
        raise ValueError(f"no reader for {path}: one of {', '.join(SUFFIXES)} is needed")
    return kind


def is_raster(path: str) -> bool:
    return format_of(path) == "raster"


def field_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the columns, from the schema alone."""
    return [c for c in read(spark, path).columns if c != "geometry"]


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as rows: the properties, the geometry as JSON text, and x, y of points."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode("features").alias("f"))
    props = rows.schema["f"].dataType["properties"].dataType.fieldNames() if "properties" in rows.schema["f"].dataType.fieldNames() else []
    point = F.when(F.col("f.geometry.type") == "Point", F.from_json(F.to_json("f.geometry.coordinates"), "array<double>"))
    return rows.select(*(F.col(f"f.properties.`{p}`").alias(p) for p in props), F.to_json("f.geometry").alias("geometry"), F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y"))


def layer_names(path: str) -> list[str]:
    """Layers of a GeoPackage, which is an SQLite file."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [r[0] for r in con.execute("select table_name from gpkg_contents order by table_name")]


def read_gpkg(spark: SparkSession, path: str, layer: str | None = None, rows: int = 100_000) -> DataFrame:
    """A layer's attributes and the well-known binary of its geometry (the package's header is cut off). The driver reads the layer's columns and the
    bounds of its row numbers; tasks read ranges of them, so the file must lie where executors can open it."""
    import pandas as pd

    layer = layer or layer_names(path)[0]
    kinds = {"INT": "long", "REAL": "double", "DOUB": "double", "FLOA": "double", "BLOB": "binary", "BOOL": "boolean"}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        info = con.execute(f'pragma table_info("{layer}")').fetchall()
        low, high = con.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{layer}"').fetchone()
    geometry = next((c[1] for c in info if c[1] in ("geom", "geometry", "the_geom")), None)
    kind = lambda c: "binary" if c[1] == geometry else next((v for k, v in kinds.items() if (c[2] or "").upper().startswith(k) or k in (c[2] or "").upper()), "string")
    names = [c[1] for c in info]
    envelope = (0, 32, 48, 48, 64)
    cut = lambda b: None if b is None else bytes(b[8 + envelope[(b[3] >> 1) & 7] :])

    def take(frames):
        for frame in frames:
            for first in frame["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    found = con.execute(f'select * from "{layer}" where rowid between ? and ?', (int(first), int(first) + rows - 1)).fetchall()
                out = pd.DataFrame(found, columns=names, dtype=object)
                if geometry:
                    out[geometry] = out[geometry].map(cut)
                yield out

    out = spark.range(low, high + 1, rows, max(1, -(-(high - low + 1) // rows))).mapInPandas(take, ", ".join(f"`{c[1]}` {kind(c)}" for c in info))
    return out.withColumnRenamed(geometry, "geometry") if geometry else out


def read(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    kind = format_of(path)
    if kind == "geojson":
        return read_geojson(spark, path)
    if kind == "gpkg":
        return read_gpkg(spark, path, layer)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    from .geotiff import read_geotiff

    return read_geotiff(spark, path)


def read_many(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    return {Path(p).stem: read(spark, p) for p in paths}


def merge(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def metric(df: DataFrame, channel: str, wave: str | None = None) -> DataFrame:
    """(channel, wave, mx, my, value) of a channel's column under its accepted names; others are an error, never guessed."""
    column = resolve(df.columns, channel)
    return df.select(F.lit(channel).alias("channel"), F.lit(wave).alias("wave"), F.col("x").alias("mx"), F.col("y").alias("my"), F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("value"))


def metrics(spark: SparkSession, sources: dict[tuple[str, str | None], str]) -> DataFrame:
    """Metrics of all (channel, wave) paths as one table."""
    used = [n for c in {c for c, _ in sources} for n in ALIASES[c]]
    if len(set(used)) != len(used):
        raise ValueError("two channels share a name")
    return merge([metric(read(spark, p), c, w) for (c, w), p in sources.items()])


def geometry_digest(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Digest of a layer's geometries whatever their order: the rows' digests are added up in eight lanes of 32 bits, with partial sums, and the sums
    and the number of rows hashed. No task holds more than a row."""
    h = df.select(F.sha2(F.col(geometry).cast("binary"), 256).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(18,0)")).cast("string") for i in range(8)]
    return h.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *(F.coalesce(v, F.lit("0")) for v in lanes)), 256).alias("digest"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, size:time) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")).alias("fingerprint"))


def drift(now: DataFrame, stored: DataFrame) -> DataFrame:
    """ok, modified or missing for each stored path; new for the others."""
    both = stored.select("path", F.col("fingerprint").alias("was")).join(now, "path", "full")
    return both.select("path", F.when(F.col("fingerprint").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("fingerprint"), "ok").otherwise("modified").alias("status"))


def parse_panoramas(df: DataFrame, message: str) -> DataFrame:
    """Panoramas of JSON messages with nested dated captures, a row for each capture."""
    shape = "struct<id:string,lat:double,lon:double,captures:array<struct<id:string,date:array<int>>>>"
    m = df.select(F.from_json(message, shape).alias("m")).where("m.id is not null")
    rows = m.select(F.col("m.id").alias("pano_id"), F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"), F.explode_outer("m.captures").alias("c"))
    return rows.select("pano_id", "lat", "lon", F.col("c.id").alias("capture_id"), F.get("c.date", F.lit(0)).alias("year"), F.get("c.date", F.lit(1)).alias("month"))


def upsert(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cache rows without the new keys, and the new rows."""
    return cache.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def evict(cache: DataFrame, limit: int, size: str = "bytes", used: str = "last_access", key: str = "tile") -> DataFrame:
    """Most recently used entries whose sizes add up to the limit at most."""
    from terraloom.operators.splits import running

    return running(cache, [F.desc(used), F.col(key)], F.col(size), "_upto").where(F.col("_upto") <= limit).drop("_upto")


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    df.write.mode("overwrite").partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, shards: int, shard: str = "shard") -> DataFrame:
    """All shards; names the ones that are missing."""
    df = spark.read.parquet(path)
    have = {r[0] for r in df.select(shard).distinct().collect()}
    if missing := sorted(set(range(shards)) - have):
        raise FileNotFoundError(f"shards {missing} are missing")
    return df


def persist_unit(df: DataFrame, path: str, by: list[str]) -> None:
    """Statistics of a unit (channel, wave), in place of what was there of that unit alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def entity_table(entities: DataFrame, composite: DataFrame, key: str) -> DataFrame:
    """One row for each target entity, composite or not."""
    return entities.join(composite, key, "left")


def write_geojson(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """Features, one in each line."""
    props = F.struct(*(c for c in df.columns if c not in (x, y)))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def write_report(tables: dict[str, DataFrame], folder: str, about: dict) -> None:
    """A folder of CSV for each table, and a manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    first = next(iter(tables.values()))
    first.sparkSession.createDataFrame([(json.dumps(about | {"tables": sorted(tables)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
