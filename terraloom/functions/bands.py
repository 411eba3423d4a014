"""Vegetation index and masks of satellite scenes, as Column expressions over raw bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLOUD_CLASSES = (3, 7, 8, 9, 10, 11)
QA_BITS = 0b111000  # bits 3, 4 and 5: cloud, shadow, snow
OLI_SLOPE, OLI_SHIFT = {"red": 0.9047, "nir": 0.8462}, {"red": 0.0061, "nir": 0.0412}
SENSORS = (("LC09", "oli", False), ("LC08", "oli", False), ("LE07", "tm", True), ("LT05", "tm", False))


def normalized_difference(nir: Column, red: Column) -> Column:
    """(nir - red) / (nir + red); null where a band is negative or both are 0."""
    return F.when((nir >= 0) & (red >= 0) & (nir + red != 0), (nir - red) / (nir + red))


def qa_clear(qa: Column) -> Column:
    return qa.bitwiseAND(F.lit(QA_BITS)) == 0


def bits_clear(qa: Column, *bits: int) -> Column:
    return qa.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def s2_surface(nir: Column, red: Column, scl: Column, mask: bool = True) -> Column:
    v = normalized_difference(nir * 1e-4, red * 1e-4)
    return F.when(~scl.isin(*CLOUD_CLASSES), v) if mask else v


def s2_toa(nir: Column, red: Column, qa60: Column, mask: bool = True) -> Column:
    v = normalized_difference(nir * 1e-4, red * 1e-4)
    return F.when(bits_clear(qa60, 10, 11), v) if mask else v


def landsat_oli(nir: Column, red: Column, qa: Column, mask: bool = True) -> Column:
    v = normalized_difference(nir * 2.75e-5 - 0.2, red * 2.75e-5 - 0.2)
    return F.when(qa_clear(qa), v) if mask else v


def landsat_tm(nir: Column, red: Column, qa: Column, mask: bool = True) -> Column:
    """Thematic mapper reflectances, brought to the newer sensor's by slope and shift."""
    to = lambda band, c: (c * 2.75e-5 - 0.2) * OLI_SLOPE[band] + OLI_SHIFT[band]
    v = normalized_difference(to("nir", nir), to("red", red))
    return F.when(qa_clear(qa), v) if mask else v


def landsat_toa(nir: Column, red: Column, qa: Column, sensor: str = "oli", mask: bool = True) -> Column:
    if sensor == "tm":
        nir, red = (c * OLI_SLOPE[b] + OLI_SHIFT[b] for b, c in (("nir", nir), ("red", red)))
    v = normalized_difference(nir, red)
    return F.when(qa_clear(qa), v) if mask else v


def mask_water(value: Column, occurrence: Column, share: float = 50.0) -> Column:
    """Null where water is there in `share` per cent of the time or more; no record is none."""
    return F.when(F.coalesce(occurrence, F.lit(0.0)) < share, value)


def class_share(mask: Column, *classes: int) -> Column:
    """Share of an array's elements that are one of the classes."""
    return F.when(F.size(mask) > 0, F.size(F.filter(mask, lambda x: x.isin(*classes))) / F.size(mask))


def landsat_sensors(spark: SparkSession, sensors: str = "all", reflectance: str = "surface") -> DataFrame:
    """(sensor, prep, before_failure), old to new: which band arithmetic a sensor's scenes take, and whether only those from before its scan line
    corrector failed count. `no_slc_off` leaves the striped scenes and the newest sensor out. A dimension table of four rows."""
    if sensors not in ("all", "no_slc_off") or reflectance not in ("surface", "toa"):
        raise ValueError("sensors is 'all' or 'no_slc_off', reflectance 'surface' or 'toa'")
    careful = sensors == "no_slc_off"
    kind = "" if reflectance == "surface" else "_toa"
    rows = [(i, name, f"{prep}{kind}", careful and striped) for i, (name, prep, striped) in enumerate(reversed(SENSORS))]
    return spark.createDataFrame([r for r in rows if not careful or r[1] != "LC09"], "age int, sensor string, prep string, before_failure boolean")


def landsat_scenes(scenes: DataFrame, sensors: DataFrame, start: Column, end: Column, failed: str = "2003-06-01") -> DataFrame:
    """Scenes of a half-open window from the sensors of a set, without band arithmetic: for counting. The four sensors are broadcast."""
    kept = scenes.where((F.col("ts") >= start) & (F.col("ts") < end)).join(F.broadcast(sensors), "sensor")
    return kept.where(~F.col("before_failure") | (F.col("ts") < F.to_date(F.lit(failed))))


def pick_satellite(end: Column, satellite: str = "auto", begin: str = "2017-03-28") -> Column:
    """Landsat for a window that ends (half-open) before the newer satellite's collection begins; any explicit choice stays."""
    return F.lit(satellite) if satellite != "auto" else F.when(end <= F.to_date(F.lit(begin)), "landsat").otherwise("sentinel2")
