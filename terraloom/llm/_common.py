"""What the corpus operators share: shared-folder tables, shipping the package to executors, bounded Arrow slices, salted look-ups."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Bytes of text that a Python worker holds as strings at once.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), a temporary one that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terraloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to, so that the shuffle files of ended steps are removed at once. Spark itself holds on to
    the last query that ran, so a tiny one comes first."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Remove the files of a materialised table that isn't needed any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.startswith(("file:", "hdfs:", "s3", "abfs", "gs:", "/")) and shared_dir(spark).split(":")[-1].lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_terraloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    fd, path = tempfile.mkstemp(prefix="terraloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "terraloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(path)
    context._terraloom_shipped = True


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) runs of about `limit` bytes, at least one row each; a null text is empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield start, [t or "" for t in texts.slice(start).to_pylist()]


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of whole numbers of a column; a null one is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]) if len(sizes) else []


#: What `settled` says of a row: bits of the caller's, or OPEN where the task had too many rows to tell.
DONE, RIM, OPEN = 1, 2, 4


def settled(rows: DataFrame, by: str, decide: Callable[[pa.Table], pa.Table], most: int) -> DataFrame:
    """What `decide` makes of all rows of each value of `by`, several values at once, with a column `state`; one shuffle, without a sort or a join
    of Spark's. `decide` keeps the columns. A task that gets more than `most` bytes (a frequent value, large partitions) holds no more than those:
    it gives its rows back as OPEN, for groupings that spill."""
    ship(rows.sparkSession)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rest = [], 0, iter(batches)
        for batch in rest:
            held.append(batch)
            size += batch.nbytes
            if size > most:
                for b in chain(held, rest):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, OPEN, np.int32))], [*b.schema.names, "state"])
                return
        if held:
            yield from decide(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return rows.repartition(by).mapInArrow(keep, StructType([*rows.schema.fields, StructField("state", IntegerType())]))


def is_open(table: DataFrame) -> bool:
    return not table.where(F.col("state") == OPEN).isEmpty()


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def salt(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def attach(rows: DataFrame, values: DataFrame, key: list[str], by: Column, salts: int = 64) -> DataFrame:
    """Left join of `values` (unique in `key`) to `rows`, whose keys may be hot: only the (key, salt) pairs that occur are spread, so a key
    that holds a third of all rows goes to `salts` tasks."""
    salted = rows.withColumn("__salt", salt(by, salts))
    spread = salted.select(*key, "__salt").distinct().join(values, key)
    return salted.join(spread, [*key, "__salt"], "left").drop("__salt")
