"""Operator 2, exact deduplication: keyed state on disk, without expiry, fed by micro-batches.

The state keeps, for each text seen, its SHA-256 digest, the stable identifier of the row and a content locator (file and row in it). When a
digest is met again, the whole text is compared with the text at the locator that the state has for it; a text of the same digest but other
bytes becomes a class of its own (its `variant` is the text itself), so results never rest on a digest alone.

Everything on the path is DataFrame operations. Only digests, identifiers and locators are kept; texts move once, to be compared, and of
those only the ones whose digest occurs twice go further. Digests that hold a large share of all rows are spread over salts.

Cases: a null text counts as empty; a null identifier is lower than any other; of rows equal in identifier too, the one with the largest
locator stays; an empty table gives an empty result; other columns are never read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ._common import attach, col, materialise, release, salt, work_path

SALTS = 64
LOCATOR = "__locator"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def with_locator(docs: DataFrame) -> DataFrame:
    """docs with the locator of each row; rows that come from no file are first written to the shared folder."""
    try:
        return docs.withColumn(LOCATOR, F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))
    except AnalysisException:
        return with_locator(materialise(docs, "content"))


class ExactDedupState:
    """State in the folder `path`: arrivals, representatives and variants, each a Parquet table with one folder for each batch, which a
    repeated batch overwrites (so each batch counts once). `content` is where the texts of earlier batches can be read by their locators; a
    second batch can't be taken without it, and a locator that it doesn't have is an error."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", content: DataFrame | None = None, digest: Callable[[Column], Column] = sha256, salts: int = SALTS):
        self.spark, self.path, self.id_col, self.text_col, self.content, self.digest, self.salts = spark, path, id_col, text_col, content, digest, salts

    def _table(self, name: str) -> DataFrame | None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return self.spark.read.option("recursiveFileLookup", "true").schema(self._schemas[name]).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch-{batch}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}/batch-{batch}")

    def _earlier(self, name: str, batch: int) -> DataFrame | None:
        """A table without the folder of this batch, which is there when a batch is repeated."""
        table = self._table(name)
        return None if table is None else table.where(~F.col("_metadata.file_path").contains(f"/{name}/batch-{batch}/"))

    def _rows(self, batch: DataFrame) -> DataFrame:
        return batch.select(F.col(self.id_col).cast("long").alias("id"), F.col(LOCATOR).alias("locator"), F.coalesce(F.col(self.text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", self.digest(F.col("text")))

    _schemas: dict[str, str] = {"arrivals": "id long, locator string, digest binary", "representatives": "digest binary, locator string, batch int", "variants": "locator string, digest binary, variant string"}

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch; batch has the locator column (with_locator). Fit for foreachBatch."""
        rows = self._rows(batch)
        known = self._earlier("representatives", batch_id)
        if known is not None and self.content is None:
            raise ValueError("after the first batch, texts are compared with earlier ones: give `content`, the rows with their locators")
        arrivals = self._write(rows.select("id", "locator", "digest"), "arrivals", batch_id)
        groups = arrivals.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "locator")).alias("last"), F.collect_set(salt(F.col("locator"), self.salts)).alias("salts"))
        if known is None:
            joined = groups.select("digest", "n", "salts", F.col("last.locator").alias("rep"), F.lit(False).alias("old"))
        else:
            joined = groups.join(known.select("digest", "locator"), "digest", "left").select("digest", "n", "salts", F.coalesce("locator", "last.locator").alias("rep"), F.col("locator").isNotNull().alias("old"))
        joined = materialise(joined, "groups")
        self._write(joined.where(~F.col("old")).select("digest", F.col("rep").alias("locator"), F.lit(batch_id).alias("batch")), "representatives", batch_id)
        hits = joined.where((F.col("n") > 1) | F.col("old"))
        spread = hits.select("digest", "rep", "old", "salts", F.explode("salts").alias("salt"))
        # whole texts of the hits alone; each is then compared with its representative's
        held = materialise(rows.withColumn("salt", salt(F.col("locator"), self.salts)).join(spread, ["digest", "salt"]), "hits")
        stored = held.where(F.col("locator") == F.col("rep")).select("digest", F.explode("salts").alias("salt"), F.col("text").alias("stored"))
        if known is not None:
            old = self._rows(self.content).select("locator", F.col("text").alias("stored"))
            wanted = hits.where("old").select("digest", "salts", F.col("rep").alias("locator"))
            stored = stored.unionByName(old.join(wanted, "locator").select("digest", F.explode("salts").alias("salt"), "stored"))
        checked = held.where(F.col("locator") != F.col("rep")).join(stored, ["digest", "salt"], "left")
        same = F.when(F.col("stored").isNull(), F.raise_error(F.concat(F.lit("no text at the locator "), "rep"))).otherwise(F.col("text") == F.col("stored"))
        self._write(checked.where(~same).select("locator", "digest", F.col("text").alias("variant")), "variants", batch_id)

    def result(self) -> DataFrame:
        """id, locator, digest, keep_id, group_size, kept of every row so far."""
        arrivals = self._table("arrivals")
        if arrivals is None:
            return self.spark.createDataFrame([], StructType.fromDDL("id long, locator string, digest binary, keep_id long, group_size long, kept boolean"))
        variants = self._table("variants")
        if variants is not None and not variants.isEmpty():
            arrivals = arrivals.join(variants.select("locator", "variant"), "locator", "left")
        else:
            arrivals = arrivals.withColumn("variant", F.lit(None).cast("string"))
        release(self.spark)
        # the variant is null for all but texts of one digest and different bytes
        arrivals = arrivals.withColumn("class", F.concat(F.col("digest"), F.coalesce(F.encode(F.concat(F.lit("+"), "variant"), "UTF-8"), F.lit(b""))))
        totals = arrivals.groupBy("class").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "locator")).alias("last"))
        out = attach(arrivals, totals, ["class"], F.col("locator"), self.salts)
        return out.select("id", "locator", "digest", F.col("last.id").alias("keep_id"), "group_size", (F.col("last.locator") == F.col("locator")).alias("kept"))


def stream_dedup(spark: SparkSession, source: str, schema: StructType, path: str | None = None, files_per_batch: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> ExactDedupState:
    """Run all files that are in `source` (a folder or a file) and not yet in the state through it, as a stream that ends when it has them all.
    The state and the stream's offsets are in `path`; a later call with the same path goes on from there. Without files_per_batch all files
    that are there are one micro-batch; each further one reads the texts that its hits are compared with again."""
    path = path or work_path(spark, "exact-dedup")
    where = f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"  # as a pattern, so that it may also be a single file
    content = with_locator(spark.read.schema(schema).parquet(source))
    state = ExactDedupState(spark, f"{path}/state", id_col, text_col, content)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = with_locator(reader.parquet(where)).writeStream.foreachBatch(state.process_batch).option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return state


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs with their locators, and the state's result for them, as one batch."""
    docs = with_locator(docs)
    state = ExactDedupState(docs.sparkSession, work_path(docs.sparkSession, "exact-dedup"), id_col, text_col)
    state.process_batch(docs, 0)
    return docs, state.result()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row, which stays, has."""
    located, result = dedup(docs, id_col, text_col)
    gone = result.where(~F.col("kept")).select(F.col("locator").alias(LOCATOR))
    return located.join(gone, LOCATOR, "left_anti").select(*map(col, docs.columns))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = f"{sf_dir}/documents.parquet"
    state = stream_dedup(spark, source, spark.read.parquet(source).select("doc_id", "text").schema)
    return state.result().select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
