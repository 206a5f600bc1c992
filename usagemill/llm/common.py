"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts write it.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for checkpoints; a local session without one gets a folder under /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/usagemill-checkpoints"


#: With this, Spark removes a query's shuffle files when the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> None:
    """Delete path when the driver ends, if nothing has deleted it before."""
    at, system = _path(spark, path)
    system.deleteOnExit(at)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, so a lost executor costs no recomputation.

    Once the table is written, the shuffle files that led to it are of no use and go at once. The table goes with
    release(), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    passing(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no plan to come reads."""
    for t in tables:
        at, system = _path(t.sparkSession, t._staged)
        system.delete(at, True)


def joined_stats(big: DataFrame, stats: DataFrame, key: str, how: str = "inner", most: int = 100_000, salts: int = 16) -> DataFrame:
    """big ⋈ stats, with one stats row for each key; null keys match each other.

    stats is broadcast only when it has been counted to have at most ``most`` rows. Beyond that, both sides are
    shuffled on (key, salt), so that a key with a third of all rows is dealt to ``salts`` tasks.
    """
    other = stats.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if stats.limit(most + 1).count() <= most:
        return big.join(F.broadcast(other), same, how).drop("_key")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns[:2]), F.lit(salts)))
    other = other.withColumn("_salt2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(other, same & (F.col("_salt") == F.col("_salt2")), how).drop("_key", "_salt", "_salt2")


#: Rows that go to a Python worker at a time. Rows of text are large.
ROWS = 256


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session hands at most ROWS rows at a time to a Python worker from now on.

    Spark takes the number when a plan runs and not when it is built, so it is the same for all operators.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; nulls count as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, most: int = 4_000_000):
    """Slices of an Arrow batch with at most about ``most`` bytes each (one row may have more)."""
    data = batch.nbytes
    step = max(1, int(batch.num_rows * most / max(data, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same for texts that are all ASCII, and faster."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))


def text_hash() -> Column:
    """Tells apart rows that share a doc_id, or have none, with different texts."""
    return F.xxhash64(F.col("text").cast("string"))


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
