"""Shared folders, materialised steps and column helpers for the corpus operators.

A step that is read more than once is written to the folder named by
``spark.checkpoint.dir`` and read back: a lost executor costs a re-read, not a
recomputation, and the plan that made the step (with its shuffle files) can go.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Bytes of an Arrow batch, about: rows of any length go to Python in pieces of this size.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limit the batches that Python gets by bytes, where the session has no lower limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH:
        spark.conf.set(key, str(BATCH))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, *spent: DataFrame) -> None:
    """Drop tables written by :func:`materialize` and let Spark's cleaner remove the
    shuffle files of plans that nothing refers to any more."""
    for df in spent:
        delete(spark, df._written_to)
    for _ in range(2):
        # The cleaner works beside us; what the first collection frees may free more.
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, tag)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Bits by which different texts of one id are told apart.
APART = 10


def told_apart(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs(doc_id, text, ...)`` with ids that name one text each, and by how many bits they
    are shifted: none, but where an id has several texts. These then count as documents of their own
    in the order of their hashes; rows that repeat id and text keep one id."""
    several = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    if several.where("n > 1 and lo <> hi").isEmpty():
        return docs, 0
    by_hash = Window.partitionBy("doc_id").orderBy("_h")
    rank = docs.select("doc_id", F.xxhash64("text").alias("_h")).distinct().withColumn("_r", F.row_number().over(by_hash) - 1)
    small = (F.abs("doc_id") < 1 << 62 - APART) & (F.col("_r") < 1 << APART)
    key = F.when(small, F.shiftleft("doc_id", APART) + F.col("_r")).otherwise(F.raise_error(F.lit("too many texts of one id, or too large an id")).cast("long"))
    return docs.withColumn("_h", F.xxhash64("text")).join(rank, ["doc_id", "_h"]).withColumn("doc_id", key).drop("_h", "_r"), APART


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker, which waits for the next task, returns what it freed to the machine."""

    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        if not gc.get_freeze_count():
            gc.freeze()  # modules stay, so the next tasks needn't go through them
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # a C library without it

    return after


def fold_ascii(column):
    """Lower-case A-Z only, whatever the locale and without touching other letters."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
