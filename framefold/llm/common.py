"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on local masters alone an own one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="framefold-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a table that cuts lineage, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lost executors don't lose it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Spark's setting that deletes a query's shuffle files, on all executors, when the query is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, queries that are over leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def blocks(spark: SparkSession) -> int:
    """How many blocks work is dealt to; follows the cluster's shuffle setting, which follows the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text falls in the fold; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice has about `limit` bytes of text, and one row at least."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


#: Up to so many keys are chosen to be dealt evenly; more are even enough by themselves.
CHOSEN_KEYS = 4096


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n ints, the k-th of which hash partitioning into n partitions sends to the k-th."""
    if n > CHOSEN_KEYS:
        return list(range(n))
    tried = 16 * n + 64
    while True:
        key = F.col("id").cast("int")
        rows = spark.range(tried).groupBy(F.pmod(F.hash(key), F.lit(n)).alias("part")).agg(F.min(key).alias("key")).collect()
        if len(rows) == n:
            return [r["key"] for r in sorted(rows, key=lambda r: r["part"])]
        tried *= 2


def dealt_key(hashed: Column, keys: list[int]) -> Column:
    """The key, of `even_keys`, that a long hash is dealt to."""
    at = F.pmod(hashed, F.lit(len(keys))).cast("int")
    return at if len(keys) > CHOSEN_KEYS else F.element_at(F.array(*map(F.lit, keys)), at + 1)
