"""Shared helpers: tables in the shared folder, small Arrow batches, row hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import BATCH, bounded_batches  # noqa: F401  (operators over texts take them from here)

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (as in tests) gets a folder of its own; a cluster is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        root = _fallback.setdefault(key, tempfile.mkdtemp(prefix="docloom-"))
    return root.rstrip("/")


class Stored:
    """A table written to the shared folder; `df` reads it, `drop()` removes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/docloom/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> Stored:
    """Cut lineage: write `df` as a table in the shared folder, which outlives lost executors."""
    return Stored(df, name)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that nothing refers to any more.

    Spark does so when the driver's JVM collects its garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that what a task makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def crc32_text(col: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes."""
    return F.crc32(col.cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
