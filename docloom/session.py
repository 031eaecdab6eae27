"""Spark session with the settings that the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "docloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, master and sizes come from its own configuration."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


#: Rows and bytes of an Arrow batch as Spark sets them, and as texts need them: a batch is held several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(16 << 20))}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small where the session leaves them at Spark's defaults; settings of its own stay.

    A plan reads them when it runs, after the operator has returned it, so they can't be put back here.
    """
    for key, (default, small) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, small)
