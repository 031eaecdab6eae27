"""Tables that cut lineage: written to the folder that driver and executors share, read again, and removed by who made them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, the warehouse, which all executors see as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/") + "/docloom"


class Scratch:
    """Tables of one computation; `drop` removes all but those that are kept."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        self.count = 0

    def path(self, name: str) -> str:
        """A place for a table of that name, to be removed with the others."""
        self.count += 1
        self.made.append(f"{self.root}/{self.count}-{name}")
        return self.made[-1]

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """`df` from a table, without its lineage."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Remove the tables made so far, but not the last `keep`."""
        gone, self.made = self.made[: len(self.made) - keep], self.made[len(self.made) - keep :]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
