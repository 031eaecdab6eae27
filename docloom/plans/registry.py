"""The registry of queries: a Spark plan and, where SQL can express it, the statement to hold it against."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@dataclass(frozen=True)
class Tables:
    """The driver tables of one folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, statement: str) -> DataFrame:
        """A statement with table names in braces."""
        for name in TABLES:
            statement = statement.replace(f"{{{name}}}", f"parquet.`{self.folder}/{name}.parquet`")
        return self.spark.sql(statement)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables as a query under its name, with its SQL (table names in braces) if there is one."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = functools.reduce(lambda text, name: text.replace(f"{{{name}}}", name), TABLES, sql)
        return f

    return keep


def runnable() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries as functions of (spark, folder)."""
    return {name: (lambda spark, folder, f=f: f(Tables(spark, folder))) for name, f in QUERIES.items()}
