"""What changed between two versions of a circular's obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """added, superseded, modified or unchanged for each obligation_id; `terms` is what may change without a new id.

    Versions have obligation_id and terms, one row for each id.
    """
    a = old.select("obligation_id", F.col("terms").alias("old_terms"), F.lit(True).alias("_old"))
    b = new.select("obligation_id", F.col("terms").alias("new_terms"), F.lit(True).alias("_new"))
    kind = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "superseded")
        .when(~F.col("old_terms").eqNullSafe(F.col("new_terms")), "modified").otherwise("unchanged")
    )
    return a.join(b, "obligation_id", "full_outer").withColumn("change", kind).drop("_old", "_new")


def listed_but_absent(changes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Paragraphs that a change list names, and how many clauses have each path (0: named, not found)."""
    named = changes.select("doc_id", F.explode("referenced_paras").alias("para")).distinct()
    paths = clauses.select("doc_id", F.regexp_replace(F.regexp_replace("clause_path", r"^[IVXL]+\.", ""), "#.*$", "").alias("para"))
    return named.join(paths.groupBy("doc_id", "para").agg(F.count("*").alias("n")), ["doc_id", "para"], "left").fillna(0, ["n"])


def is_covered(listed: DataFrame) -> DataFrame:
    """For each document whether every paragraph that its change list names has a clause: named, missing and covered.

    `listed` is what `listed_but_absent` gives. A document whose list names nothing has no row.
    """
    missing = F.count(F.when(F.col("n") == 0, 1))
    return listed.groupBy("doc_id").agg(F.count("*").alias("named"), missing.alias("missing"), (missing == 0).alias("covered"))


def title_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Titles, in lower case, that only one of two versions has."""
    a, b = old.select(F.lower("title").alias("title")), new.select(F.lower("title").alias("title"))
    return a.subtract(b).withColumn("change", F.lit("removed")).unionByName(b.subtract(a).withColumn("change", F.lit("added")))
