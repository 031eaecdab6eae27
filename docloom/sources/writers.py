"""Results as files: ground truth by document, canonical JSON, gap reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _only(fields: list[str]):
    return lambda row: F.struct(*[row[c].alias(c) for c in fields])


def blocks(documents: DataFrame, tables: dict[str, tuple[DataFrame, tuple[str, ...], str]]) -> DataFrame:
    """One row for each document with an array of each table's rows: name -> (table, order, row type as DDL).

    A block that a document lacks is an empty array, not a null.
    """
    out = documents.select("doc_id")
    for name, (table, order, ddl) in tables.items():
        empty = F.from_json(F.lit("[]"), f"array<struct<{ddl}>>")
        fields = table.sparkSession.createDataFrame([], ddl).columns
        row = F.struct(*[F.col(c).alias(f"_{c}") for c in order], *fields)
        listed = table.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias(name))
        block = listed.select("doc_id", F.transform(name, _only(fields)).alias(name)).hint("merge")  # else small files of many rows are taken for a small table and pass the driver
        out = out.join(block, "doc_id", "left").withColumn(name, F.coalesce(name, empty))
    return out


def ground_truth(documents: DataFrame, index: DataFrame, changes: DataFrame, appendix: DataFrame) -> DataFrame:
    """One row for each document with three arrays; a block that a document lacks is an empty array, not a null."""
    out = documents.select("doc_id")
    orders = {"toc": (index, ("block", "start_page", "section_no")), "annexure_a": (changes, ("s_no",)), "appendix": (appendix, ("page_no", "row_no"))}
    for name, (table, order) in orders.items():
        fields = [c for c in table.columns if c != "doc_id"]
        row = F.struct(*[F.col(c).alias(f"_{c}") for c in order if c in fields], *fields)
        listed = table.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias(name))
        out = out.join(listed.select("doc_id", F.transform(name, _only(fields)).alias(name)), "doc_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), out.schema[name].dataType.simpleString())))
    return out


def write_ground_truth(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def canonical_json(rows: DataFrame, *leave_out: str) -> DataFrame:
    """`rows` with canonical (sorted keys, compact, nulls kept) and its SHA-256 in dom_hash; volatile columns left out.

    Keys of nested objects are sorted too: the variant type keeps them so.
    """
    fields = sorted(c for c in rows.columns if c not in {*leave_out, "dom_hash", "ingested_at"})
    text = F.to_json(F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))
    return rows.withColumn("canonical", text).withColumn("dom_hash", F.sha2("canonical", 256))


def report_lines(manifest: DataFrame, gaps: DataFrame) -> DataFrame:
    """Lines of a text report: pages and sections of each document, its first gaps, and how many more there are."""
    head = manifest.select("doc_id", F.lit(0).alias("nth"), F.format_string("pages %d/%d  sections %d/%d", "pages_parsed", "total_pages", "sections_found", "sections_expected").alias("line"))
    body = gaps.select("doc_id", "nth", F.format_string("p%d %s %s", "page", "reason", F.left("detail", F.lit(74))).alias("line"))
    rest = gaps.groupBy("doc_id").agg(F.max("more").alias("more"), F.max("nth").alias("nth")).where("more > 0").select("doc_id", (F.col("nth") + 1).alias("nth"), F.format_string("… %d more", "more").alias("line"))
    return head.unionByName(body).unionByName(rest).orderBy("doc_id", "nth")
