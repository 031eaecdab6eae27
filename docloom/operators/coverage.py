"""What a document's parse covered: summaries, recall, gaps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def index_summary(index: DataFrame) -> DataFrame:
    """Entries, distinct keys, counts by block, parts in order of appearance and distinct numbers of each document."""
    parts = index.where("part != ''").groupBy("doc_id", "part").agg(F.min("row_no").alias("at")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    named = parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["part"]), ",").alias("parts"))
    sums = index.groupBy("doc_id").agg(
        F.count("*").alias("entries"), F.count_distinct(F.struct("block", "part", "section_no")).alias("unique_keys"), F.count(F.when(F.col("block") == "body", 1)).alias("body"),
        F.count(F.when(F.col("block") == "annexure", 1)).alias("annexure"), F.count_distinct("section_no").alias("section_numbers"),
    )
    return sums.join(named, "doc_id", "left").withColumn("parts", F.coalesce("parts", F.lit("")))


def manifest(pages: DataFrame, index: DataFrame, spans: DataFrame, gaps: DataFrame) -> DataFrame:
    """Coverage of each document: pages, parsed pages, expected and found sections, recall, pages with gaps."""
    seen = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count(F.when(F.regexp_replace("text", r"\s+", "") != "", 1)).alias("pages_parsed"))
    expected = index.where("block = 'body'").groupBy("doc_id").agg(F.count("*").alias("sections_expected"))
    located = spans.where("char_start is not null").groupBy("doc_id").agg(F.count("*").alias("sections_found"))
    joined = seen.join(expected, "doc_id", "left").join(located, "doc_id", "left").join(eligible_pages(gaps), "doc_id", "left")
    filled = joined.fillna(0, ["sections_expected", "sections_found"]).fillna("", ["gap_pages"])
    recall = F.when(F.col("sections_expected") == 0, 0.0).otherwise(F.round(F.col("sections_found") / F.col("sections_expected"), 4))
    return filled.withColumn("section_recall", recall)


def eligible_pages(gaps: DataFrame) -> DataFrame:
    """Sorted distinct pages with gaps."""
    return gaps.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("page")), ",").alias("gap_pages"))


def all_gaps(document: DataFrame, contents: DataFrame, segmentation: DataFrame, documents_without_annexure: DataFrame) -> DataFrame:
    """Gaps of all stages, in stage order."""
    absent = documents_without_annexure.select("doc_id", F.lit(0).alias("page"), F.lit("missing_annexure").alias("reason"), F.lit("no change list").alias("detail"))
    stages = [document, contents, segmentation, absent]
    out = None
    for k, gaps in enumerate(stages):
        part = gaps.select(F.lit(k).alias("stage"), "doc_id", "page", "reason", "detail")
        out = part if out is None else out.unionByName(part)
    return out


def report_gaps(gaps: DataFrame, most: int = 6) -> DataFrame:
    """The first gaps of each document by stage and page, and how many more there are."""
    order = Window.partitionBy("doc_id").orderBy("stage", "page", "reason", "detail")
    total = F.count("*").over(Window.partitionBy("doc_id"))
    ranked = gaps.withColumns({"nth": F.row_number().over(order), "more": F.greatest(total - most, F.lit(0))})
    return ranked.where(F.col("nth") <= most)
