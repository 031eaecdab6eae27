"""Change lists and appendices: where they begin and what their rows say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import CIRCULAR_ANY, found, page_refs, paragraph_refs
from docloom.operators.documents import cell

# Headings and cell shapes.
CHANGES = r"(?i)List of Changes"
ANNEXURE_A = r"(?im)^\s*Annexure\s*[-\x{2013}\x{2014}]?\s*A\s*$"
APPENDIX = r"(?i)APPENDIX\s*[-\x{2013}\x{2014}]?\s*LIST OF CIRCULARS"
SERIAL = r"^\s*(\d{1,3})\.?\s*$"
DATED = r"dated\s+([A-Z][a-z]+\s+\d{1,2},\s*\d{4})"


def register_pages(pages: DataFrame) -> DataFrame:
    """First page with both marks of a change list, and last page with the appendix heading; null where absent."""
    both = F.regexp_like("text", F.lit(CHANGES)) & F.regexp_like("text", F.lit(ANNEXURE_A))
    return pages.groupBy("doc_id").agg(F.min(F.when(both, F.col("page_no"))).alias("changes_page"), F.max(F.when(F.regexp_like("text", F.lit(APPENDIX)), F.col("page_no"))).alias("appendix_page"))


def table_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, row_no and cells of all table rows of pages, in page order."""
    return pages.select("doc_id", "page_no", F.posexplode(F.flatten("tables")).alias("row_no", "cells"))


def change_entries(rows: DataFrame) -> DataFrame:
    """Entries of change-list rows (with cells): every page and paragraph they refer to."""
    a, b, c = (cell(F.col("cells"), k) for k in range(3))
    kept = rows.withColumns({"_a": a, "_b": b, "_c": c}).where("_b != ''").where(~(F.lower("_a").startswith("s. no") | (F.lower("_b") == "changes")))
    both = F.concat_ws(" ", "_b", "_c")
    return kept.select(
        *[x for x in rows.columns if x != "cells"], found(F.col("_a"), SERIAL, 1).cast("int").alias("s_no"), F.col("_b").alias("description"), F.when(F.col("_c") != "", F.col("_c")).alias("page_para_ref"),
        found(F.col("_b"), CIRCULAR_ANY).alias("source_circular_no"), page_refs(both).alias("referenced_pages"), paragraph_refs(both).alias("referenced_paras"),
    )


def appendix_entries(pages: DataFrame, max_pages: int = 40) -> DataFrame:
    """Entries of the appendix, from its page on: pages without rows are passed over, the first page whose rows hold
    no entry, once there are entries, ends it.

    `pages` has doc_id, page_no, tables and appendix_page.
    """
    near = pages.where(f"doc_id is not null and page_no >= appendix_page and page_no < appendix_page + {max_pages}")
    a, b, c = (cell(F.col("cells"), k) for k in range(3))
    rows = table_rows(near).withColumns({"_a": a, "_b": b, "_c": c})
    real = (F.col("_b") != "") & ~(F.lower("_a").startswith("sr") | F.lower("_b").startswith("circular"))
    rows = rows.withColumn("_real", real)
    # Frames by page in one order of a document's rows: entries up to a row's page and before it, with no table of pages to join.
    order = Window.partitionBy("doc_id").orderBy("page_no")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    entries = F.sum(F.col("_real").cast("int"))
    rows = rows.withColumns({"_upto": entries.over(upto), "_seen": F.coalesce(entries.over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumn("_over", F.max((F.col("_upto") == F.col("_seen")) & (F.col("_seen") > 0)).over(upto))
    return rows.where("_real and not _over").select(
        "doc_id", "page_no", "row_no", found(F.col("_a"), SERIAL, 1).cast("int").alias("s_no"), F.col("_b").alias("circular_no"), found(F.col("_b"), DATED, 1).alias("circular_date"),
        F.col("_c").alias("subject"), F.lit(None).cast("string").alias("status"), F.regexp_replace("_b", r"\s*,?\s*dated\s.*$", "").alias("circular_no_only"),
    )


def appendix_completeness(entries: DataFrame) -> DataFrame:
    """Entries, distinct serial numbers and share of dated entries of each document."""
    return entries.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_distinct("s_no").alias("serials"), F.round(F.avg(F.col("circular_date").isNotNull().cast("int")), 4).alias("dated_share"))
