"""Pages to documents: cleaning, running offsets, the page of an offset, front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.deadlines import month_date
from docloom.functions.text import bound, circular_number, collapse, dehyphenate, found, slug_intermediary

RUNNING_LINE = r"^\s*(?:Page\s+\d+\s+of\s+\d+|\d{1,4})\s*$"
SUBJECT = r"(?i)Subject\s*:\s*Master\s+Circular\s+for\s+([^\n]+)"
DATE = r"([A-Z][a-z]{2,8}\s+\d{1,2},\s*\d{4})\b"


def clean_page(text: Column) -> Column:
    """A page without running headers and footers, dehyphenated, ended by a line end."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.regexp_like(x, F.lit(RUNNING_LINE)))
    return F.concat(dehyphenate(F.array_join(lines, "\n")), F.lit("\n"))


def cell(row: Column, i: int) -> Column:
    """A table cell with collapsed white space; what is missing is empty."""
    return F.coalesce(collapse(F.get(row, F.lit(i))), F.lit(""))


def load_pages(raw: DataFrame) -> DataFrame:
    """doc_id, page_no, text (cleaned), tables, char_start and blank of raw pages; offsets count code points."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    cleaned = raw.withColumns({"blank": F.coalesce(F.regexp_replace("text", r"\s+", "") == "", F.lit(True)), "text": clean_page(F.col("text"))})
    return cleaned.withColumn("char_start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("bigint"))


def full_text(pages: DataFrame) -> DataFrame:
    """One text for each document; only for documents, never for a corpus."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def slices(pages: DataFrame) -> DataFrame:
    """`pages` with their document's full text in `whole` and what their offsets cut out of it in `slice`.

    One aggregate puts a document's text together in page order and keeps its pages beside it, so the text is not joined
    to each page; a document is one group, a corpus never is. A null text is an empty page. Pages have doc_id, page_no,
    text and char_start; other columns are left out.
    """
    page = F.struct("page_no", "char_start", "text")
    whole = F.expr("listagg(coalesce(text, ''), '') within group (order by page_no)")
    cut = F.transform("_pages", lambda p: p.withField("slice", F.substring("whole", (p["char_start"] + 1).cast("int"), F.coalesce(F.length(p["text"]), F.lit(0)))))
    return pages.groupBy("doc_id").agg(whole.alias("whole"), F.collect_list(page).alias("_pages")).withColumn("_page", F.explode(cut)).select("doc_id", "_page.*", "whole")


def page_of(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """`offsets` (doc_id, offset) with page_no: the page that holds it, else the document's last page.

    Pages tile their document, so this is an as-of lookup over one sort of both tables, not a range join.
    """
    marks = pages.select("doc_id", F.col("char_start").alias("offset"), "page_no", F.lit(0).alias("_kind"))
    asked = offsets.withColumns({"page_no": F.lit(None).cast("int"), "_kind": F.lit(1)})
    order = Window.partitionBy("doc_id").orderBy("offset", "_kind")
    both = asked.unionByName(marks, allowMissingColumns=True)
    last = F.max("page_no").over(Window.partitionBy("doc_id"))
    held = F.when(F.col("offset") >= 0, F.last("page_no", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.withColumn("page_no", F.coalesce(held, last)).where("_kind = 1").drop("_kind")


def parse_headers(front: DataFrame) -> DataFrame:
    """Header fields of front matter (doc_id, text), with `error` where a document is none of the known families."""
    text = F.col("text")
    dated = lambda lead, where=text: month_date(found(where, lead + DATE, 1))
    told = F.struct(
        circular_number(text).alias("number"), bound(found(text, SUBJECT, 1), lambda x: F.rtrim(F.regexp_replace(F.trim(x), r"\.+$", ""))).alias("label"),
        dated(r"(?i)Issued\s+on\s*:\s*").alias("issued"), dated(r"(?i)Last\s+updated\s+on\s*:\s*").alias("updated"),
    )
    earlier = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)Master\s+Circular\s+dated\s+" + DATE), 1), month_date)

    def fields(x: Column) -> Column:
        number, label = x["number"], x["label"]
        near = F.substring(text, F.position(number, text) + F.length(number), F.lit(120))

        def with_date(date: Column) -> Column:
            return F.struct(
                number.alias("circular_no"), date.alias("circular_date"), slug_intermediary(label).alias("intermediary"), label.alias("intermediary_label"),
                F.array_max(F.filter(earlier, lambda d: d < date)).alias("supersedes_date"), x["issued"].alias("issued_on"),
                F.when(number.isNull(), "circular_no").when(label.isNull(), "subject").when(date.isNull(), "circular_date").alias("error"),
            )

        return bound(F.coalesce(x["updated"], x["issued"], dated(r"\b", near), dated(r"\b")), with_date)

    return front.select("doc_id", bound(told, fields).alias("_x")).select("doc_id", "_x.*")


def version_chain(headers: DataFrame) -> DataFrame:
    """Each header with the number of the circular it supersedes: the one of the same intermediary and that date."""
    other = headers.select(F.col("intermediary").alias("_i"), F.col("circular_date").alias("_d"), F.col("circular_no").alias("supersedes_circular_no"))
    return headers.join(other, (F.col("intermediary") == F.col("_i")) & (F.col("supersedes_date") == F.col("_d")), "left").drop("_i", "_d")
