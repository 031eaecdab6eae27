"""Tables of contents: rows to the section index, and rows that only the text layer still has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import bound, clean_title, found
from docloom.operators.documents import cell

# Shapes of rows and lines.
PART = r"^\s*([IVXL]+)\.\s+([A-Z][A-Z &,/\-\.']{3,})\s*$"
SECTION_NO = r"^\s*(\d{1,3})\.?\s*$"
PAGE_NO = r"^\s*(\d{1,4})\s*$"
ANNEXURES = r"(?i)^\s*Annexures?\s*$"
CONTENTS = r"(?i)TABLE\s+OF\s+CONTENTS"
NUMBER_AND_PAGE = r"^\s*(\d{1,3})\.\s+(\d{1,4})\s*$"
NUMBER_ALONE = r"^\s*(\d{1,3})\.\s*$"
FULL_ROW = r"^\s*(\d{1,3})\.\s+(\S.*?)\s+(\d{1,4})\s*$"
TITLE_AND_PAGE = r"^(.*?)\s+(\d{1,4})\s*$"
PAGELESS_ROW = r"^\s*(\d{1,3})\.\s+(\S.*?)\s*$"


def like(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def looks_like_row(row: Column) -> Column:
    a, b = cell(row, 0), cell(row, 1)
    return (like(a, SECTION_NO) & (b != "")) | like(a, PART) | like(a, ANNEXURES)


def contents_pages(pages: DataFrame, search_limit: int = 20) -> DataFrame:
    """doc_id and page_no of the contiguous run of contents pages: the heading's, and those after it that look alike."""
    rows = F.flatten("tables")
    alike = F.size(F.filter(rows, looks_like_row))
    good = (F.size(rows) > 0) & (alike >= F.greatest(F.lit(2), F.floor(F.size(rows) / 4)))
    first = F.min(F.when(like(F.col("text"), CONTENTS) & (F.col("page_no") <= search_limit), F.col("page_no"))).over(Window.partitionBy("doc_id"))
    run = pages.withColumns({"_first": first, "_good": F.coalesce(good, F.lit(False))}).where("page_no >= _first and page_no <= _first + " + str(search_limit))
    so_far = F.min(F.when(F.col("page_no") == F.col("_first"), True).otherwise(F.col("_good"))).over(Window.partitionBy("doc_id").orderBy("page_no"))
    return run.withColumn("_run", so_far).where("_run").select("doc_id", "page_no")


def parse_rows(rows: DataFrame) -> DataFrame:
    """Section index of contents rows (doc_id, row_no, cells): block and part carried forward, annexures restarting both.

    Cells are read once for each row, whatever is asked of them.
    """

    def read(x: Column) -> Column:
        a, b = x["a"], x["b"]
        switch = like(a, ANNEXURES)
        part = F.when(~switch, F.coalesce(found(a, PART, 1), F.when(a == "", found(b, PART, 1))))
        number = F.when(b != "", found(a, SECTION_NO, 1).cast("int"))
        title, page = F.when(number.isNotNull(), clean_title(b)), F.coalesce(found(x["p"], PAGE_NO, 1).cast("int"), F.lit(0))
        blank = ((a == "") & (b == "")) | F.lower(a).startswith("s. no") | (F.lower(b) == "subject")
        return F.when(~blank, F.struct(switch.alias("switch"), part.alias("part_here"), number.alias("number"), title.alias("title"), page.alias("start_page")))

    cells = F.struct(*[cell(F.col("cells"), i).alias(x) for i, x in enumerate("abp")])
    # The outer form: the inner one, or a filter before it, would have the cells read again.
    kept = rows.select("doc_id", "row_no", F.inline_outer(F.array(bound(cells, read)))).where("switch is not null")
    order = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = kept.withColumn("annexed", F.max("switch").over(order))
    block = Window.partitionBy("doc_id", "annexed").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("part", F.last("part_here", ignorenulls=True).over(block))
    numbered = carried.where("number is not null and part_here is null")
    return numbered.select("doc_id", "row_no", F.when(F.col("annexed"), "annexure").otherwise("body").alias("block"), "part", F.col("number").alias("section_no"), "title", "start_page")


def recover_rows(pages: DataFrame) -> DataFrame:
    """Rows in the text of contents pages: wrapped (pass 1), complete (2) and without a page (3), with their line.

    Lines are read once, and rows of all passes come from one grouping of them: a group is a line that no wrapped title
    takes in and those after it up to the next one.
    """

    def read(s: Column) -> Column:
        kind = F.when(like(s, NUMBER_AND_PAGE) | like(s, NUMBER_ALONE), 1).when(like(s, FULL_ROW), 2).when(like(s, PAGELESS_ROW), 3)

        def edged(k: Column) -> Column:
            other = (s == "") | F.lower(s).startswith("s. no") | F.lower(s).startswith("table of contents") | like(s, PART) | like(s, ANNEXURES)
            return F.struct(s.alias("s"), k.alias("kind"), (F.coalesce(k < 3, F.lit(False)) | other).alias("edge"))

        return bound(kind, edged)

    split = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("source_line", "line"))
    lines = split.select("doc_id", "page_no", "source_line", bound(F.regexp_replace("line", r"^\s+|\s+$", ""), read).alias("_x")).select("doc_id", "page_no", "source_line", "_x.*")
    order = Window.partitionBy("doc_id", "page_no").orderBy("source_line")
    before = F.last(F.when(F.col("s") != "", F.struct("s", "edge")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.col("edge").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    group = F.sort_array(F.collect_list(F.struct("source_line", "s", "kind", "edge", "before")))
    groups = lines.withColumns({"before": before, "run": run}).groupBy("doc_id", "page_no", "run").agg(group.alias("x"))
    after = F.array_join(F.transform(F.filter("x", lambda r: ~r["edge"]), lambda r: r["s"]), " ")

    def row(r: Column) -> Column:
        s = r["s"]
        told = lambda number, title, page: F.struct(r["kind"].alias("pass"), r["source_line"].alias("source_line"), number.cast("int").alias("section_no"), title.alias("title"), page.alias("page"))

        def wrapped(x: Column) -> Column:
            lead, own_page = x["lead"], x["page"]
            rides = own_page.isNull() & F.coalesce(like(lead, TITLE_AND_PAGE), F.lit(False))
            lead_title = F.when(rides, F.trim(F.regexp_extract(lead, TITLE_AND_PAGE, 1))).otherwise(lead)
            page = F.coalesce(own_page, F.when(rides, F.regexp_extract(lead, TITLE_AND_PAGE, 2).cast("int")), F.lit(0))
            title = bound(lead_title, lambda t: clean_title(F.concat_ws(" ", F.when(t != "", t), F.when(after != "", after))))
            return told(F.coalesce(found(s, NUMBER_AND_PAGE, 1), found(s, NUMBER_ALONE, 1)), title, page)

        lead = F.when(~r["before"]["edge"], r["before"]["s"])
        number = bound(F.struct(lead.alias("lead"), found(s, NUMBER_AND_PAGE, 2).cast("int").alias("page")), wrapped)
        complete = told(found(s, FULL_ROW, 1), clean_title(found(s, FULL_ROW, 2)), found(s, FULL_ROW, 3).cast("int"))
        return F.when(r["kind"] == 1, number).when(r["kind"] == 2, complete).otherwise(told(found(s, PAGELESS_ROW, 1), clean_title(found(s, PAGELESS_ROW, 2)), F.lit(0)))

    shaped = groups.select("doc_id", "page_no", F.inline_outer(F.transform(F.filter("x", lambda r: r["kind"].isNotNull()), row)))
    proper = F.when(F.col("pass") == 1, F.col("page") != 0).otherwise(~like(F.col("title"), r"^\p{Nd}"))
    return shaped.where((F.col("title") != "") & proper)


def merge_index(entries: DataFrame, recovered: DataFrame) -> DataFrame:
    """The section index with the recovered rows that it lacks.

    A recovered row belongs to the annexures from the page on where these start. One without a page stands at the
    furthest page of the index so far, which rows merged before it can move; only this is told in sequence, by a fold
    over a document's few recovered rows. Section numbers have three digits at most, so what a fold holds is bounded
    whatever the document. Parts come from the as-of part of the nearest lower section: a merged row has the part of the
    entry below it, so either one gives the same.
    """
    annexed = F.min(F.when(F.col("block") == "annexure", F.col("start_page")))
    key = F.col("section_no") * 2 + (F.col("block") == "annexure").cast("int")
    facts = entries.groupBy("doc_id").agg(F.max("start_page").alias("reach"), annexed.alias("annexed_from"), F.collect_set(key).alias("has"))
    row = F.struct("page_no", "pass", "source_line", "section_no", "title", "page")
    rows = recovered.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).join(facts, "doc_id", "left")
    # The outer form: the inner one would have the fold evaluated again, as a filter for arrays that aren't empty.
    placed = _place_rows(F.col("rows"), F.col("reach"), F.col("annexed_from"), F.coalesce("has", F.array().cast("array<int>")))
    merged = rows.select("doc_id", F.inline_outer(placed)).where("block is not null")
    first = entries.groupBy("doc_id", "block", "section_no").agg(F.min_by(F.struct("part"), "row_no").alias("_first"))
    parts = inherit_part(merged, first.select("doc_id", "block", "section_no", F.col("_first.part").alias("part")))
    own = entries.select("doc_id", "block", "part", "section_no", "title", "start_page", F.lit(False).alias("recovered"), F.lit(False).alias("page_inferred"))
    return own.unionByName(parts.withColumn("recovered", F.lit(True)).select(own.columns))


def _place_rows(rows: Column, reach: Column, annexed_from: Column, has: Column) -> Column:
    """Those of one document's recovered rows, in order of page, pass and line, that are merged, with block and page.

    The fold keeps keys, and of each row its page and whether it is merged; rows themselves are not copied from step to
    step.
    """
    start = F.struct(F.coalesce(reach, F.lit(0)).cast("int").alias("reach"), F.array().cast("array<int>").alias("taken"), F.array().cast("array<int>").alias("at"), F.array().cast("array<boolean>").alias("merged"))
    annexed = lambda at: F.coalesce(at >= annexed_from, F.lit(False))

    def step(state: Column, r: Column) -> Column:
        at = F.when(r["page"] != 0, r["page"]).otherwise(state["reach"])

        def taken_or_merged(x: Column) -> Column:
            known = F.array_contains(has, x["key"]) | F.array_contains(state["taken"], x["key"])

            def after(k: Column) -> Column:
                return F.struct(
                    F.when(k, state["reach"]).otherwise(F.greatest(state["reach"], x["at"])).alias("reach"), F.when(k, state["taken"]).otherwise(F.concat(state["taken"], F.array(x["key"]))).alias("taken"),
                    F.concat(state["at"], F.array(x["at"])).alias("at"), F.concat(state["merged"], F.array(~k)).alias("merged"),
                )

            return bound(F.coalesce(known, F.lit(False)), after)

        return bound(at, lambda p: bound(F.struct(p.alias("at"), (r["section_no"] * 2 + annexed(p).cast("int")).alias("key")), taken_or_merged))

    def placed(x: Column) -> Column:
        def row(r: Column, i: Column) -> Column:
            at = F.get(x["at"], i)
            return F.when(F.get(x["merged"], i), F.struct(F.when(annexed(at), "annexure").otherwise("body").alias("block"), r["section_no"].alias("section_no"), r["title"].alias("title"), at.alias("start_page"), (r["page"] == 0).alias("page_inferred")))

        return F.filter(F.transform(rows, row), lambda r: r.isNotNull())

    return bound(F.aggregate(rows, start, step), placed)


def absent_rows(entries: DataFrame, recovered: DataFrame) -> DataFrame:
    """Recovered rows whose (block, section_no) the index lacks, the first of each key: the merge without page hints."""
    first = F.row_number().over(Window.partitionBy("doc_id", "block", "section_no").orderBy("page_no", "pass", "source_line"))
    missing = recovered.join(entries.select("doc_id", "block", "section_no"), ["doc_id", "block", "section_no"], "left_anti")
    return missing.withColumn("_n", first).where("_n = 1").drop("_n")


def inherit_part(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """`rows` with the part of the nearest lower section of their block; a null part is inherited as null."""
    key = ["doc_id", "block"]
    both = rows.withColumns({"_own": F.lit(1), "_part": F.lit(None).cast("struct<part:string>")}).unionByName(
        entries.select(*key, "section_no", F.lit(0).alias("_own"), F.struct("part").alias("_part")), allowMissingColumns=True
    )
    below = Window.partitionBy(*key).orderBy("section_no").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("part", F.last("_part", ignorenulls=True).over(below)["part"]).where("_own = 1").drop("_own", "_part")


def in_order(index: DataFrame) -> DataFrame:
    """Body first, then by page and number."""
    return index.orderBy(F.col("block") != "body", "start_page", "section_no")


def missing_numbers(index: DataFrame) -> DataFrame:
    """For each document and block: how many numbers, the largest, and those of 1..largest that are missing."""
    numbers = index.groupBy("doc_id", "block").agg(F.collect_set("section_no").alias("have"), F.max("section_no").alias("largest"))
    gone = F.array_sort(F.array_except(F.sequence(F.lit(1), "largest"), "have"))
    return numbers.select("doc_id", "block", F.size("have").alias("numbers"), "largest", F.array_join(gone, ",").alias("missing"))
