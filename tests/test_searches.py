"""Plans do no work twice: patterns are searched once, sections sorted by line once, words joined once for equal lists."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import deadlines, gate, text
from docloom.operators import clauses, contents, documents, fuzzy_join, versions
from docloom.plans import catalog
from docloom.sources import fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.createDataFrame([("a",)], "x string")


def test_a_deadline_searches_its_patterns_a_few_times(spark):
    """Once for the match, once for each of its groups."""
    for f in (deadlines.deadline, deadlines.offset_deadline):
        assert plan(texts(spark).select(f(F.col("x")).alias("y"))).count("latest") <= 3


def test_number_words_are_no_casts_that_fail(spark):
    rows = spark.createDataFrame([("within fifteen days",), ("Within 99999999999999999999 days",), ("upto 3 weeks",), ("by Smarch 12, 2024",), ("by June 31, 2024",), ("by June 3,  2024",)], "x string")
    got = [(r.y.offset, r.y.fixed_date and r.y.fixed_date.isoformat()) if r.y else None for r in rows.select(deadlines.deadline(F.col("x")).alias("y")).collect()]
    assert got == [(15, None), None, (21, None), None, None, (None, "2024-06-03")]
    assert re.search(r"coalesce\(map|coalesce\(element_at|coalesce\(keys", plan(texts(spark).select(deadlines.number(F.col("x")).alias("y"))))


def test_a_span_is_tested_for_blanks_without_rewriting_it(spark):
    rows = spark.createDataFrame([("ab  \u00a0\u2003 c", 2, 6), ("ab  \u00a0 c", 2, 8), ("a\u200b", 1, 2), (None, 0, 1)], "d string, a bigint, b bigint")
    told = rows.select(gate.span_ok(F.col("a"), F.col("b"), F.col("d")).alias("y"))
    assert [r.y for r in told.collect()] == [False, False, True, False]
    assert "regexp_replace" not in plan(told)


def test_tidy_texts_need_no_folding(spark):
    rows = spark.createDataFrame([("One two",), (" One ",), ("a  b",), ("a\tb",), ("a\u2019s",), ("a-\nb",), ("",), (None,)], "x string")
    assert [r.y for r in rows.select(text.tidy(F.col("x")).alias("y")).collect()] == [True, True, False, False, False, False, True, None]
    assert [r.y for r in rows.select(text.normalise_native(F.col("x")).alias("y")).collect()] == ["one two", "one", "a b", "a b", "a's", "ab", "", None]


def test_lines_of_sections_are_sorted_once(spark):
    """Windows over lines share one sort; only the repeats of a path need another."""
    sections = spark.createDataFrame([("d", 1, "", 0, "1.1 one\n(a) two")], "doc_id string, section_no int, part string, body_start bigint, text string")
    assert clauses.split_clauses(sections)._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2


def test_header_fields_search_the_text_once_each(spark):
    assert plan(documents.parse_headers(spark.createDataFrame([("d", "t")], "doc_id string, text string"))).count("Subject") == 1


def test_rows_with_equal_lists_share_their_hits(spark):
    """Rows take part in one join, that with the hits of their lists."""
    rows = spark.range(200).select(F.col("id").alias("key"), F.array(F.lit("settles"), F.lit("fees")).alias("needles"), F.array(F.lit("settle"), F.lit("x")).alias("words"))
    got = fuzzy_join.fuzzy_hits(rows, "key", "needles", "words", 82.0)
    assert plan(got).count("Join") == 1
    assert {r.hits for r in got.collect()} == {1}


def test_chains_send_no_tables_to_the_driver(spark):
    links = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "b", 3)], "version string, supersedes string, issued int")
    got = versions.supersession_chains(links)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.version, r.root, r.depth, r.latest) for r in got.collect()} == {("a", "a", 0, "c"), ("b", "a", 1, "c"), ("c", "a", 2, "c")}


def test_golden_files_are_written_and_moved_by_parts(tmp_path):
    """No part of a task's files is larger than the rows that are in memory at once."""
    n = 2 * fixtures.ROWS + 7
    batch = pa.RecordBatch.from_pydict({"doc_id": [f"d{k}" for k in range(n)], "toc": [[{"x": k}] for k in range(n)]})
    writer = fixtures.FixtureWriter(str(tmp_path), ["doc_id", "toc"], True)
    written = writer.write(iter([batch]))
    parts = [len(list(p.glob("toc/*.json"))) for p in (tmp_path / writer.staging).glob("*/*")]
    assert sorted(parts) == [7, fixtures.ROWS, fixtures.ROWS]
    writer.commit([written])
    assert len(list((tmp_path / "toc").glob("*.json"))) == n
    assert [p.name for p in tmp_path.iterdir()] == ["toc"]


def test_exact_forms_are_made_in_small_batches(spark, tmp_path):
    """Whole texts go to Python 500 at a time where the session leaves that open."""
    from docloom.plans import catalog

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        catalog.QUERIES["normalise_text_exact"](catalog.Tables(spark, "/root/testdata/sf0.001"))
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, before)


def located(spark, text):
    texts = spark.createDataFrame([("d", text, 0)], "doc_id string, text string, body_from bigint")
    index = spark.createDataFrame([("d", "body", None, 1, "Running account", 1), ("d", "body", None, 2, "Margin", 2), ("d", "body", None, 3, None, 3)], "doc_id string, block string, part string, section_no int, title string, start_page int")
    return clauses.locate_sections(texts, index)


def test_sections_are_chosen_once_and_only_headings_become_rows(spark):
    rows = located(spark, "1. Running account\na\n\u2028\n\t2.\tMargin \n2. Margin\r\n3.x\n3. Other")
    assert plan(rows).count("aggregate(") == 1 and "(?=" in plan(rows)
    got = {r.section_no: (r.char_start, r.char_end, r.heading, r.match_score) for r in rows.collect()}
    assert got == {1: (0, 23, "Running account", 100.0), 2: (23, 58, "Margin", 100.0), 3: (None, None, None, None)}


def test_lines_of_sections_are_made_once(spark):
    """All branches of section_locate read the same exchange of whole documents."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = catalog.QUERIES["section_locate"](catalog.Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert made.count("FileScan parquet") == 1


def test_white_space_of_ascii_texts_is_collapsed_by_its_own_class(spark):
    rows = spark.createDataFrame([("\x1f a\x0b\x1c\tb \n",), ("a \u2003\u00a0b",), ("a\x85b",), ("a\u200bb",), ("",), (None,)], "x string")
    got = rows.select(text.collapse(F.col("x")).alias("y"))
    assert [r.y for r in got.collect()] == ["a b", "a b", "a b", "a\u200bb", "", None]
    assert "octet_length" in plan(got)


def test_contents_rows_and_lines_are_read_once(spark):
    """Cells are collapsed once a row, lines explode once for all passes, and rows are no part of the fold's state."""
    rows = spark.createDataFrame([("d", 1, ["1.", "One", "5"])], "doc_id string, row_no int, cells array<string>")
    entries = contents.parse_rows(rows)
    pages = spark.createDataFrame([("d", 1, "7. 8\n9. x 3")], "doc_id string, page_no int, text string")
    recovered = contents.recover_rows(pages)
    assert plan(entries).count("octet_length(lambda") <= 2 * 4
    assert plan(recovered).count("posexplode(") == 1 and plan(recovered).count("Join") == 0
    assert "title" not in re.search(r"aggregate\(.*?lambdafunction", plan(contents.merge_index(entries, recovered))).group()
