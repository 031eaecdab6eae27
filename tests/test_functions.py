"""Golden values of the text, deadline and gate functions."""

import datetime
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import deadlines, fuzzy, gate, text

DEADLINES = [
    ("shall settle within 3 working days of quarter-end", (3, "working_day", "quarter_end", None)),
    ("not later than fifteen days from the date of receipt", (15, "day", "receipt", None)),
    ("shall report within 7 days", (7, "day", None, None)),
    ("within 2 months of the end of the month", (2, "month", "month_end", None)),
    ("shall be completed within 1 week", (7, "day", None, None)),
    ("pay-in obligation of T+1 day", (1, "day", "trade_date", None)),
    ("settled on quarterly and monthly basis, as chosen", (None, "quarter", "period_end", None)),
    ("shall comply on or before March 31, 2025", (None, None, "fixed_date", datetime.date(2025, 3, 31))),
    ("by Smarch 3, 2025 and annually", (None, "year", "period_end", None)),
    ("The TM shall maintain records of client instructions.", None),
    ("", None),
    (None, None),
]


def column(spark, values, c, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(c).collect()]


def test_deadlines(spark):
    got = column(spark, [d for d, _ in DEADLINES], deadlines.deadline(F.col("x")))
    assert [None if g is None else tuple(g) for g in got] == [d for _, d in DEADLINES]


def test_units_outside_the_vocabulary_are_marked(spark):
    assert column(spark, ["annually", "monthly", "weekly", ""], deadlines.schema_valid(deadlines.deadline(F.col("x")))) == [False, True, False, True]


def test_identity_ignores_layout_deadline_and_numbers(spark):
    c = text.obligation_id(F.lit("stock_broker"), F.lit("conduct"), text.normalise_native(F.col("x")), F.array(F.lit("b"), F.lit("a")))
    a, b, other = column(spark, ["Settle 3 accounts  within 7 days, fully", "settle 9 accounts within 2 weeks, fully", "close 3 accounts, fully"], c)
    assert a == b != other


def test_normal_forms(spark):
    values = ["A’s  set-\n tle x​", "straße ﬁn", None, ""]
    assert column(spark, values, text.normalise_exact(F.col("x"))) == ["a's settle x", "strasse fin", None, ""]
    assert column(spark, values[:1], text.normalise_native(F.col("x"))) == ["a's settle x"]


def test_small_labels(spark):
    assert column(spark, ["  Deployment of Funds .......... 6", " . Title ……… ", None], text.clean_title(F.col("x"))) == ["Deployment of Funds", "Title", ""]
    assert column(spark, ["For Stock Brokers", "Other  Kind!"], text.slug_intermediary(F.col("x"))) == ["stock_broker", "other_kind"]
    assert column(spark, [10, 2048, 3 << 20], text.size_label(F.col("x")), "x bigint") == ["10 B", "2 KB", "3.0 MB"]
    assert column(spark, ["a|b\nc", None], text.markdown_cell(F.col("x"))) == ["a\\|b c", ""]
    assert column(spark, ["Para 41.9 and para 50, page no. 12, page no 3, page no 12"], text.page_refs(F.col("x"))) == [[3, 12]]
    assert column(spark, ["Para 41.9 and para 50 and 15.8.1.1.c, Para 15.8.1.1.c"], text.paragraph_refs(F.col("x"))) == [["15.8.1.1", "41.9", "50"]]


def test_indel_ratio_of_known_pairs():
    assert round(fuzzy.indel_ratio("settle", "settling"), 1) == 71.4
    assert fuzzy.indel_ratio("report", "reporting") == 80.0
    assert round(fuzzy.indel_ratio("account", "accounts"), 1) == 93.3
    assert fuzzy.best_window_ratio("running account", "settlement of running account of clients") == 100.0
    assert fuzzy.best_window_ratio("", "") == 100.0 and fuzzy.best_window_ratio("", "a") == 0.0


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
@settings(max_examples=200, deadline=None)
def test_common_subsequence_is_the_longest(a, b):
    best = max((n for n in range(min(len(a), len(b)) + 1) if any("".join(x) in {"".join(y) for y in itertools.combinations(b, n)} for x in itertools.combinations(a, n))), default=0)
    assert fuzzy.common_subsequence(a, b) == best


def gated(spark, clause, action, criticality="binding", entailment="entailed", confidence=0.9, span=None):
    from docloom.operators.obligations import evaluate

    doc = f"prefix {clause} suffix"
    start, end = span or (7, 7 + len(clause))
    row = spark.createDataFrame([(action, criticality, entailment, confidence, start, end, doc)], "action_required string, criticality string, entailment string, confidence double, char_start bigint, char_end bigint, document string")
    return evaluate(row).first()


CLAUSE = "The TM shall settle the running account of the client on a quarterly basis."


def test_gate(spark):
    good = gated(spark, CLAUSE, "settle running accounts of clients")
    assert good.review_status == "auto_accepted" and good.score == 1.0
    assert gated(spark, CLAUSE, "settle running account", entailment="neutral").review_status == "needs_review"
    assert gated(spark, CLAUSE, "settle running account", entailment="contradicted").review_status == "rejected"
    assert gated(spark, CLAUSE, "settle running account", confidence=0.4).review_status == "needs_review"
    assert gated(spark, CLAUSE, "settle running account", span=(500, 600)).review_status == "rejected"
    assert not gated(spark, CLAUSE, "implement a cyber-security plan").keyterm_ok
    assert gated(spark, CLAUSE, "settle running account", entailment="neutral").score == 0.7075
    soft = CLAUSE.replace("shall", "may")
    assert not gated(spark, soft, "settle running account").modality_ok
    assert gated(spark, soft, "settle running account", criticality="advisory").modality_ok


@pytest.mark.parametrize("threshold", [82.0])
def test_length_bound_of_fuzzy_hits_loses_nothing(threshold):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 12))) for _ in range(80)]
    for a, b in itertools.product(words, words):
        if fuzzy.indel_ratio(a, b) >= threshold:
            assert 200.0 * min(len(a), len(b)) >= threshold * (len(a) + len(b))


def test_modality_words(spark):
    got = column(spark, ["He SHALL go", "marshalls can", "nothing", None], gate.binding(F.col("x")))
    assert got == [True, False, False, None]


def test_messages(spark):
    from docloom.functions import prompts

    row = spark.createDataFrame([("C/1", None, "III", 4, "III.4.a", 7, "The TM shall.", 2, 1)], "no string, title string, part string, section int, path string, page int, text string, images int, pdfs int")
    message = prompts.clause_message(F.col("no"), F.lit("2024-05-22"), F.lit("stock_broker"), F.col("part"), F.col("section"), F.col("title"), F.col("path"), F.col("page"), F.col("text"))
    got = row.select(message.alias("m"), prompts.attachments(F.col("images"), F.col("pdfs")).alias("a"), prompts.attachments(F.lit(0), F.lit(0)).alias("none")).first()
    assert got.m.splitlines()[0] == "Circular: C/1 (2024-05-22)" and got.m.endswith('"""\nThe TM shall.\n"""') and "Section 4 — None" in got.m
    assert got.a == "2 screenshots and 1 PDF" and got.none is None


def test_exact_normalisation_equals_unicode_data_for_all_code_points(spark):
    import sys
    import unicodedata

    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = ["a" + "b".join(points[k : k + 997]) + "c" for k in range(0, len(points), 997)]
    got = {r["k"]: r["x"] for r in spark.createDataFrame(list(enumerate(rows)), "k int, t string").select("k", text.normalise_exact(F.col("t")).alias("x")).collect()}
    fold = str.maketrans(dict(zip(text.FOLD_FROM, text.FOLD_TO, strict=True)) | {text.ZERO_WIDTH: None})
    for k, t in enumerate(rows):
        assert got[k] == " ".join(unicodedata.normalize("NFKC", t).translate(fold).split()).casefold()
