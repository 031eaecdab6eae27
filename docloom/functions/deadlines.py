"""Deadlines and dates as native Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import bound, found
from docloom.schemas import DEADLINE_UNITS

# Number words, units, and the phrases that name what an offset starts from.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "fifteen": 15, "thirty": 30}
OFFSET = (
    r"(?i)\b(?:within|not\s+later\s+than|no\s+later\s+than|latest\s+by|upto|up\s+to)\s+"
    r"(\d+|" + "|".join(NUMBER_WORDS) + r")\s*(working\s+days?|business\s+days?|calendar\s+days?|days?|weeks?|months?|quarters?)"
)
T_PLUS = r"(?i)\bT\s*\+\s*(\d+)\s*(working\s+day|day)?s?\b"
FIXED_DATE = r"\b(?:on\s+or\s+before|by)\s+([A-Z][a-z]+\s+\d{1,2},\s*\d{4})\b"
# Each with words, in lower case, one of which is in every match: to look for them costs far less than the pattern.
RELATIVE_TO = (
    (r"(?i)\bquarter[\s\-]?end|end\s+of\s+(?:the\s+)?quarter\b", "quarter_end", ("quarter",)),
    (r"(?i)\bmonth[\s\-]?end|end\s+of\s+(?:the\s+)?month\b", "month_end", ("month",)),
    (r"(?i)\bfinancial\s+year|end\s+of\s+(?:the\s+)?year\b", "financial_year_end", ("year",)),
    (r"(?i)\bend\s+of\s+(?:the\s+)?day|EOD\b", "end_of_day", ("end", "eod")),
    (r"(?i)\bdate\s+of\s+receipt|on\s+receipt\b", "receipt", ("receipt",)),
    (r"(?i)\btrade\s+date|trading\s+day\b", "trade_date", ("trad",)),
)
PERIODIC = (
    (r"(?i)\bquarterly\b", "quarter", ("quarterly",)), (r"(?i)\bmonthly\b", "month", ("monthly",)), (r"(?i)\bannual(?:ly)?\b|\byearly\b", "year", ("annual", "yearly")),
    (r"(?i)\bdaily\b", "day", ("daily",)), (r"(?i)\bweekly\b", "week", ("weekly",)),
)
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH_DATE = r"\b([A-Z][a-z]{2,8})\s+(\d{1,2}),\s*(\d{4})\b"


def _first(text: Column, pairs) -> Column:
    def among(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, label, words in reversed(pairs):
            there = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
            out = F.when(there & F.regexp_like(text, F.lit(pattern)), F.lit(label)).otherwise(out)
        return out

    return bound(F.lower(text), among)


def month_date(text: Column) -> Column:
    """A date from "Month d, yyyy" with a full month name; anything else is null."""
    dated = lambda flat: F.when(F.regexp_like(flat, F.lit(rf"(?i)^(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}$")), F.try_to_date(F.initcap(flat), "MMMM d, yyyy"))
    return bound(F.regexp_replace(text, r"\s+", " "), dated)


def relative_to(text: Column) -> Column:
    return _first(text, RELATIVE_TO)


def number(text: Column) -> Column:
    words = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(n).cast("bigint"))])
    return F.coalesce(words[F.lower(text)], text.try_cast("bigint"))  # a cast that fails costs an exception, so words come first


def fixed_date(text: Column) -> Column:
    return month_date(found(text, FIXED_DATE, 1))


def _deadline(offset: Column, unit: Column, start: Column, date: Column) -> Column:
    return F.struct(offset.cast("bigint").alias("offset"), unit.alias("unit"), start.alias("relative_to"), date.cast("date").alias("fixed_date"))


def offset_deadline(text: Column) -> Column:
    """"within 3 working days" and the like; weeks count as seven days."""

    def of(x: Column) -> Column:
        n, unit = x["n"], x["unit"]
        kind = (
            F.when(unit.startswith("working") | unit.startswith("business"), "working_day")
            .when(unit.startswith("month"), "month").when(unit.startswith("quarter"), "quarter").otherwise("day")
        )
        days = F.when(unit.startswith("week"), n * 7).otherwise(n)
        return F.when(n.isNotNull() & unit.isNotNull(), _deadline(days, kind, relative_to(text), F.lit(None)))

    # Groups are taken from the match, which is short; a match is one to the pattern by itself as well.
    def parts(match: Column) -> Column:
        told = F.struct(bound(found(match, OFFSET, 1), number).alias("n"), F.regexp_replace(F.lower(found(match, OFFSET, 2)), r"\s+", " ").alias("unit"))
        return F.when(match.isNotNull(), bound(told, of))

    return bound(found(text, OFFSET), parts)


def t_plus_deadline(text: Column) -> Column:
    def parts(n: Column) -> Column:
        unit = F.when(F.lower(F.coalesce(found(text, T_PLUS, 2), F.lit(""))).startswith("working"), "working_day").otherwise("day")
        return F.when(n.isNotNull(), _deadline(n, unit, F.lit("trade_date"), F.lit(None)))

    return F.when(text.contains("+"), bound(found(text, T_PLUS, 1).try_cast("bigint"), parts))


def periodic_deadline(text: Column) -> Column:
    return bound(_first(text, PERIODIC), lambda unit: F.when(unit.isNotNull(), _deadline(F.lit(None), unit, F.coalesce(relative_to(text), F.lit("period_end")), F.lit(None))))


def deadline(text: Column) -> Column:
    """The text's deadline: a fixed date, else an offset, else T+n, else a period, else null."""
    fixed = bound(fixed_date(text), lambda date: F.when(date.isNotNull(), _deadline(F.lit(None), F.lit(None).cast("string"), F.lit("fixed_date"), date)))
    return F.coalesce(fixed, offset_deadline(text), t_plus_deadline(text), periodic_deadline(text))


def schema_valid(parsed: Column) -> Column:
    """False for units outside the closed vocabulary (year and week)."""
    return F.coalesce(parsed["unit"].isNull() | parsed["unit"].isin(*DEADLINE_UNITS), F.lit(True))
