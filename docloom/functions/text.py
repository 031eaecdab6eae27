"""Text normalisation, identities, references and labels as native Column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters of Unicode text, spelt out because engines differ in \s and \w.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ASCII_WS = r"[\t-\r\x1c-\x20]"
WORD = r"[\p{L}\p{N}_]"
STOPWORDS = (
    "the", "a", "an", "of", "to", "and", "or", "in", "on", "for", "by", "with", "shall", "must", "be", "is", "are", "as",
    "at", "from", "that", "this", "any", "all", "such", "within", "their", "its", "may", "not",
)
FOLD_FROM, FOLD_TO = "\u2018\u2019\u201c\u201d\u2013\u2014\u2212\u00a0\u2009", "''\"\"---  "
ZERO_WIDTH = "\u200b"
SLUGS = {"stock brokers": "stock_broker", "merchant bankers": "merchant_banker"}
CIRCULAR_FAMILIES = (r"\bSEBI/HO/[A-Za-z0-9/\-_]+?/P/CIR/\d{4}/\d+\b", r"\bHO/\d+/\d+/\d+\(\d+\)\d{4}-[A-Za-z0-9\-]+/[A-Za-z]/\d+/\d{4}\b")
CIRCULAR_ANY = r"\b(?:SEBI/[A-Za-z0-9/\-_()]+|[A-Z]{2,}/\d[A-Za-z0-9/\-_()]*)\b"
PARA_REF = r"(?i)Para\s+(\d+(?:\.\d+)*)"
PAGE_REF = r"(?i)page\s*no\.?\s*(\d{1,4})"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once for each row, however often `f` uses it and in whatever branch.

    Columns are expressions: one that is used in several branches of a conditional is computed in each of them.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, or null without a match or where the group is empty; the text is searched once."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda x: x != ""), F.lit(0))


def tidy(text: Column) -> Column:
    """Whether a text is of one line of printable ASCII with single spaces: what most short texts are, told by one search."""
    return ~F.regexp_like(text, F.lit(r"[^\x20-\x7e]|\x20\x20"))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""

    def one(t: Column) -> Column:
        # Of ASCII, the few signs that it has of the class: to look up each character in all of it costs three times as much.
        spaced = F.when(F.octet_length(t) == F.length(t), F.regexp_replace(t, f"{ASCII_WS}+", " ")).otherwise(F.regexp_replace(t, f"{WS}+", " "))
        return F.trim(F.when(tidy(t), t).otherwise(spaced))

    return bound(text, one)


def dehyphenate(text: Column) -> Column:
    """Join words that a hyphen and a line end break."""
    return F.regexp_replace(text, f"({WORD})-{WS}*\n{WS}*({WORD})", "$1$2")


def normalise_native(text: Column) -> Column:
    """Normal form for identities: dehyphenated, punctuation folded, white space collapsed, lower case.

    Differs from `normalise_exact` only where compatibility forms (NFKC) or full case folding change a character.
    """

    def fold(t: Column) -> Column:
        joined = dehyphenate(t)
        # All that is folded lies outside ASCII, and to look up every character costs more than all else here.
        folded = F.replace(F.translate(joined, FOLD_FROM, FOLD_TO), F.lit(ZERO_WIDTH), F.lit(""))
        full = collapse(F.when(F.octet_length(t) == F.length(t), joined).otherwise(folded))
        return F.lower(F.when(tidy(t), F.trim(t)).otherwise(full))

    return bound(text, fold)


FOLDED = str.maketrans(dict(zip(FOLD_FROM, FOLD_TO, strict=True)) | {ZERO_WIDTH: None})
BROKEN = re.compile(r"(\w)-\s*\n\s*(\w)")


def exact_form(t: str | None) -> str | None:
    """The normal form of one text with NFKC and full case folding."""
    return None if t is None else " ".join(unicodedata.normalize("NFKC", BROKEN.sub(r"\1\2", t)).translate(FOLDED).split()).casefold()


def normalise_exact(text: Column) -> Column:
    """The normal form with NFKC and full case folding, in Arrow batches: no built-in does these."""

    @F.pandas_udf("string")
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(exact_form).astype(object)

    return fold(text)


def sha256_parts(*parts: Column) -> Column:
    """Digest of texts, each ended by the unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\x1f"))]), 256)


def clause_id(intermediary: Column, section_no: Column, path: Column, normalised: Column) -> Column:
    return sha256_parts(intermediary, section_no, path, normalised)


def action_signature(normalised: Column) -> Column:
    """What an action says without its deadline, numbers and amounts."""
    s = F.regexp_replace(normalised, r"\b(?:within|not later than|on or before)\b[^,.;]*", "")
    s = F.regexp_replace(s, r"\b\d+(?:\.\d+)?\b", "#")
    return collapse(F.regexp_replace(s, r"\b(?:rs\.?|inr|crore|lakh)\b", ""))


def obligation_id(intermediary: Column, kind: Column, normalised_action: Column, applies_to: Column) -> Column:
    """Identity across versions: no section, page or circular number takes part."""
    return sha256_parts(intermediary, kind, action_signature(normalised_action), F.array_join(F.array_sort(applies_to), "|"))


def salient(normalised: Column) -> Column:
    """Words of three or more letters that are no stop words; repeats stay."""
    words = F.regexp_extract_all(normalised, F.lit("[a-z]{3,}"), 0)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def clean_title(raw: Column) -> Column:
    """A title without dot leaders, trailing page and outer signs."""
    title = F.trim(F.regexp_replace(collapse(F.coalesce(raw, F.lit(""))), r"[.\x{2026}]{3,}\s*\d*\s*$", ""))
    return F.btrim(title, F.lit(" .…-"))


def slug_intermediary(label: Column) -> Column:
    return bound(F.lower(label), _slug)


def _slug(low: Column) -> Column:
    other = F.left(F.btrim(F.regexp_replace(low, "[^a-z0-9]+", "_"), F.lit("_")), F.lit(40))
    known = None
    for key, slug in SLUGS.items():
        known = F.when(low.contains(key), slug) if known is None else known.when(low.contains(key), slug)
    return known.otherwise(other)


def circular_number(text: Column) -> Column:
    return F.coalesce(*[found(text, p) for p in CIRCULAR_FAMILIES])


def paragraph_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PARA_REF), 1)))


def page_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PAGE_REF), 1), lambda x: x.cast("int"))))


def citation(circular_no: Column, part: Column, section_no: Column, path: Column, page: Column) -> Column:
    """Parts of a citation that are there, joined by a middle dot."""
    return F.concat_ws(" · ", circular_no, F.concat(F.lit("Part "), F.when(part != "", part)), F.concat(F.lit("s."), section_no.cast("string")), F.when(path != "", path), F.concat(F.lit("p."), page.cast("string")))


def size_label(size: Column) -> Column:
    """Bytes as B, KB without decimals or MB with one."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.round(size / 1024, 0).cast("bigint").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", F.round(size / (1024 * 1024), 1)), F.lit(" MB")))
    )


def markdown_cell(text: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def token_estimate(*texts: Column) -> Column:
    """A quarter of the characters, rounded down."""
    total = sum((F.coalesce(F.length(t), F.lit(0)) for t in texts[1:]), F.coalesce(F.length(texts[0]), F.lit(0)))
    return F.floor(total / 4).cast("bigint")
