"""The groundedness gate: does the cited text carry the obligation?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import KEYTERM_COVERAGE, TAU_HIGH
from docloom.functions.text import WS

# Words that bind and words that advise.
BINDING = r"(?i)\b(shall|must|is\s+required\s+to|are\s+required\s+to|shall\s+not|is\s+mandatory|shall\s+ensure|has\s+to|have\s+to)\b"
ADVISORY = r"(?i)\b(may|should|is\s+encouraged|are\s+encouraged|is\s+advised|are\s+advised|is\s+desirable|can)\b"
ENTAILMENT_WEIGHT = {"entailed": 1.0, "neutral": 0.35, "contradicted": 0.0}


def binding(text: Column) -> Column:
    return F.regexp_like(text, F.lit(BINDING))


def advisory(text: Column) -> Column:
    return F.regexp_like(text, F.lit(ADVISORY))


def span_ok(start: Column, end: Column, document: Column) -> Column:
    """0 <= start < end <= length, and the slice is not blank."""
    cut = F.substring(document, start.cast("int") + 1, (end - start).cast("int"))
    return F.coalesce((start >= 0) & (start < end) & (end <= F.length(document)) & F.regexp_like(cut, F.lit("[^" + WS[1:])), F.lit(False))


def modality_ok(criticality: Column, text: Column) -> Column:
    """A binding claim needs binding words; an advisory one needs advisory words or no binding ones."""
    return F.when(criticality == "binding", binding(text)).otherwise(advisory(text) | ~binding(text))


def exact_hits(needles: Column, haystack: Column) -> Column:
    return F.size(F.filter(needles, lambda w: F.array_contains(haystack, w)))


def keyterm_ok(needles: Column, haystack: Column, hits: Column, coverage: float = KEYTERM_COVERAGE) -> Column:
    full = (F.size(needles) > 0) & (F.size(haystack) > 0)
    return F.coalesce(F.when(full, hits / F.size(needles) >= coverage), F.lit(False))


def score(span: Column, keyterm: Column, modality: Column, entailment: Column) -> Column:
    weight = F.lit(0.0)
    for name, value in ENTAILMENT_WEIGHT.items():
        weight = F.when(entailment == name, value).otherwise(weight)
    return F.round(0.20 * span.cast("int") + 0.20 * keyterm.cast("int") + 0.15 * modality.cast("int") + 0.45 * weight, 4)


def review_status(span: Column, keyterm: Column, modality: Column, entailment: Column, confidence: Column, tau_high: float = TAU_HIGH) -> Column:
    """The score takes no part in the decision; a missing verdict is neutral before it comes here."""
    return (
        F.when((entailment == "contradicted") | ~span, "rejected")
        .when(keyterm & modality & (entailment == "entailed") & (confidence >= tau_high), "auto_accepted")
        .otherwise("needs_review")
    )
