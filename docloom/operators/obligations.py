"""From raw model answers to gated obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import schemas
from docloom.config import KEYTERM_COVERAGE, KEYTERM_FUZZ, TAU_HIGH
from docloom.functions import gate
from docloom.functions.deadlines import deadline
from docloom.functions.fuzzy import fuzzy_hits
from docloom.functions.text import normalise_native, obligation_id, salient


def prepare(raw: DataFrame, clauses: DataFrame) -> DataFrame:
    """Raw answers with their clause, defaults filled: blank actions go, nobody named means the intermediary, no
    confidence means 0; a deadline comes only from the answer's own phrase, an identity from what it says."""
    joined = raw.where(F.trim("action_required") != "").join(clauses, "clause_id")
    applies = F.when(F.size("applies_to") > 0, F.col("applies_to")).otherwise(F.array("intermediary"))
    filled = joined.withColumns({"applies_to": applies, "confidence": F.coalesce("confidence", F.lit(0.0)), "deadline": deadline(F.col("deadline_phrase"))})
    return filled.withColumn("obligation_id", obligation_id(F.col("intermediary"), F.col("obligation_type"), normalise_native(F.col("action_required")), F.col("applies_to")))


def judge(obligations: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Obligations with their verdict; a missing one is neutral, which can't be accepted."""
    return obligations.drop("entailment").join(verdicts.select("obligation_id", "entailment"), "obligation_id", "left").fillna("neutral", ["entailment"])


def evaluate(obligations: DataFrame, fuzzy: bool = True, coverage: float = KEYTERM_COVERAGE, fuzz: float = KEYTERM_FUZZ, tau_high: float = TAU_HIGH) -> DataFrame:
    """Gate columns of obligations (action_required, criticality, entailment, confidence, char_start, char_end, document)."""
    span = gate.span_ok(F.col("char_start"), F.col("char_end"), F.col("document"))
    cited = F.when(span, F.substring(F.col("document"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))).otherwise("")
    told = obligations.withColumns({"span_ok": span, "_cited": cited})
    told = told.withColumns({"_needles": salient(normalise_native(F.col("action_required"))), "_words": F.array_distinct(salient(normalise_native(F.col("_cited"))))})
    hits = fuzzy_hits(F.col("_needles"), F.col("_words"), fuzz) if fuzzy else gate.exact_hits(F.col("_needles"), F.col("_words"))
    told = told.withColumns({"keyterm_ok": gate.keyterm_ok(F.col("_needles"), F.col("_words"), hits, coverage), "modality_ok": F.col("span_ok") & gate.modality_ok(F.col("criticality"), F.col("_cited"))})
    told = told.withColumn("score", gate.score(F.col("span_ok"), F.col("keyterm_ok"), F.col("modality_ok"), F.col("entailment")))
    status = gate.review_status(F.col("span_ok"), F.col("keyterm_ok"), F.col("modality_ok"), F.col("entailment"), F.col("confidence"), tau_high)
    return told.withColumn("review_status", status).drop("_cited", "_needles", "_words")


def vocabulary_violations(obligations: DataFrame) -> DataFrame:
    """Values outside the closed vocabularies: id, field and value, one row each."""
    single = {"obligation_type": schemas.OBLIGATION_TYPES, "trigger_class": schemas.TRIGGER_CLASSES, "criticality": schemas.CRITICALITY, "evidence_class": schemas.EVIDENCE_CLASSES}
    checks = [F.struct(F.lit(f).alias("field"), F.when(~F.col(f).isin(*allowed), F.col(f)).alias("value")) for f, allowed in single.items()]
    listed = F.transform(F.filter("applies_to", lambda x: ~x.isin(*schemas.APPLIES_TO)), lambda x: F.struct(F.lit("applies_to").alias("field"), x.alias("value")))
    return obligations.select("obligation_id", F.explode(F.concat(F.array(*checks), listed)).alias("x")).select("obligation_id", "x.*").where("value is not null")


def unsourced(obligations: DataFrame) -> DataFrame:
    """Obligations whose source sentence does not occur word for word in their clause."""
    return obligations.where(~F.coalesce(F.col("clause_text").contains(F.col("source_sentence")), F.lit(False)))
