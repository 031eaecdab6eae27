"""Interface audits: tallies, checks, and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom import schemas
from docloom.functions.text import markdown_cell

MARKS = {"red": "🔴", "yellow": "🟡", "green": "🟢", "white": "⚪"}
RANKS = {"red": 0, "yellow": 1}


def tally(findings: DataFrame, *by: str) -> DataFrame:
    """Findings by severity, one column each, 0 where there are none."""
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in schemas.SEVERITIES]
    return findings.groupBy(*by).agg(*counts)


def recommendation(red: Column, yellow: Column, white: Column) -> Column:
    return F.when(red > 0, "Blocked").when((yellow > 0) | (white > 0), "Conditional").otherwise("Clear")


def ring(score: Column) -> Column:
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return F.when(bounded >= 80, "green").when(bounded >= 55, "yellow").otherwise("red")


def score_conflicts(score: Column, red: Column, yellow: Column) -> Column:
    """Why a score doesn't go with its findings, or null: red findings keep it under 70, none at all mean 80 or more."""
    return F.when((red > 0) & (score >= 70), "red_with_70_or_more").when((red == 0) & (yellow == 0) & (score < 80), "clear_under_80")


def verdict_mismatches(verdicts: DataFrame, findings: DataFrame) -> DataFrame:
    """Audits whose stated counts differ from their findings'."""
    found = tally(findings, "audit_id")
    both = verdicts.join(found, "audit_id", "left").fillna(0, list(schemas.SEVERITIES))
    return both.where("violations != red or risks != yellow or compliant != green or unverifiable != white")


def pattern_problems(patterns: DataFrame, total: int = schemas.BANNED_PATTERNS) -> DataFrame:
    """Audits whose checklist lacks ids, is out of order or has an unknown result."""
    order = Window.partitionBy("audit_id").orderBy("position")
    stepped = patterns.withColumn("_back", F.col("id") <= F.lag("id").over(order))
    seen = stepped.groupBy("audit_id").agg(
        F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(total)), F.collect_set("id"))), ",").alias("missing"),
        F.count(F.when(F.col("_back"), 1)).alias("out_of_order"), F.count(F.when(~F.col("result").isin(*schemas.PATTERN_RESULTS), 1)).alias("unknown_results"),
    )
    return seen.where("missing != '' or out_of_order > 0 or unknown_results > 0")


def incomplete_findings(findings: DataFrame) -> DataFrame:
    """Red and yellow findings without rule, fix or gain."""
    blank = F.lit(False)
    for c in ("rule", "fix", "cx_upside"):
        blank = blank | (F.coalesce(F.trim(c), F.lit("")) == "")
    return findings.where(F.col("severity").isin("red", "yellow") & blank)


def backlog_disorder(backlog: DataFrame) -> DataFrame:
    """Backlog items that come after one of lower severity."""
    rank = F.lit(len(RANKS))
    for s, r in RANKS.items():
        rank = F.when(F.col("severity") == s, r).otherwise(rank)
    before = Window.partitionBy("audit_id").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    ranked = backlog.withColumn("_rank", rank)
    return ranked.withColumn("_worst", F.max("_rank").over(before)).where("_rank < _worst").drop("_rank", "_worst")


def mark(severity: Column) -> Column:
    out = F.lit("")
    for s, m in MARKS.items():
        out = F.when(severity == s, m).otherwise(out)
    return out


def finding_line(level: Column, finding: Column, severity: Column, rule: Column, fix: Column, gain: Column) -> Column:
    cells = [level, markdown_cell(finding), mark(severity), markdown_cell(rule), markdown_cell(fix), markdown_cell(gain)]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))


def to_markdown(audits: DataFrame, title: str, date: str) -> DataFrame:
    """`audits` (rows of AUDIT_RESULT) with a Markdown report in `markdown`; `title` opens its first heading."""
    v, none = F.col("verdict"), F.array().cast("array<string>")
    text = lambda *parts: F.concat(*[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    screens = F.flatten(F.transform("screens", lambda s: F.concat(
        F.array(F.lit(""), text("### ", s["name"]), F.lit("| Level | Finding | Sev | Rule | Fix | CX upside |"), F.lit("|---|---|---|---|---|---|")),
        F.transform(s["findings"], lambda f: finding_line(f["level"], f["finding"], f["severity"], f["rule"], f["fix"], f["cx_upside"])),
    )))
    fixes = F.when(F.size(v["top_fixes"]) > 0, F.concat(F.array(F.lit("- Top fixes by risk:")), F.transform(v["top_fixes"], lambda f: text("  - ", f)))).otherwise(none)
    lines = F.concat(
        F.array(
            text(f"# {title} — ", F.col("journey"), f" — {date}"), F.lit(""), F.lit("## Verdict at a glance"),
            text("- Screens reviewed: ", v["screens_reviewed"], " | 🔴 ", v["violations"], " violations | 🟡 ", v["risks"], " risks | 🟢 ", v["compliant"], " compliant | ⚪ ", v["unverifiable"], " unverifiable"),
            text("- Compliance score: ", v["compliance_score"], "/100"), text("- Ship recommendation: ", v["ship_recommendation"]),
        ),
        fixes,
        F.when(F.col("summary") != "", F.array(F.lit(""), F.col("summary"))).otherwise(none),
        F.array(F.lit(""), F.lit("## Screen-by-screen findings")), screens,
        F.array(F.lit(""), F.lit("## Banned-pattern checklist"), F.lit("| # | Pattern | Result | Evidence |"), F.lit("|---|---|---|---|")),
        F.transform("banned_patterns", lambda p: text("| ", p["id"], " | ", markdown_cell(p["pattern"]), " | ", p["result"], " | ", markdown_cell(p["note"]), " |")),
        F.array(F.lit(""), F.lit("## Fix backlog (ordered)")),
        F.transform("fix_backlog", lambda b: text(b["priority"], ". ", mark(b["severity"]), " [", b["screen"], "] ", b["change"], " — _", b["owner"], "_")),
        F.when(F.size("unverifiable") > 0, F.concat(F.array(F.lit(""), F.lit("## Couldn't verify")), F.transform("unverifiable", lambda u: text("- ", u["what"], " → ", u["how_to_settle"])))).otherwise(none),
        F.when(F.col("design_spec_markdown") != "", F.array(F.lit(""), F.lit("---"), F.col("design_spec_markdown"))).otherwise(none),
        F.array(F.lit(""), F.lit("_This review informs design decisions and is not legal sign-off._")),
    )
    return audits.withColumn("markdown", F.array_join(lines, "\n"))
