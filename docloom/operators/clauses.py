"""Sections to clauses: markers, hierarchical paths, spans; and locating sections by their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import STRONG_TITLE_MATCH, TITLE_MATCH
from docloom.functions.fuzzy import title_score
from docloom.functions.text import WS, bound, found

# Marker shapes, and words that follow a number which is cited, not opened.
DOTTED = r"^[ \t]*(\d{1,3}(?:\.\d{1,3})+)\.?[ \t]+"
ROMAN = r"^[ \t]*\(((?i)[ivxlcd]+)\)[ \t]+"
ALPHA = r"^[ \t]*\(([a-z])\)[ \t]+"
ALPHA_PAREN = r"^[ \t]*([a-z])\)[ \t]+"
CITING_WORDS = ("above", "below", "to", "and", "or", "thereof", "herein", "hereof", "read")
EDGES = f"^{WS}+|{WS}+$"
HEADING = r"^[ \t]*(\d+)\.[ \t]+(\S[^\n]*)"
MIN_CLAUSE = 3


def first_word(tail: Column) -> Column:
    return F.regexp_extract(F.lower(F.regexp_replace(tail, r"^\s+", "")), "^[a-z]*", 0)


def mark_lines(sections: DataFrame, roman_context: bool = False) -> DataFrame:
    """Lines of sections (doc_id, section_no, part, body_start, text) with offset in the section, kind and marker.

    A line has at most one marker: every shape is tied to the line's start. Single letters that are roman digits, such
    as (c) and (d), count as roman unless `roman_context` is set; then they do so only after a roman marker.
    """
    lines = sections.withColumn("_lines", F.split("text", "\n", -1))
    each = lines.select("doc_id", "section_no", "part", "body_start", F.length("text").alias("section_length"), "_lines", F.posexplode("_lines").alias("line_no", "line"))
    line = F.col("line")
    opening = F.regexp_extract(line, DOTTED, 0)
    following = F.array_join(F.slice("_lines", F.col("line_no") + 1, F.lit(26)), "\n")
    cited = first_word(F.substring(following, F.length(opening) + 1, F.lit(24))).isin(*CITING_WORDS)

    def read(m: Column) -> Column:
        kind = F.when(m["dotted"].isNotNull(), F.when(~cited, "dotted")).when(m["roman"].isNotNull(), "roman").when(m["alpha"].isNotNull(), "alpha").when(m["paren"].isNotNull(), "alpha_paren")
        return bound(kind, lambda k: F.struct(k.alias("kind"), F.when(k.isNotNull(), F.lower(F.coalesce(m["dotted"], m["roman"], m["alpha"], m["paren"]))).alias("marker")))

    shapes = F.struct(*[found(line, p, 1).alias(name) for name, p in (("dotted", DOTTED), ("roman", ROMAN), ("alpha", ALPHA), ("paren", ALPHA_PAREN))])
    marked = each.withColumn("_mark", bound(shapes, read)).select(*[c for c in each.columns if c != "_lines"], F.col("_mark")["kind"].alias("kind"), F.col("_mark")["marker"].alias("marker"))
    section = Window.partitionBy("doc_id", "section_no").orderBy("line_no")
    offset = F.coalesce(F.sum(F.length("line") + 1).over(section.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("offset", offset.cast("bigint"))
    if roman_context:
        before = F.last("marker", ignorenulls=True).over(section.rowsBetween(Window.unboundedPreceding, -1))
        single = (F.col("kind") == "roman") & F.col("marker").isin("c", "d", "l", "x", "v", "i")
        follows = before == F.chr(F.ascii("marker") - 1)
        marked = marked.withColumn("kind", F.when(single & F.coalesce(follows, F.lit(False)), "alpha").otherwise(F.col("kind")))
    return marked


def split_clauses(sections: DataFrame, roman_context: bool = False) -> DataFrame:
    """doc_id, section_no, part, clause_path, char_start, char_end and text of every clause.

    One shuffle by section serves all windows, and one sort by line all those over lines; a repeated path gets a #n
    suffix, counted before short clauses go.
    """
    lines = mark_lines(sections, roman_context)
    order = Window.partitionBy("doc_id", "section_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    base = F.when(F.col("part") != "", F.concat_ws(".", "part", F.col("section_no").cast("string"))).otherwise(F.col("section_no").cast("string"))
    own = F.split_part("marker", F.lit("."), F.lit(1)) == F.col("section_no").cast("string")
    full = F.when(own, F.when(F.col("part") != "", F.concat_ws(".", "part", "marker")).otherwise(F.col("marker"))).otherwise(F.concat_ws(".", base, "marker"))
    dotted, lettered = F.col("kind") == "dotted", F.col("kind").isin("alpha", "alpha_paren")
    # The letter that is open: a dotted marker closes it, so what stands last is a letter or none.
    opens = F.when(dotted, F.struct(F.lit(None).cast("string").alias("x"))).when(lettered, F.struct(F.col("marker").alias("x")))
    lines = lines.withColumns({"nth": F.count("kind").over(order), "stem": F.coalesce(F.last(F.when(dotted, full), ignorenulls=True).over(order), base), "letter": F.last(opens, ignorenulls=True).over(order)["x"]})
    stem, letter = F.col("stem"), F.col("letter")
    path = (
        F.when(dotted, stem)
        .when(F.col("kind") == "roman", F.concat_ws(".", stem, F.coalesce(letter, F.lit("_")), "marker"))
        .when(F.col("kind").isNotNull(), F.concat_ws(".", stem, "marker"))
    )
    lines = lines.withColumns({"path": path, "base": base})
    held = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    # A clause ends behind its last line's end, where the next one starts; behind the section's last line there is none.
    clauses = lines.groupBy("doc_id", "section_no", "nth").agg(
        F.first("part").alias("part"), F.first("body_start").alias("body_start"), F.min("offset").alias("start"), F.least(F.max(F.col("offset") + F.length("line") + 1), F.first("section_length").cast("bigint")).alias("end"),
        F.coalesce(F.max("path"), F.first("base")).alias("path"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("raw"),
    )
    repeat = F.row_number().over(Window.partitionBy("doc_id", "section_no", "path").orderBy("nth"))
    found_clauses = clauses.withColumns({"repeat": repeat, "text": F.regexp_replace("raw", r"^\s+|\s+$", "")})
    return found_clauses.where(F.length("text") >= MIN_CLAUSE).select(
        "doc_id", "section_no", "part", F.when(F.col("repeat") == 1, F.col("path")).otherwise(F.concat_ws("#", "path", F.col("repeat").cast("string"))).alias("clause_path"),
        (F.col("body_start") + F.col("start")).alias("char_start"), (F.col("body_start") + F.col("end")).alias("char_end"), "text",
    )


def duplicates(clauses: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one clause has."""
    return clauses.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def heading_candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Lines of each document that open with the number of one of its body sections, and how well the titles match.

    A text is cut before its heading lines by one search, so other lines are no rows of their own.
    """
    cuts = texts.select("doc_id", "body_from", F.posexplode(F.split("text", f"\\n(?={HEADING[1:]})", -1)).alias("nth", "cut"))
    before = Window.partitionBy("doc_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    line = bound(F.regexp_extract("cut", HEADING, 0), lambda x: F.struct(F.regexp_extract(x, HEADING, 1).alias("number"), F.regexp_extract(x, HEADING, 2).alias("heading")))
    held = cuts.select("doc_id", "body_from", "nth", (F.length("cut") + 1).alias("n"), line.alias("line"))
    placed = held.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))
    opened = placed.where("line.number != '' and offset >= body_from").select("doc_id", "offset", "line.number", "line.heading")
    titles = index.where("block = 'body'").select("doc_id", F.col("section_no").cast("string").alias("number"), "section_no", "title")
    return opened.join(titles, ["doc_id", "number"]).withColumn("score", title_score(F.col("heading"), F.col("title")))


def locate_sections(texts: DataFrame, index: DataFrame) -> DataFrame:
    """Section spans of documents (doc_id, text, body_from): headings found in order, moving only forwards.

    Candidates are found and scored relationally; only the choice, which depends on the ones before it, runs over each
    document's few candidates, once. Sections without a match have a null char_start, so gaps can be told from spans.
    """
    tried = heading_candidates(texts, index).groupBy("doc_id", "section_no").agg(F.sort_array(F.collect_list(F.struct("offset", "score", "heading"))).alias("lines"))
    body = index.where("block = 'body'").select(*[F.col(c).alias(c) for c in ("doc_id", "part", "section_no", "title", "start_page")])
    section = F.struct("section_no", "part", "title", "start_page", "lines")
    listed = body.join(tried, ["doc_id", "section_no"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(section)).alias("sections"))
    chosen = listed.select("doc_id", bound(_choose_lines(F.col("sections")), lambda x: F.struct(x.alias("rows"), F.array_max(F.transform(x, lambda r: r["char_start"])).alias("after"))).alias("_x"))
    first = index.where("block = 'annexure'").groupBy("doc_id").agg(F.min_by("title", "section_no").alias("_title"))
    known = texts.select(F.col("doc_id").alias("doc_id"), "text").join(chosen, "doc_id").join(first, "doc_id", "left")
    ends = known.select("doc_id", "_x.rows", F.length("text").cast("bigint").alias("_n"), annexure_start(F.col("text"), F.col("_title"), F.col("_x.after")).alias("_annexure"))
    # The outer form: the inner one would have the fold evaluated again, as a filter for arrays that aren't empty.
    return _section_ends(ends.select("doc_id", F.inline_outer("rows"), "_n", "_annexure")).drop("_n", "_annexure")


def _choose_lines(sections: Column) -> Column:
    """One document's sections, in order, with the line that opens each: the best match behind the section before, or the
    first strong one if that comes earlier. A fold over the sections, whose state is where the last one was found; of
    each section it keeps a number only, so its cost is that of the candidates."""
    start = F.struct(F.lit(0).cast("bigint").alias("behind"), F.array().cast("array<int>").alias("picks"))

    def step(state: Column, s: Column) -> Column:
        def best(lines: Column) -> Column:
            """Place of the first of the best lines ahead, up to the first strong one."""
            scores = F.transform(lines, lambda x: F.when(x["offset"] >= state["behind"], F.struct(x["score"].alias("score"))))
            strong = F.array_position(F.transform(scores, lambda x: x["score"] >= STRONG_TITLE_MATCH), True)
            ranked = lambda n: F.array_max(F.transform(scores, lambda x, i: F.when(x.isNotNull() & ((n == 0) | (i < n)), F.struct(x["score"].alias("score"), (-i).alias("i")))))
            return -bound(strong, ranked)["i"]

        def taken(pick: Column) -> Column:
            x = F.get(s["lines"], pick)
            return F.struct(F.when(x["score"] >= TITLE_MATCH, x["offset"] + 1).otherwise(state["behind"]).alias("behind"), F.concat(state["picks"], F.array(pick)).alias("picks"))

        return bound(best(s["lines"]), taken)

    def told(picks: Column) -> Column:
        def row(s: Column, i: Column) -> Column:
            def of(best: Column) -> Column:
                good = F.coalesce(best["score"] >= TITLE_MATCH, F.lit(False))
                return F.struct(
                    s["part"].alias("part"), s["section_no"].alias("section_no"), s["title"].alias("title"), s["start_page"].alias("start_page"), F.when(good, best["offset"]).alias("char_start"),
                    F.when(good, F.regexp_replace(best["heading"], EDGES, "")).alias("heading"), best["score"].alias("match_score"),
                )

            return bound(F.get(s["lines"], F.get(picks, i)), of)

        return F.transform(sections, row)

    return bound(F.aggregate(sections, start, step, lambda state: state["picks"]), told)


def annexure_start(text: Column, title: Column, after: Column) -> Column:
    """Offset after `after` of the line that opens annexure 1: by the first annexure's own words, else by the word
    Annexure; null without annexures or such a line."""
    own = F.regexp_replace(F.trim(F.split_part(title, F.lit("-"), F.lit(1))), r"[0-9 \-]+$", "")
    rest = F.substring(text, (after + 1).cast("int"), F.length(text))

    def at(lead: Column) -> Column:
        pattern = F.concat(F.lit(r"(?im)^[ \t]*\Q"), lead, F.lit("\\E\\s*[-\u2013\u2014]?\\s*1\\b"))
        place = F.regexp_instr(rest, pattern)
        return F.when(place > 0, place - 1 + after)

    words = F.when(own == "", "Annexure").otherwise(own)
    return F.when(title.isNotNull() & after.isNotNull(), F.coalesce(at(words), at(F.lit("Annexure")))).cast("bigint")


def _section_ends(spans: DataFrame) -> DataFrame:
    """A section ends where the next one starts; the last one at the annexures or the end of the text."""
    order = Window.partitionBy("doc_id").orderBy(F.col("char_start").asc_nulls_last())
    last = F.when(F.col("_annexure") > F.col("char_start"), F.col("_annexure")).otherwise(F.col("_n"))
    return spans.withColumn("char_end", F.when(F.col("char_start").isNotNull(), F.coalesce(F.lead("char_start").over(order), last)))
