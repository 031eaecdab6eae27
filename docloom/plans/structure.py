"""Queries on clauses, contents, headers, registers and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import changes, clauses, contents, coverage, registers
from docloom.operators import documents as docs
from docloom.plans.registry import ORACLES, Tables, query
from docloom.plans.texts import _subsequences
from docloom.sources import writers
from docloom.sources.synthetic import CLAUSE_LINES, CONTENTS_LINES, CONTENTS_ROWS

# ------------------------------------------------------------------ clauses

LINES = f"""
SELECT doc_id, section_no, part, rn, line, CAST(coalesce(sum(length(line) + 1) OVER w, 0) AS BIGINT) AS off, lead(line) OVER (PARTITION BY doc_id, section_no ORDER BY rn) AS next_line,
  regexp_extract(line, '^[ \\t]*(\\d{{1,3}}(?:\\.\\d{{1,3}})+)\\.?[ \\t]+', 1) AS dotted, regexp_extract(line, '^[ \\t]*\\d{{1,3}}(?:\\.\\d{{1,3}})+\\.?[ \\t]+(.*)', 1) AS tail, regexp_extract(line, '(?i)^[ \\t]*\\(([ivxlcd]+)\\)[ \\t]+', 1) AS roman,
  regexp_extract(line, '^[ \\t]*\\(([a-z])\\)[ \\t]+', 1) AS alpha, regexp_extract(line, '^[ \\t]*([a-z])\\)[ \\t]+', 1) AS paren
FROM ({CLAUSE_LINES}) l WINDOW w AS (PARTITION BY doc_id, section_no ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
MARKED = f"""
SELECT *, CASE kind WHEN 'dotted' THEN dotted WHEN 'roman' THEN lower(roman) WHEN 'alpha' THEN alpha WHEN 'alpha_paren' THEN paren END AS marker FROM (
  SELECT *, CASE WHEN dotted <> '' THEN CASE WHEN regexp_extract(lower(trim(substr(tail || chr(10) || coalesce(next_line, ''), 1, 24))), '^[a-z]*') IN ('above', 'below', 'to', 'and', 'or', 'thereof', 'herein', 'hereof', 'read') THEN NULL ELSE 'dotted' END
    WHEN roman <> '' THEN 'roman' WHEN alpha <> '' THEN 'alpha' WHEN paren <> '' THEN 'alpha_paren' END AS kind FROM ({LINES}))"""


def _sections(t: Tables) -> DataFrame:
    """Section texts from lines; sections are of bounded length.

    A section's lines are those of one order, by which they are numbered already: with it in the key they stay in place.
    """
    lines = t.sql(CLAUSE_LINES)
    held = F.sort_array(F.collect_list(F.struct("rn", "line")))
    sections = lines.groupBy("l_orderkey", "doc_id", "section_no").agg(F.first("part").alias("part"), F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text"))
    return sections.drop("l_orderkey").withColumn("body_start", F.lit(0).cast("bigint"))


@query(f"SELECT doc_id, section_no, CAST(rn - 1 AS INT) AS line_no, off AS \"offset\", kind, marker FROM ({MARKED}) WHERE kind IS NOT NULL")
def clause_markers(t: Tables) -> DataFrame:
    return clauses.mark_lines(_sections(t)).where("kind is not null").select("doc_id", "section_no", "line_no", "offset", "kind", "marker")


BASE = "CASE WHEN part <> '' THEN part || '.' || section_no ELSE CAST(section_no AS VARCHAR) END"
GROUPED = f"""
SELECT *, count(kind) OVER s AS nth, count(CASE WHEN kind = 'dotted' THEN 1 END) OVER s AS opened FROM ({MARKED}) WINDOW s AS (PARTITION BY doc_id, section_no ORDER BY rn)"""
PATHS = f"""
SELECT *, CASE kind WHEN 'dotted' THEN dp WHEN 'roman' THEN coalesce(last_value(dp IGNORE NULLS) OVER o, {BASE}) || '.' || coalesce(last_value(CASE WHEN kind IN ('alpha', 'alpha_paren') THEN marker END IGNORE NULLS) OVER o, '_') || '.' || marker
  WHEN 'alpha' THEN coalesce(last_value(dp IGNORE NULLS) OVER o, {BASE}) || '.' || marker WHEN 'alpha_paren' THEN coalesce(last_value(dp IGNORE NULLS) OVER o, {BASE}) || '.' || marker END AS path
FROM (SELECT *, CASE WHEN kind = 'dotted' THEN CASE WHEN split_part(marker, '.', 1) = CAST(section_no AS VARCHAR) THEN CASE WHEN part <> '' THEN part || '.' || marker ELSE marker END ELSE {BASE} || '.' || marker END END AS dp FROM ({GROUPED}))
WINDOW o AS (PARTITION BY doc_id, section_no, opened ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CLAUSES = f"""
SELECT *, coalesce(lead(char_start) OVER (PARTITION BY doc_id, section_no ORDER BY nth), total) AS char_end, row_number() OVER (PARTITION BY doc_id, section_no, path ORDER BY nth) AS k FROM (
  SELECT doc_id, section_no, nth, min(off) AS char_start, coalesce(max(path), max({BASE})) AS path, trim(string_agg(line, chr(10) ORDER BY rn)) AS text, max(sum(length(line) + 1)) OVER (PARTITION BY doc_id, section_no) AS unused,
    CAST(sum(sum(length(line) + 1)) OVER (PARTITION BY doc_id, section_no) - 1 AS BIGINT) AS total FROM ({PATHS}) GROUP BY doc_id, section_no, nth)"""


@query(f"SELECT doc_id, section_no, CASE WHEN k = 1 THEN path ELSE path || '#' || k END AS clause_path, char_start, char_end, sha256(text) AS digest FROM ({CLAUSES}) WHERE length(text) >= 3")
def clause_spans(t: Tables) -> DataFrame:
    return clauses.split_clauses(_sections(t)).select("doc_id", "section_no", "clause_path", "char_start", "char_end", F.sha2("text", 256).alias("digest"))


@query(f"SELECT CASE WHEN contains(path, '_') THEN 'padded' WHEN k > 1 THEN 'repeated' ELSE 'plain' END AS shape, count(*) AS n, count(DISTINCT doc_id || '/' || section_no) AS sections FROM ({CLAUSES}) WHERE length(text) >= 3 GROUP BY 1")
def clause_paths(t: Tables) -> DataFrame:
    path = F.col("clause_path")
    shape = F.when(path.contains("_"), "padded").when(path.contains("#"), "repeated").otherwise("plain")
    return clauses.split_clauses(_sections(t)).groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("/", "doc_id", F.col("section_no").cast("string"))).alias("sections"))


@query(f"""WITH w AS (SELECT doc_id, section_no, string_agg(line, chr(10) ORDER BY rn) AS whole FROM ({CLAUSE_LINES}) GROUP BY ALL), c AS (SELECT * FROM ({CLAUSES}) JOIN w USING (doc_id, section_no) WHERE length(text) >= 3)
SELECT count(*) AS clauses, count(CASE WHEN regexp_replace(whole[char_start + 1 : char_end], '^\\s+|\\s+$', '', 'g') = regexp_replace(text, '^\\s+|\\s+$', '', 'g') THEN 1 END) AS resolved,
  count(*) - count(DISTINCT doc_id || '/' || section_no || '/' || path || '#' || k) AS duplicate_paths FROM c""")
def anchor_resolves(t: Tables) -> DataFrame:
    found = clauses.split_clauses(_sections(t))
    cut = F.regexp_replace(F.substring(F.col("whole"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int")), r"^\s+|\s+$", "")
    joined = found.join(_sections(t).select("doc_id", "section_no", F.col("text").alias("whole")), ["doc_id", "section_no"])
    # Clauses are counted by path first, which needs no other shuffle and no second split.
    by_path = joined.groupBy("doc_id", "section_no", "clause_path").agg(F.count("*").alias("n"), F.count(F.when(cut == F.col("text"), 1)).alias("k"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("bigint"))
    return by_path.agg(total("n").alias("clauses"), total("k").alias("resolved"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_paths"))


@query(f"SELECT doc_id, section_no, path, count(*) AS n FROM ({CLAUSES}) GROUP BY ALL HAVING count(*) > 1")
def duplicate_paths(t: Tables) -> DataFrame:
    base = clauses.split_clauses(_sections(t)).withColumn("path", F.regexp_replace("clause_path", "#.*$", ""))
    return clauses.duplicates(base, "doc_id", "section_no", "path")


IN_CONTEXT = f"""SELECT * REPLACE (CASE WHEN kind = 'roman' AND marker IN ('c', 'd', 'l', 'x', 'v', 'i') AND before = chr(ascii(marker) - 1) THEN 'alpha' ELSE kind END AS kind) FROM (
  SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id, section_no ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({MARKED}))"""


@query(f"SELECT doc_id, section_no, CASE WHEN k = 1 THEN path ELSE path || '#' || k END AS clause_path, char_start, char_end FROM ({CLAUSES.replace(MARKED, IN_CONTEXT)}) WHERE length(text) >= 3")
def clause_paths_roman_context(t: Tables) -> DataFrame:
    return clauses.split_clauses(_sections(t), roman_context=True).select("doc_id", "section_no", "clause_path", "char_start", "char_end")


# ----------------------------------------------------------------- contents

ROWS = f"SELECT *, trim(regexp_replace(c0, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(c1, '\\s+', ' ', 'g')) AS b, trim(c2) AS p FROM ({CONTENTS_ROWS})"
PART = "'^\\s*([IVXL]+)\\.\\s+([A-Z][A-Z &,/\\-\\.'']{3,})\\s*$'"
STATE = f"""
SELECT *, last_value(CASE WHEN annexed_here THEN NULL WHEN pa <> '' THEN pa WHEN a = '' AND pb <> '' THEN pb END IGNORE NULLS) OVER (PARTITION BY doc_id, annexed ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM (
  SELECT *, bool_or(annexed_here) OVER (PARTITION BY doc_id ORDER BY row_no) AS annexed FROM (
    SELECT *, regexp_matches(a, '(?i)^\\s*Annexures?\\s*$') AS annexed_here, regexp_extract(a, {PART}, 1) AS pa, regexp_extract(b, {PART}, 1) AS pb FROM ({ROWS})
    WHERE NOT (a = '' AND b = '') AND NOT (lower(a) LIKE 's. no%' OR lower(b) = 'subject')))"""
TITLE = "trim(trim(regexp_replace(trim(b), '[.\\x{2026}]{3,}\\s*\\d*\\s*$', '')), ' .…-')"
INDEX = f"""SELECT doc_id, row_no, CASE WHEN annexed THEN 'annexure' ELSE 'body' END AS block, part, CAST(regexp_extract(a, '^\\s*(\\d{{1,3}})\\.?\\s*$', 1) AS INT) AS section_no, {TITLE} AS title,
  CASE WHEN regexp_matches(p, '^\\s*\\d{{1,4}}\\s*$') THEN CAST(p AS INT) ELSE 0 END AS start_page FROM ({STATE}) WHERE regexp_matches(a, '^\\s*\\d{{1,3}}\\.?\\s*$') AND b <> '' AND NOT (a = '' AND pb <> '')"""


def _contents(t: Tables) -> DataFrame:
    return t.sql(CONTENTS_ROWS).select("doc_id", "row_no", F.array("c0", "c1", "c2").alias("cells"))


def _index(t: Tables) -> DataFrame:
    return contents.parse_rows(_contents(t))


@query(INDEX)
def toc_parse(t: Tables) -> DataFrame:
    return _index(t)


@query(f"SELECT doc_id, row_no, (regexp_matches(a, '^\\s*\\d{{1,3}}\\.?\\s*$') AND b <> '') OR regexp_matches(a, {PART}) OR regexp_matches(a, '(?i)^\\s*Annexures?\\s*$') AS alike FROM ({ROWS})")
def toc_row_predicate(t: Tables) -> DataFrame:
    return _contents(t).select("doc_id", "row_no", contents.looks_like_row(F.col("cells")).alias("alike"))


@query(f"SELECT doc_id, block, coalesce(part, '-') AS part, count(*) AS n FROM ({INDEX}) GROUP BY ALL")
def toc_block_part(t: Tables) -> DataFrame:
    return _index(t).groupBy("doc_id", "block", F.coalesce("part", F.lit("-")).alias("part")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, block, len(have) AS numbers, largest, array_to_string(list_sort(list_filter(range(1, largest + 1), lambda x: NOT list_contains(have, x))), ',') AS missing FROM (
  SELECT doc_id, block, list_distinct(list(section_no)) AS have, max(section_no) AS largest FROM ({INDEX}) GROUP BY ALL)""")
def toc_contiguity(t: Tables) -> DataFrame:
    return contents.missing_numbers(_index(t)).withColumn("numbers", F.col("numbers").cast("bigint"))


@query(f"SELECT doc_id, block, section_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block <> 'body', start_page, section_no, row_no) AS INT) AS place FROM ({INDEX})")
def toc_order(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy(F.col("block") != "body", "start_page", "section_no", "row_no")
    return _index(t).select("doc_id", "block", "section_no", F.row_number().over(order).alias("place"))


@query(f"""WITH i AS ({INDEX}), p AS (SELECT doc_id, string_agg(part, ',' ORDER BY pos) AS parts FROM (SELECT doc_id, part, min(row_no) AS pos FROM i WHERE part <> '' GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, count(*) AS entries, count(DISTINCT block || '/' || coalesce(part, '-') || '/' || section_no) AS unique_keys, count(CASE WHEN block = 'body' THEN 1 END) AS body, count(CASE WHEN block = 'annexure' THEN 1 END) AS annexure,
  count(DISTINCT section_no) AS section_numbers, coalesce(max(parts), '') AS parts FROM i LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def index_summary(t: Tables) -> DataFrame:
    return coverage.index_summary(_index(t))


TEXT_LINES = f"SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, trim(line) AS s FROM ({CONTENTS_LINES})"
EDGE = f"(s = '' OR regexp_matches(s, '^\\s*\\d{{1,3}}\\.\\s+\\d{{1,4}}\\s*$') OR regexp_matches(s, '^\\s*\\d{{1,3}}\\.\\s*$') OR regexp_matches(s, '^\\s*\\d{{1,3}}\\.\\s+\\S.*?\\s+\\d{{1,4}}\\s*$') OR regexp_matches(s, {PART}) OR regexp_matches(s, '(?i)^\\s*Annexures?\\s*$') OR lower(s) LIKE 's. no%' OR lower(s) LIKE 'table of contents%')"
CLEAN = "trim(trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '[.\\x{{2026}}]{{3,}}\\s*\\d*\\s*$', '')), ' .…-')"


def _text_pages(t: Tables) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct("n", "line")))
    return t.sql(CONTENTS_LINES).groupBy("doc_id", "page_no").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("text"))


def _recovered(t: Tables, which: int) -> DataFrame:
    return contents.recover_rows(_text_pages(t)).where(F.col("pass") == which).select("doc_id", F.col("source_line").cast("bigint").alias("source_line"), "section_no", "title", "page")


@query(f"""SELECT doc_id, i AS source_line, CAST(regexp_extract(s, '^(\\d{{1,3}})\\.', 1) AS INT) AS section_no, {CLEAN.format(x="regexp_extract(s, '^\\d{1,3}\\.\\s+(\\S.*?)\\s+\\d{1,4}$', 1)")} AS title, CAST(regexp_extract(s, '(\\d{{1,4}})$', 1) AS INT) AS page
FROM ({TEXT_LINES}) WHERE regexp_matches(s, '^\\d{{1,3}}\\.\\s+\\S.*?\\s+\\d{{1,4}}$')""")
def toc_recover_full(t: Tables) -> DataFrame:
    return _recovered(t, 2)


@query(f"""SELECT doc_id, i AS source_line, CAST(regexp_extract(s, '^(\\d{{1,3}})\\.', 1) AS INT) AS section_no, {CLEAN.format(x="regexp_extract(s, '^\\d{1,3}\\.\\s+(\\S.*?)$', 1)")} AS title, CAST(0 AS INT) AS page
FROM ({TEXT_LINES}) WHERE regexp_matches(s, '^\\d{{1,3}}\\.\\s+\\D') AND NOT regexp_matches(s, '\\s\\d{{1,4}}$')""")
def toc_recover_pageless(t: Tables) -> DataFrame:
    return _recovered(t, 3)


@query(f"""WITH l AS (SELECT *, {EDGE} AS edge, last_value(CASE WHEN s <> '' THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
  last_value(CASE WHEN s <> '' THEN {EDGE} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_edge FROM ({TEXT_LINES})), g AS (SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l),
a AS (SELECT doc_id, run, string_agg(s, ' ' ORDER BY i) AS after FROM g WHERE NOT edge GROUP BY ALL),
n AS (SELECT g.doc_id, i, regexp_extract(s, '^(\\d{{1,3}})\\.', 1) AS no, regexp_extract(s, '^\\d{{1,3}}\\.\\s+(\\d{{1,4}})$', 1) AS pg, CASE WHEN NOT coalesce(prior_edge, true) THEN prior ELSE '' END AS lead_text, coalesce(after, '') AS after FROM g LEFT JOIN a USING (doc_id, run) WHERE regexp_matches(s, '^\\d{{1,3}}\\.(\\s+\\d{{1,4}})?$')),
r AS (SELECT *, pg = '' AND regexp_matches(lead_text, '\\s\\d{{1,4}}$') AS rides FROM n), f AS (SELECT doc_id, i AS source_line, CAST(no AS INT) AS section_no, {CLEAN.format(x="trim(CASE WHEN rides THEN regexp_extract(lead_text, '^(.*?)\\s+\\d{1,4}$', 1) ELSE lead_text END || ' ' || after)")} AS title,
  CASE WHEN pg <> '' THEN CAST(pg AS INT) WHEN rides THEN CAST(regexp_extract(lead_text, '(\\d{{1,4}})$', 1) AS INT) ELSE 0 END AS page FROM r) SELECT * FROM f WHERE title <> '' AND page <> 0""")
def toc_recover_wrapped(t: Tables) -> DataFrame:
    return _recovered(t, 1)


BODY = f"SELECT * FROM ({INDEX}) WHERE block = 'body'"
FOUND = "SELECT 'd' || CAST(CAST(floor(o_orderkey / 40.0) AS BIGINT) AS STRING) AS doc_id, 'body' AS block, CAST(o_orderkey % 40 AS INT) AS section_no, o_orderpriority AS title, CAST(o_custkey % 3 AS INT) AS page_no, CAST(1 AS INT) AS pass, CAST(o_orderkey AS BIGINT) AS source_line FROM {orders}"


@query(f"""SELECT doc_id, block, section_no, title, source_line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block, section_no ORDER BY page_no, pass, source_line) AS k FROM ({FOUND}) r
  WHERE NOT EXISTS (SELECT 1 FROM ({INDEX}) i WHERE i.doc_id = r.doc_id AND i.block = r.block AND i.section_no = r.section_no)) WHERE k = 1""")
def toc_antijoin_merge(t: Tables) -> DataFrame:
    return contents.absent_rows(_index(t), t.sql(FOUND)).select("doc_id", "block", "section_no", "title", "source_line")


@query(f"""SELECT r.doc_id, r.source_line, r.section_no, (SELECT arg_max(struct_pack(p := i.part), i.section_no).p FROM ({INDEX}) i WHERE i.doc_id = r.doc_id AND i.block = r.block AND i.section_no < r.section_no) AS part FROM ({FOUND}) r""")
def toc_part_asof(t: Tables) -> DataFrame:
    return contents.inherit_part(t.sql(FOUND), _index(t)).select("doc_id", "source_line", "section_no", "part")


# Recovered rows in order, a state for each: furthest page, keys taken, and where the row went if it was merged.
MERGED = f"""i AS MATERIALIZED ({INDEX}), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass, source_line) AS n FROM (
  SELECT *, 1 AS pass FROM ({ORACLES['toc_recover_wrapped']}) UNION ALL BY NAME SELECT *, 2 AS pass FROM ({ORACLES['toc_recover_full']}) UNION ALL BY NAME SELECT *, 3 AS pass FROM ({ORACLES['toc_recover_pageless']}))),
b AS MATERIALIZED (SELECT d.doc_id, coalesce(max(start_page), 0) AS reach, min(CASE WHEN block = 'annexure' THEN start_page END) AS annexed_from, coalesce(list(DISTINCT block || '/' || section_no) FILTER (WHERE section_no IS NOT NULL), []) AS has FROM (SELECT DISTINCT doc_id FROM r) d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id),
w AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, reach, has AS taken, CAST(NULL AS INTEGER) AS section_no, CAST(NULL AS VARCHAR) AS block, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS INTEGER) AS start_page, false AS merged, false AS page_inferred FROM b
  UNION ALL SELECT doc_id, n, CASE WHEN list_contains(taken, key) THEN reach ELSE greatest(reach, at_page) END, CASE WHEN list_contains(taken, key) THEN taken ELSE list_append(taken, key) END, section_no, block, title, at_page, NOT list_contains(taken, key), page_inferred FROM (
    SELECT *, block || '/' || section_no AS key FROM (SELECT w.doc_id, r.n, w.reach, w.taken, r.section_no, r.title, CASE WHEN r.page <> 0 THEN r.page ELSE w.reach END AS at_page, CASE WHEN CASE WHEN r.page <> 0 THEN r.page ELSE w.reach END >= b.annexed_from THEN 'annexure' ELSE 'body' END AS block, r.page = 0 AS page_inferred
      FROM w JOIN r ON r.doc_id = w.doc_id AND r.n = w.n + 1 JOIN b ON b.doc_id = w.doc_id))),
f AS MATERIALIZED (SELECT doc_id, block, section_no, arg_min(struct_pack(p := part), row_no).p AS part FROM i GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {MERGED} SELECT doc_id, block, part, section_no, title, start_page, false AS recovered, false AS page_inferred FROM i
UNION ALL SELECT doc_id, block, (SELECT arg_max(struct_pack(p := f.part), f.section_no).p FROM f WHERE f.doc_id = w.doc_id AND f.block = w.block AND f.section_no < w.section_no), section_no, title, start_page, true, page_inferred FROM w WHERE merged""")
def toc_merge(t: Tables) -> DataFrame:
    return contents.merge_index(_index(t), contents.recover_rows(_text_pages(t)))


PAGED = "SELECT 'd' || CAST(CAST(floor(o_orderkey / 24.0) AS BIGINT) AS STRING) AS doc_id, CAST(o_orderkey % 24 + 1 AS INT) AS page_no, CASE WHEN o_orderkey % 24 = 3 THEN 'Table of  Contents' ELSE 'page' END AS text, CAST(o_custkey % 5 AS INT) AS k, o_orderpriority AS title FROM {orders}"


@query(f"""WITH p AS (SELECT *, min(CASE WHEN regexp_matches(text, '(?i)TABLE\\s+OF\\s+CONTENTS') AND page_no <= 20 THEN page_no END) OVER (PARTITION BY doc_id) AS first, k >= 2 AS good FROM ({PAGED}))
SELECT doc_id, page_no FROM (SELECT *, bool_and(page_no = first OR good) OVER (PARTITION BY doc_id ORDER BY page_no) AS run FROM p WHERE page_no >= first AND page_no <= first + 20) WHERE run""")
def toc_run_pages(t: Tables) -> DataFrame:
    row = F.array(F.lit("12."), F.col("title"), F.lit("9"))
    return contents.contents_pages(t.sql(PAGED).withColumn("tables", F.array(F.array_repeat(row, F.col("k"))))).select("doc_id", "page_no")


REGISTER = """SELECT 'd' || CAST(CAST(floor(o_orderkey / 24.0) AS BIGINT) AS STRING) AS doc_id, CAST(o_orderkey % 24 + 1 AS INT) AS page_no, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey % 24 AS STRING) || '.' ELSE 'x' END AS c0,
  CASE WHEN o_orderkey % 24 < 6 THEN '' WHEN o_custkey % 29 = 0 THEN 'Circular No.' ELSE 'CIR/' || CAST(o_custkey AS STRING) || '/95' || CASE WHEN o_custkey % 7 > 0 THEN ' dated  April ' || CAST(o_custkey % 28 + 1 AS STRING) || ', 1995.' ELSE '' END END AS c1, 'Para ' || CAST(o_custkey % 60 AS STRING) || '.' || CAST(o_orderkey % 9 AS STRING) || ', para 41.9 at page no. ' || CAST(o_custkey % 90 AS STRING) || ' of ' || o_orderpriority AS c2 FROM {orders}"""


@query(f"""WITH r AS (SELECT *, c1 <> '' AND NOT (lower(c0) LIKE 'sr%' OR lower(c1) LIKE 'circular%') AS real FROM ({REGISTER})), p AS (SELECT doc_id, page_no, count(CASE WHEN real THEN 1 END) AS n FROM r GROUP BY ALL),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM p), o AS (SELECT *, bool_or(n = 0 AND seen > 0) OVER (PARTITION BY doc_id ORDER BY page_no) AS over FROM s)
SELECT r.doc_id, r.page_no, CASE WHEN regexp_matches(c0, '^\\s*\\d{{1,3}}\\.?\\s*$') THEN CAST(regexp_extract(c0, '(\\d+)', 1) AS INT) END AS s_no, regexp_replace(c1, '\\s+', ' ', 'g') AS circular_no, nullif(regexp_extract(regexp_replace(c1, '\\s+', ' ', 'g'), 'dated\\s+([A-Z][a-z]+\\s+\\d{{1,2}},\\s*\\d{{4}})', 1), '') AS circular_date
FROM r JOIN o USING (doc_id, page_no) WHERE real AND NOT over""")
def appendix_scan(t: Tables) -> DataFrame:
    rows = t.sql(REGISTER).groupBy("doc_id", "page_no").agg(F.array(F.collect_list(F.array("c0", "c1", "c2"))).alias("tables")).withColumn("appendix_page", F.lit(1))
    return registers.appendix_entries(rows).select("doc_id", "page_no", "s_no", "circular_no", "circular_date")


@query(f"""SELECT doc_id, count(*) AS entries, count(DISTINCT s_no) AS serials, round(avg(CASE WHEN circular_date IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS dated_share FROM (
  SELECT doc_id, CASE WHEN regexp_matches(c0, '^\\d{{1,3}}\\.?$') THEN regexp_extract(c0, '(\\d+)', 1) END AS s_no, nullif(regexp_extract(c1, 'dated\\s+([A-Z][a-z]+\\s+\\d{{1,2}},\\s*\\d{{4}})', 1), '') AS circular_date FROM ({REGISTER}) WHERE c1 <> '' AND NOT lower(c1) LIKE 'circular%') GROUP BY doc_id""")
def appendix_completeness(t: Tables) -> DataFrame:
    rows = t.sql(REGISTER).where("c1 != '' and not lower(c1) like 'circular%'").select("doc_id", X.found(F.col("c0"), registers.SERIAL, 1).alias("s_no"), X.found(F.col("c1"), registers.DATED, 1).alias("circular_date"))
    return registers.appendix_completeness(rows)


@query(f"""SELECT doc_id, page_no, c2 AS description, array_to_string(list_sort(list_distinct(regexp_extract_all(c2, '(?i)Para\\s+(\\d+(?:\\.\\d+)*)', 1))), ';') AS paras, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(c2, '(?i)page\\s*no\\.?\\s*(\\d{{1,4}})', 1), lambda x: CAST(x AS INT)))), ';') AS pages,
  nullif(regexp_extract(c2, '\\b(?:SEBI/[A-Za-z0-9/\\-_()]+|[A-Z]{{2,}}/\\d[A-Za-z0-9/\\-_()]*)\\b'), '') AS source FROM ({REGISTER})""")
def change_refs(t: Tables) -> DataFrame:
    rows = t.sql(REGISTER).select("doc_id", "page_no", F.array("c0", "c2", F.lit("")).alias("cells"))
    found = registers.change_entries(rows)
    return found.select("doc_id", "page_no", "description", F.array_join("referenced_paras", ";").alias("paras"), F.array_join(F.transform("referenced_pages", lambda x: x.cast("string")), ";").alias("pages"), F.col("source_circular_no").alias("source"))


@query("SELECT 'd' || CAST(CAST(floor(o_orderkey / 24.0) AS BIGINT) AS VARCHAR) AS doc_id, min(CASE WHEN o_custkey % 6 = 0 THEN CAST(o_orderkey % 24 + 1 AS INT) END) AS changes_page, max(CASE WHEN o_custkey % 5 = 0 THEN CAST(o_orderkey % 24 + 1 AS INT) END) AS appendix_page FROM {orders} GROUP BY 1")
def register_pages(t: Tables) -> DataFrame:
    text = "SELECT 'd' || CAST(CAST(floor(o_orderkey / 24.0) AS BIGINT) AS STRING) AS doc_id, CAST(o_orderkey % 24 + 1 AS INT) AS page_no, CASE WHEN o_custkey % 6 = 0 THEN 'x' || chr(10) || 'Annexure - A' || chr(10) || 'List of Changes' WHEN o_custkey % 6 = 1 THEN 'List of Changes' ELSE '' END || CASE WHEN o_custkey % 5 = 0 THEN chr(10) || 'Appendix – List of Circulars' ELSE '' END AS text FROM {orders}"
    return registers.register_pages(t.sql(text))


# ------------------------------------------------------------------ headers

FRONT = """SELECT 'c' || CAST(c_custkey AS STRING) AS doc_id, CAST(c_custkey AS BIGINT) AS k, 'Preface text ' || chr(10) || CASE WHEN c_custkey % 23 = 0 THEN 'no number' WHEN c_custkey % 2 = 0 THEN 'SEBI/HO/MIRSD/PoD-1/P/CIR/2024/' || CAST(c_custkey AS STRING) ELSE 'HO/49/14/15(3)2026-CFD-POD1/I/' || CAST(c_custkey AS STRING) || '/2026' END
  || CASE WHEN c_custkey % 4 = 1 THEN chr(10) || 'Issued on: January 5, 2023' ELSE '' END || CASE WHEN c_custkey % 8 = 1 THEN chr(10) || 'Last updated on : March ' || CAST(c_custkey % 28 + 1 AS STRING) || ', 2025' ELSE '' END
  || ' May ' || CAST(c_custkey % 28 + 1 AS STRING) || ', 2024' || chr(10) || 'Subject: Master Circular for ' || CASE c_nationkey % 4 WHEN 0 THEN 'Stock Brokers.' WHEN 1 THEN 'Merchant Bankers' ELSE 'Research  Analysts & ' || c_mktsegment END || chr(10) || 'Master Circular dated June 16, 2023 and Master Circular dated August ' || CAST(c_custkey % 28 + 1 AS STRING) || ', 2023' AS text FROM {customer}"""
FIELDS = f"""SELECT doc_id, number AS circular_no, d AS circular_date, CASE WHEN contains(lower(label), 'stock brokers') THEN 'stock_broker' WHEN contains(lower(label), 'merchant bankers') THEN 'merchant_banker' ELSE left(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), 40) END AS intermediary, label AS intermediary_label,
  list_max(list_filter(list_transform(regexp_extract_all(text, '(?i)Master\\s+Circular\\s+dated\\s+([A-Z][a-z]{{2,8}}\\s+\\d{{1,2}},\\s*\\d{{4}})', 1), lambda x: CAST(try_strptime(x, '%B %d, %Y') AS DATE)), lambda x: x < d)) AS supersedes_date, issued AS issued_on, CASE WHEN number IS NULL THEN 'circular_no' END AS error FROM (
  SELECT *, coalesce(updated, issued, CAST(try_strptime(regexp_extract(text, '\\b(May \\d{{1,2}}, 2024)', 1), '%B %d, %Y') AS DATE)) AS d FROM (SELECT doc_id, text, nullif(regexp_extract(text, '(SEBI/HO/[A-Za-z0-9/\\-_]+/P/CIR/\\d{{4}}/\\d+|HO/\\d+/\\d+/\\d+\\(\\d+\\)\\d{{4}}-[A-Za-z0-9\\-]+/[A-Za-z]/\\d+/\\d{{4}})', 1), '') AS number,
    rtrim(trim(regexp_extract(text, 'Master Circular for ([^\\n]+)', 1)), '.') AS label, CAST(try_strptime(regexp_extract(text, 'Issued on: ([A-Za-z]+ \\d+, \\d+)', 1), '%B %d, %Y') AS DATE) AS issued, CAST(try_strptime(regexp_extract(text, 'Last updated on : ([A-Za-z]+ \\d+, \\d+)', 1), '%B %d, %Y') AS DATE) AS updated FROM ({FRONT})))"""


@query(FIELDS)
def header_fields(t: Tables) -> DataFrame:
    return docs.parse_headers(t.sql(FRONT).select("doc_id", "text"))


VERSIONS = "SELECT CAST(c_custkey AS BIGINT) AS k, 'N' || CAST(c_custkey AS STRING) AS circular_no, c_mktsegment || CAST(c_nationkey AS STRING) AS intermediary, date_add(DATE '2020-01-01', CAST(c_custkey % 400 AS INT)) AS circular_date, date_add(DATE '2020-01-01', CAST(c_custkey % 390 - 5 AS INT)) AS supersedes_date FROM {customer}"


@query(f"SELECT a.k, CAST(a.circular_date AS DATE) AS circular_date, CAST(a.supersedes_date AS DATE) AS supersedes_date, b.circular_no AS supersedes_circular_no FROM ({VERSIONS.replace('date_add(DATE', '(DATE').replace(', CAST(c_custkey % 400 AS INT))', ' + CAST(c_custkey % 400 AS INT))').replace(', CAST(c_custkey % 390 - 5 AS INT))', ' + CAST(c_custkey % 390 - 5 AS INT))')}) a LEFT JOIN ({VERSIONS.replace('date_add(DATE', '(DATE').replace(', CAST(c_custkey % 400 AS INT))', ' + CAST(c_custkey % 400 AS INT))').replace(', CAST(c_custkey % 390 - 5 AS INT))', ' + CAST(c_custkey % 390 - 5 AS INT))')}) b ON a.intermediary = b.intermediary AND a.supersedes_date = b.circular_date")
def version_chain(t: Tables) -> DataFrame:
    return docs.version_chain(t.sql(VERSIONS)).select("k", "circular_date", "supersedes_date", "supersedes_circular_no")


# ----------------------------------------------------------------- coverage

GAPS = "SELECT 'd' || CAST(CAST(floor(event_id / 30.0) AS BIGINT) AS STRING) AS doc_id, CAST(user_id % 12 AS INT) AS page, CAST(event_id % 3 AS INT) AS stage, event_type AS reason, 'detail ' || CAST(event_id AS STRING) AS detail FROM {events}"
COVERED = f"""SELECT p.doc_id, total_pages, pages_parsed, coalesce(e, 0) AS sections_expected, coalesce(f, 0) AS sections_found, coalesce(g, '') AS gap_pages, CASE WHEN coalesce(e, 0) = 0 THEN 0.0 ELSE round(coalesce(f, 0) / CAST(e AS DOUBLE), 4) END AS section_recall
FROM (SELECT doc_id, count(*) AS total_pages, count(CASE WHEN n % 7 > 0 THEN 1 END) AS pages_parsed FROM (SELECT doc_id, row_no AS n FROM ({CONTENTS_ROWS})) GROUP BY doc_id) p LEFT JOIN (SELECT doc_id, count(*) AS e, count(CASE WHEN start_page > 0 THEN 1 END) AS f FROM ({BODY}) GROUP BY doc_id) s USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(page, ',' ORDER BY page) AS g FROM (SELECT DISTINCT doc_id, page FROM ({GAPS})) GROUP BY doc_id) g USING (doc_id)"""


def _manifest(t: Tables) -> DataFrame:
    pages = t.sql(CONTENTS_ROWS).select("doc_id", F.when(F.col("row_no") % 7 > 0, "text").otherwise(" \n").alias("text"))
    spans = _index(t).where("block = 'body'").select("doc_id", F.when(F.col("start_page") > 0, 1).alias("char_start"))
    return coverage.manifest(pages, _index(t), spans, t.sql(GAPS))


@query(COVERED)
def coverage_manifest(t: Tables) -> DataFrame:
    return _manifest(t)


@query(f"SELECT count(*) AS documents, round(avg(section_recall), 4) AS recall, count(CASE WHEN section_recall = 1 THEN 1 END) AS complete FROM ({COVERED})")
def section_recall(t: Tables) -> DataFrame:
    return _manifest(t).agg(F.count("*").alias("documents"), F.round(F.avg("section_recall"), 4).alias("recall"), F.count(F.when(F.col("section_recall") == 1, 1)).alias("complete"))


@query(f"SELECT doc_id, string_agg(page, ',' ORDER BY page) AS gap_pages FROM (SELECT DISTINCT doc_id, page FROM ({GAPS})) GROUP BY doc_id")
def llm_eligible_pages(t: Tables) -> DataFrame:
    return coverage.eligible_pages(t.sql(GAPS))


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY stage, page, reason, detail) AS INT) AS nth, greatest(count(*) OVER (PARTITION BY doc_id) - 6, 0) AS more FROM ({GAPS})) WHERE nth <= 6")
def gap_top6(t: Tables) -> DataFrame:
    return coverage.report_gaps(t.sql(GAPS))


@query(f"SELECT stage, reason, count(*) AS n FROM (SELECT stage, reason FROM ({GAPS}) WHERE stage < 3 UNION ALL SELECT 3, 'missing_annexure' FROM (SELECT DISTINCT doc_id FROM ({GAPS}) WHERE page = 0)) GROUP BY ALL")
def gap_union(t: Tables) -> DataFrame:
    gaps = t.sql(GAPS)
    parts = [gaps.where(F.col("stage") == k).drop("stage") for k in range(3)]
    return coverage.all_gaps(*parts, gaps.where("page = 0").select("doc_id").distinct()).groupBy("stage", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT DISTINCT doc_id FROM ({CONTENTS_ROWS}) UNION SELECT 'none' || k FROM range(3) r(k)) SELECT d.doc_id, count(i.row_no) AS toc, CAST(0 AS BIGINT) AS annexure_a, CAST(0 AS BIGINT) AS appendix, count(i.row_no) = 0 AS all_empty FROM d LEFT JOIN ({INDEX}) i USING (doc_id) GROUP BY d.doc_id""")
def ground_truth(t: Tables) -> DataFrame:
    index = _index(t)
    none = index.where("false").select("doc_id", F.lit(1).alias("s_no"))
    documents = _contents(t).select("doc_id").distinct().unionByName(t.spark.range(3).select(F.concat(F.lit("none"), F.col("id").cast("string")).alias("doc_id")))
    rows = writers.ground_truth(documents, index, none, none.withColumnsRenamed({"s_no": "row_no"}))
    sizes = {c: F.size(c).cast("bigint") for c in ("toc", "annexure_a", "appendix")}
    return rows.select("doc_id", *[v.alias(k) for k, v in sizes.items()], (F.size("toc") == 0).alias("all_empty"))


@query("""SELECT doc_id, canonical, sha256(canonical) AS dom_hash FROM (SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text}) AS VARCHAR) AS canonical FROM {documents})""")
def canonical_documents(t: Tables) -> DataFrame:
    return writers.canonical_json(t.table("documents")).select("doc_id", "canonical", "dom_hash")


@query(f"""WITH g AS ({ORACLES["gap_top6"]}) SELECT doc_id, CAST(0 AS INTEGER) AS nth, 'pages ' || pages_parsed || '/' || total_pages || '  sections ' || sections_found || '/' || sections_expected AS line FROM ({COVERED})
UNION ALL SELECT doc_id, nth, 'p' || page || ' ' || reason || ' ' || left(detail, 74) FROM g UNION ALL SELECT doc_id, CAST(max(nth) + 1 AS INTEGER), '… ' || max(more) || ' more' FROM g GROUP BY doc_id HAVING max(more) > 0""")
def coverage_report(t: Tables) -> DataFrame:
    return writers.report_lines(_manifest(t), coverage.report_gaps(t.sql(GAPS)))


BODIES = f"SELECT doc_id, section_no, any_value(part) AS part, string_agg(line, chr(10) ORDER BY rn) AS text FROM ({CLAUSE_LINES}) GROUP BY ALL"
TITLED = f"""SELECT doc_id, section_no, part, text, CASE WHEN section_no % 4 = 0 THEN section_no || '. Charges that the client owes' || chr(10) ELSE '' END || section_no || '. Running account of part ' || part || ' number ' || section_no || chr(10) AS heading,
  'Running account of part ' || part || CASE WHEN section_no % 3 = 0 THEN ' numbered ' ELSE ' number ' END || section_no AS full_title FROM ({BODIES})"""
LOCATED = f"""s AS MATERIALIZED (SELECT *, CASE WHEN section_no % 5 = 0 THEN substr(full_title, 1, 22) ELSE full_title END AS title FROM ({TITLED})), w AS MATERIALIZED (SELECT doc_id, string_agg(heading || text, chr(10) ORDER BY section_no) || chr(10) || 'Forms' || chr(10) || ' Annexure – 1' || chr(10) || 'Form of the client' || chr(10) AS text FROM s GROUP BY doc_id),
y AS MATERIALIZED (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY at_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_char FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, CAST(len(string_split(text, chr(10))) AS BIGINT))) AS at_line FROM w)),
o AS MATERIALIZED (SELECT y.doc_id, s.section_no, at_char, regexp_extract(line, '^[ \\t]*(\\d+)\\.[ \\t]+(\\S[^\\n]*)', 2) AS heading, s.title, lower(trim(regexp_replace(regexp_extract(line, '^[ \\t]*(\\d+)\\.[ \\t]+(\\S[^\\n]*)', 2), '\\s+', ' ', 'g'))) AS h, lower(trim(regexp_replace(s.title, '\\s+', ' ', 'g'))) AS t
  FROM y JOIN s ON s.doc_id = y.doc_id AND CAST(s.section_no AS VARCHAR) = regexp_extract(line, '^[ \\t]*(\\d+)\\.[ \\t]+(\\S[^\\n]*)', 1)),
z AS MATERIALIZED (SELECT h, t, CASE WHEN length(h) <= length(t) THEN h ELSE t END AS a, CASE WHEN length(h) <= length(t) THEN t ELSE h END AS long FROM (SELECT DISTINCT h, t FROM o WHERE NOT (contains(h, t) OR contains(t, h)))),
x AS MATERIALIZED (SELECT h, t, a, substr(long, greatest(e - length(a), 0) + 1, least(e, length(long)) - greatest(e - length(a), 0)) AS b FROM (SELECT *, unnest(range(1, CAST(length(long) + length(a) AS BIGINT))) AS e FROM z)), {_subsequences("SELECT a, b FROM x")},
k AS MATERIALIZED (SELECT h, t, max(200.0 * n / (length(a) + length(b))) AS score FROM x JOIN lcs USING (a, b) GROUP BY h, t), v AS MATERIALIZED (SELECT doc_id, section_no, list(struct_pack(o := at_char, s := score, h := heading) ORDER BY at_char, score, heading) AS lines FROM (SELECT o.*, coalesce(k.score, 100.0) AS score FROM o LEFT JOIN k USING (h, t)) GROUP BY ALL),
u AS MATERIALIZED (SELECT s.doc_id, s.section_no, s.part, s.title, coalesce(v.lines, []) AS lines, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.section_no) AS nth FROM s LEFT JOIN v USING (doc_id, section_no)),
g AS (SELECT doc_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS behind, CAST(NULL AS VARCHAR) AS part, CAST(NULL AS INTEGER) AS section_no, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS char_start, CAST(NULL AS VARCHAR) AS heading, CAST(NULL AS DOUBLE) AS match_score FROM (SELECT DISTINCT doc_id FROM u)
  UNION ALL SELECT doc_id, nth, CASE WHEN best.s >= 72 THEN best.o + 1 ELSE behind END, part, section_no, title, CASE WHEN best.s >= 72 THEN best.o END, CASE WHEN best.s >= 72 THEN trim(best.h) END, best.s FROM (
    SELECT *, list_filter(upto, lambda q: q.s = list_max(list_transform(upto, lambda p: p.s)))[1] AS best FROM (SELECT *, CASE WHEN strong > 0 THEN ahead[1:strong] ELSE ahead END AS upto FROM (SELECT *, coalesce(list_position(list_transform(ahead, lambda q: q.s >= 95), true), 0) AS strong FROM (
      SELECT g.doc_id, u.nth, g.behind, u.part, u.section_no, u.title, list_filter(u.lines, lambda q: q.o >= g.behind) AS ahead FROM g JOIN u ON u.doc_id = g.doc_id AND u.nth = g.nth + 1))))),
c AS MATERIALIZED (SELECT * FROM g WHERE nth > 0), e AS (SELECT c.doc_id, max(length(w.text)) AS whole, (SELECT min(at_char) FROM y WHERE y.doc_id = c.doc_id AND at_char >= max(c.char_start) AND regexp_matches(line, '(?i)^[ \\t]*Annexure\\s*[-–—]?\\s*1\\b')) AS annexed FROM c JOIN w ON w.doc_id = c.doc_id GROUP BY c.doc_id)"""


@query(f"""WITH RECURSIVE {LOCATED} SELECT doc_id, part, section_no, title, CAST(1 AS INTEGER) AS start_page, char_start, heading, match_score,
  CASE WHEN char_start IS NOT NULL THEN CAST(coalesce(lead(char_start) OVER (PARTITION BY doc_id ORDER BY char_start NULLS LAST), CASE WHEN annexed > char_start THEN annexed ELSE whole END) AS BIGINT) END AS char_end FROM c JOIN e USING (doc_id)""")
def section_locate(t: Tables) -> DataFrame:
    """Sections under headings like their titles, some titles worded otherwise or cut, some numbers opened by other lines before."""
    number = F.col("section_no").cast("string")
    decoy = F.when(F.col("section_no") % 4 == 0, F.concat(number, F.lit(". Charges that the client owes\n"))).otherwise("")
    sections = _sections(t).withColumn("heading", F.concat(decoy, number, F.lit(". Running account of part "), "part", F.lit(" number "), number, F.lit("\n")))
    # One aggregate holds all that texts and index take, so sections are made once.
    held = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_no", "part", "heading", "text"))).alias("held"))
    text = F.concat(F.array_join(F.transform("held", lambda s: F.concat(s["heading"], s["text"])), "\n"), F.lit("\nForms\n Annexure – 1\nForm of the client\n"))
    texts = held.select("doc_id", text.alias("text"), F.lit(0).cast("bigint").alias("body_from"))
    entry = lambda block, part, number, title, page: F.struct(F.lit(block).alias("block"), part.alias("part"), number.alias("section_no"), title.alias("title"), F.lit(page).alias("start_page"))

    def body(s: Column) -> Column:
        number = s["section_no"].cast("string")
        title = F.concat(F.lit("Running account of part "), s["part"], F.when(s["section_no"] % 3 == 0, " numbered ").otherwise(" number "), number)
        return entry("body", s["part"], s["section_no"], F.when(s["section_no"] % 5 == 0, F.substring(title, 1, 22)).otherwise(title), 1)

    annexure = entry("annexure", F.lit(None).cast("string"), F.lit(1), F.lit("Annexure - 1"), 90)
    index = held.select("doc_id", F.inline(F.concat(F.transform("held", body), F.array(annexure))))
    return clauses.locate_sections(texts, index)


@query("""WITH o AS (SELECT c_custkey AS id, c_custkey % 7 AS terms FROM {customer} WHERE c_custkey % 5 > 0), n AS (SELECT c_custkey AS id, c_custkey % 7 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS terms FROM {customer} WHERE c_custkey % 6 > 0)
SELECT coalesce(o.id, n.id) AS obligation_id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'superseded' WHEN o.terms <> n.terms THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.id = n.id""")
def change_ledger(t: Tables) -> DataFrame:
    c = t.table("customer").select(F.col("c_custkey").alias("obligation_id"), (F.col("c_custkey") % 7).alias("terms"))
    new = c.where("obligation_id % 6 > 0").withColumn("terms", F.col("terms") + F.when(F.col("obligation_id") % 11 == 0, 1).otherwise(0))
    return changes.change_ledger(c.where("obligation_id % 5 > 0"), new).select("obligation_id", "change")


@query("""WITH o AS (SELECT c_custkey AS id, c_custkey % 7 AS terms FROM {customer} WHERE c_custkey % 5 > 0), n AS (SELECT c_custkey AS id, c_custkey % 7 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS terms FROM {customer} WHERE c_custkey % 6 > 0)
SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'superseded' WHEN o.terms <> n.terms THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n FROM o FULL JOIN n ON o.id = n.id GROUP BY 1""")
def change_counts(t: Tables) -> DataFrame:
    return change_ledger(t).groupBy("change").agg(F.count("*").alias("n"))


NAMED = "lower(p_name || ' ' || p_partkey)"


@query(f"SELECT title, change FROM ((SELECT {NAMED} AS title, 'removed' AS change FROM {{part}} WHERE p_partkey % 3 > 0 EXCEPT SELECT {NAMED}, 'removed' FROM {{part}} WHERE p_partkey % 4 > 0) UNION ALL (SELECT {NAMED}, 'added' FROM {{part}} WHERE p_partkey % 4 > 0 EXCEPT SELECT {NAMED}, 'added' FROM {{part}} WHERE p_partkey % 3 > 0))")
def title_changes(t: Tables) -> DataFrame:
    p = t.table("part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"))
    return changes.title_changes(p.where("p_partkey % 3 > 0"), p.where("p_partkey % 4 > 0"))


@query(f"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(c2, '(?i)Para\\s+(\\d+(?:\\.\\d+)*)', 1)) AS para FROM ({REGISTER})), c AS (SELECT doc_id, regexp_replace(regexp_replace(path, '^[IVXL]+\\.', ''), '#.*$', '') AS para, count(*) AS k FROM ({CLAUSES}) WHERE length(text) >= 3 GROUP BY ALL)
SELECT n.doc_id, n.para, coalesce(k, 0) AS n FROM n LEFT JOIN c USING (doc_id, para)""")
def change_paras_vs_clauses(t: Tables) -> DataFrame:
    listed = registers.change_entries(t.sql(REGISTER).select("doc_id", F.array("c0", "c2", F.lit("")).alias("cells")))
    return changes.listed_but_absent(listed, clauses.split_clauses(_sections(t)))
