"""Queries on texts, identities, deadlines, modality and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import KEYTERM_FUZZ
from docloom.functions import deadlines as D
from docloom.functions import gate as G
from docloom.functions import text as X
from docloom.functions.fuzzy import partial_ratio, ratio
from docloom.operators import documents as docs
from docloom.operators import fuzzy_join
from docloom.operators import obligations as ob
from docloom.plans.registry import Tables, query
from docloom.session import bounded_batches
from docloom.sources.synthetic import CLAUSE_LINES, OBLIGATIONS, PAGES, SENTENCES

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DEHYPHENATED = rf"regexp_replace(text, '([\p{{L}}\p{{N}}_])-{WS}*\n{WS}*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
FOLDED = "replace(translate({x}, chr(8216)||chr(8217)||chr(8220)||chr(8221)||chr(8211)||chr(8212)||chr(8722)||chr(160)||chr(8201), '''''\"\"---  '), chr(8203), '')"
NORMAL = f"lower(trim(regexp_replace({FOLDED.format(x=DEHYPHENATED)}, '{WS}+', ' ', 'g')))"


def normal(column: str) -> str:
    return NORMAL.replace("(text,", f"({column},", 1)


@query(f"SELECT doc_id, sha256({DEHYPHENATED}) AS digest FROM {{documents}}")
def dehyphenate_docs(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", F.sha2(X.dehyphenate(F.col("text")), 256).alias("digest"))


@query(f"SELECT doc_id, sha256({NORMAL}) AS digest, length({NORMAL}) AS n FROM {{documents}}")
def normalise_text_native(t: Tables) -> DataFrame:
    return t.table("documents").withColumn("x", X.normalise_native(F.col("text"))).select("doc_id", F.sha2("x", 256).alias("digest"), F.length("x").cast("bigint").alias("n"))


# Full case folding and compatibility forms of what the given texts hold; a test compares all code points.
EXACT = f"replace(lower(trim(regexp_replace({FOLDED.format(x=f'nfc_normalize({DEHYPHENATED})')}, '{WS}+', ' ', 'g'))), chr(223), 'ss')"


@query(f"SELECT doc_id, sha256({EXACT}) AS digest FROM {{documents}}")
def normalise_text_exact(t: Tables) -> DataFrame:
    bounded_batches(t.spark)
    return t.table("documents").select("doc_id", F.sha2(X.normalise_exact(F.col("text")), 256).alias("digest"))


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
SALIENT = "list_filter(regexp_extract_all({x}, '[a-z]{{3,}}'), lambda w: w NOT IN (" + STOP + "))"


@query(f"SELECT conv_id, turn, len({SALIENT.format(x=NORMAL)}) AS n, sha256(array_to_string({SALIENT.format(x=NORMAL)}, ' ')) AS digest FROM {{conversations}}")
def salient_tokens(t: Tables) -> DataFrame:
    words = X.salient(X.normalise_native(F.col("text")))
    return t.table("conversations").withColumn("w", words).select("conv_id", "turn", F.size("w").cast("bigint").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("digest"))


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({SALIENT.format(x=NORMAL)}) AS word FROM {{documents}}) GROUP BY word")
def token_vocab(t: Tables) -> DataFrame:
    """Sorted within its document, a word's first place there counts the document, so one aggregation serves both counts."""
    words = t.table("documents").select(F.sort_array(X.salient(X.normalise_native(F.col("text")))).alias("words"))
    marked = words.select(F.explode_outer(F.transform("words", lambda w, k: F.struct(w.alias("word"), (F.coalesce(F.get("words", k - 1) != w, F.lit(True))).cast("int").alias("first")))).alias("x"))
    return marked.select("x.*").where("word is not null").groupBy("word").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


@query(rf"""
SELECT doc_id, page_no, sha256(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:Page\s+\d+\s+of\s+\d+|\d{{1,4}})\s*$')), chr(10)),
  '([\p{{L}}\p{{N}}_])-{WS}*\n{WS}*([\p{{L}}\p{{N}}_])', '\1\2', 'g') || chr(10)) AS digest FROM ({PAGES})
""")
def clean_page_lines(t: Tables) -> DataFrame:
    return t.sql(PAGES).select("doc_id", "page_no", F.sha2(docs.clean_page(F.col("text")), 256).alias("digest"))


LOADED = rf"""SELECT doc_id, page_no, clean, length(clean) AS n, coalesce(sum(length(clean)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM (
  SELECT doc_id, page_no, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:Page\s+\d+\s+of\s+\d+|\d{{1,4}})\s*$')), chr(10)),
  '([\p{{L}}\p{{N}}_])-{WS}*\n{WS}*([\p{{L}}\p{{N}}_])', '\1\2', 'g') || chr(10) AS clean FROM ({PAGES}))"""


def _loaded(t: Tables) -> DataFrame:
    return docs.load_pages(t.sql(PAGES).withColumn("tables", F.lit(None).cast("array<array<array<string>>>")))


@query(f"SELECT doc_id, page_no, n, CAST(char_start AS BIGINT) AS char_start FROM ({LOADED})")
def page_offsets(t: Tables) -> DataFrame:
    return _loaded(t).select("doc_id", "page_no", F.length("text").cast("bigint").alias("n"), "char_start")


ASKED = "SELECT source AS doc_id, doc_id AS ask, CAST(doc_id * 7919 % 150000 AS BIGINT) AS \"offset\" FROM {documents}"


@query(f"""
WITH p AS ({LOADED}), a AS ({ASKED}), l AS (SELECT doc_id, max(page_no) AS last FROM p GROUP BY doc_id)
SELECT a.doc_id, ask, a."offset", coalesce(p.page_no, last) AS page_no FROM a JOIN l USING (doc_id) LEFT JOIN p ON p.doc_id = a.doc_id AND char_start <= a."offset" AND a."offset" < char_start + n
""")
def offset_to_page(t: Tables) -> DataFrame:
    asked = t.table("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ask"), (F.col("doc_id") * 7919 % 150000).alias("offset"))
    return docs.page_of(asked, _loaded(t)).select("doc_id", "ask", "offset", "page_no")


SHA = "sha256({})"
CLAUSE_ID = f"sha256('stock_broker' || chr(31) || section_no || chr(31) || part || chr(31) || {normal('line')} || chr(31))"


@query(f"SELECT doc_id, section_no, rn, l_partkey, {CLAUSE_ID} AS clause_id FROM ({CLAUSE_LINES})")
def clause_ids(t: Tables) -> DataFrame:
    return t.sql(CLAUSE_LINES).select("doc_id", "section_no", "rn", "l_partkey", X.clause_id(F.lit("stock_broker"), F.col("section_no"), F.col("part"), X.normalise_native(F.col("line"))).alias("clause_id"))


SIGNATURE = (
    rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({normal('sentence')}, '\b(?:within|not later than|on or before)\b[^,.;]*', '', 'g'), "
    rf"'\b\d+(?:\.\d+)?\b', '#', 'g'), '\b(?:rs\.?|inr|crore|lakh)\b', '', 'g'), '{WS}+', ' ', 'g'))"
)
OBLIGATION_ID = f"sha256('stock_broker' || chr(31) || 'conduct' || chr(31) || {SIGNATURE} || chr(31) || 'investor|stock_broker' || chr(31))"


@query(f"SELECT doc_id, section_no, rn, l_partkey, {SIGNATURE} AS signature, {OBLIGATION_ID} AS obligation_id FROM ({SENTENCES})")
def obligation_ids(t: Tables) -> DataFrame:
    flat = X.normalise_native(F.col("sentence"))
    who = F.array(F.lit("stock_broker"), F.lit("investor"))
    return t.sql(SENTENCES).select("doc_id", "section_no", "rn", "l_partkey", X.action_signature(flat).alias("signature"), X.obligation_id(F.lit("stock_broker"), F.lit("conduct"), flat, who).alias("obligation_id"))


@query(f"SELECT signature, count(*) AS clauses, count(DISTINCT obligation_id) AS ids, count(DISTINCT section_no) AS sections FROM (SELECT section_no, {SIGNATURE} AS signature, {OBLIGATION_ID} AS obligation_id FROM ({SENTENCES})) GROUP BY signature")
def renumber_invariance(t: Tables) -> DataFrame:
    return obligation_ids(t).groupBy("signature").agg(F.count("*").alias("clauses"), F.count_distinct("obligation_id").alias("ids"), F.count_distinct("section_no").alias("sections"))


# Deadlines, written for DuckDB apart from the functions.
WORDS = "CASE lower(w) WHEN 'one' THEN 1 WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 WHEN 'five' THEN 5 WHEN 'six' THEN 6 WHEN 'seven' THEN 7 WHEN 'eight' THEN 8 WHEN 'nine' THEN 9 WHEN 'ten' THEN 10 WHEN 'fifteen' THEN 15 WHEN 'thirty' THEN 30 ELSE TRY_CAST(w AS BIGINT) END"
OFF = r"(?i)\b(?:within|not\s+later\s+than|no\s+later\s+than|latest\s+by|upto|up\s+to)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|thirty)\s*(working\s+days?|business\s+days?|calendar\s+days?|days?|weeks?|months?|quarters?)"
REL = r"""CASE WHEN regexp_matches(s, '(?i)\bquarter[\s\-]?end|end\s+of\s+(?:the\s+)?quarter\b') THEN 'quarter_end' WHEN regexp_matches(s, '(?i)\bmonth[\s\-]?end|end\s+of\s+(?:the\s+)?month\b') THEN 'month_end'
  WHEN regexp_matches(s, '(?i)\bfinancial\s+year|end\s+of\s+(?:the\s+)?year\b') THEN 'financial_year_end' WHEN regexp_matches(s, '(?i)\bend\s+of\s+(?:the\s+)?day|EOD\b') THEN 'end_of_day'
  WHEN regexp_matches(s, '(?i)\bdate\s+of\s+receipt|on\s+receipt\b') THEN 'receipt' WHEN regexp_matches(s, '(?i)\btrade\s+date|trading\s+day\b') THEN 'trade_date' END"""
PER = r"CASE WHEN regexp_matches(s, '(?i)\bquarterly\b') THEN 'quarter' WHEN regexp_matches(s, '(?i)\bmonthly\b') THEN 'month' WHEN regexp_matches(s, '(?i)\bannual(?:ly)?\b|\byearly\b') THEN 'year' WHEN regexp_matches(s, '(?i)\bdaily\b') THEN 'day' WHEN regexp_matches(s, '(?i)\bweekly\b') THEN 'week' END"
PARSED = rf"""
SELECT *, CASE WHEN fd IS NOT NULL THEN 'fixed' WHEN n IS NOT NULL THEN 'offset' WHEN tn IS NOT NULL THEN 'tplus' WHEN per IS NOT NULL THEN 'periodic' END AS how FROM (
  SELECT *, {WORDS} AS n, {REL} AS rel, {PER} AS per, TRY_CAST(tw AS BIGINT) AS tn, CAST(try_strptime(regexp_replace(fs, '\s+', ' ', 'g'), '%B %d, %Y') AS DATE) AS fd FROM (
    SELECT doc_id, section_no, rn, l_orderkey, l_partkey, sentence AS s, regexp_extract(sentence, '{OFF}', 1) AS w, lower(regexp_extract(sentence, '{OFF}', 2)) AS u,
      regexp_extract(sentence, '(?i)\bT\s*\+\s*(\d+)\s*(working\s+day|day)?s?\b', 1) AS tw, lower(regexp_extract(sentence, '(?i)\bT\s*\+\s*(\d+)\s*(working\s+day|day)?s?\b', 2)) AS tu,
      regexp_extract(sentence, '\b(?:on\s+or\s+before|by)\s+([A-Z][a-z]+\s+\d{{1,2}},\s*\d{{4}})\b', 1) AS fs FROM ({SENTENCES}) z))"""
KEYS = "doc_id, section_no, rn, l_orderkey, l_partkey"
OFFSET_N = "CASE WHEN u LIKE 'week%' THEN n * 7 ELSE n END"
OFFSET_U = "CASE WHEN u LIKE 'working%' OR u LIKE 'business%' THEN 'working_day' WHEN u LIKE 'month%' THEN 'month' WHEN u LIKE 'quarter%' THEN 'quarter' ELSE 'day' END"


def _sentences(t: Tables) -> DataFrame:
    return t.sql(SENTENCES)


def _spread(df: DataFrame, parsed: str) -> DataFrame:
    x = F.col(parsed)
    return df.select("doc_id", "section_no", "rn", "l_orderkey", "l_partkey", x["offset"].alias("n"), x["unit"].alias("unit"), x["relative_to"].alias("relative_to"), x["fixed_date"].alias("fixed_date"))


@query(f"SELECT {KEYS}, CAST({OFFSET_N} AS BIGINT) AS n, {OFFSET_U} AS unit, rel AS relative_to, CAST(NULL AS DATE) AS fixed_date FROM ({PARSED}) WHERE n IS NOT NULL")
def deadline_offset(t: Tables) -> DataFrame:
    return _spread(_sentences(t).withColumn("x", D.offset_deadline(F.col("sentence"))).where("x is not null"), "x")


@query(f"SELECT {KEYS}, tn AS n, CASE WHEN tu LIKE 'working%' THEN 'working_day' ELSE 'day' END AS unit, 'trade_date' AS relative_to, CAST(NULL AS DATE) AS fixed_date FROM ({PARSED}) WHERE tn IS NOT NULL")
def deadline_tplus(t: Tables) -> DataFrame:
    return _spread(_sentences(t).withColumn("x", D.t_plus_deadline(F.col("sentence"))).where("x is not null"), "x")


@query(f"SELECT {KEYS}, fs AS phrase, fd AS fixed_date FROM ({PARSED}) WHERE fs <> ''")
def deadline_fixed(t: Tables) -> DataFrame:
    phrase = X.found(F.col("sentence"), D.FIXED_DATE, 1)
    return _sentences(t).select("doc_id", "section_no", "rn", "l_orderkey", "l_partkey", phrase.alias("phrase"), D.fixed_date(F.col("sentence")).alias("fixed_date")).where("phrase is not null")


@query(f"SELECT {KEYS}, CAST(NULL AS BIGINT) AS n, per AS unit, coalesce(rel, 'period_end') AS relative_to, CAST(NULL AS DATE) AS fixed_date FROM ({PARSED}) WHERE per IS NOT NULL")
def deadline_periodic(t: Tables) -> DataFrame:
    return _spread(_sentences(t).withColumn("x", D.periodic_deadline(F.col("sentence"))).where("x is not null"), "x")


@query(f"SELECT coalesce(rel, '-') AS relative_to, count(*) AS n FROM ({PARSED}) GROUP BY 1")
def deadline_relative_to(t: Tables) -> DataFrame:
    return _sentences(t).select(F.coalesce(D.relative_to(F.col("sentence")), F.lit("-")).alias("relative_to")).groupBy("relative_to").agg(F.count("*").alias("n"))


ALL_UNIT = f"CASE how WHEN 'offset' THEN {OFFSET_U} WHEN 'tplus' THEN CASE WHEN tu LIKE 'working%' THEN 'working_day' ELSE 'day' END WHEN 'periodic' THEN per END"
ALL_REL = "CASE how WHEN 'fixed' THEN 'fixed_date' WHEN 'offset' THEN rel WHEN 'tplus' THEN 'trade_date' WHEN 'periodic' THEN coalesce(rel, 'period_end') END"


@query(f"""SELECT {KEYS}, CAST(CASE how WHEN 'offset' THEN {OFFSET_N} WHEN 'tplus' THEN tn END AS BIGINT) AS n, {ALL_UNIT} AS unit, {ALL_REL} AS relative_to, CASE how WHEN 'fixed' THEN fd END AS fixed_date,
  coalesce({ALL_UNIT} NOT IN ('year', 'week'), true) AS schema_valid FROM ({PARSED})""")
def deadline_all(t: Tables) -> DataFrame:
    parsed = _sentences(t).withColumn("x", D.deadline(F.col("sentence")))
    x = F.col("x")
    return parsed.select("doc_id", "section_no", "rn", "l_orderkey", "l_partkey", x["offset"].alias("n"), x["unit"].alias("unit"), x["relative_to"].alias("relative_to"), x["fixed_date"].alias("fixed_date"), D.schema_valid(x).alias("schema_valid"))


BIND = r"regexp_matches({x}, '(?i)\b(shall|must|is\s+required\s+to|are\s+required\s+to|is\s+mandatory|has\s+to|have\s+to)\b')"
ADVISE = r"regexp_matches({x}, '(?i)\b(may|should|is\s+encouraged|are\s+encouraged|is\s+advised|are\s+advised|is\s+desirable|can)\b')"


@query(f"""SELECT b AS binding, a AS advisory, CASE WHEN claim = 'binding' THEN b ELSE a OR NOT b END AS modality_ok, claim, count(*) AS n FROM (
  SELECT {BIND.format(x='sentence')} AS b, {ADVISE.format(x='sentence')} AS a, CASE WHEN l_partkey % 4 = 0 THEN 'advisory' ELSE 'binding' END AS claim FROM ({SENTENCES})) GROUP BY ALL""")
def modality_matrix(t: Tables) -> DataFrame:
    s, claim = F.col("sentence"), F.when(F.col("l_partkey") % 4 == 0, "advisory").otherwise("binding")
    told = _sentences(t).select(G.binding(s).alias("binding"), G.advisory(s).alias("advisory"), G.modality_ok(claim, s).alias("modality_ok"), claim.alias("claim"))
    return told.groupBy("binding", "advisory", "modality_ok", "claim").agg(F.count("*").alias("n"))


@query(f"""SELECT CASE how WHEN 'offset' THEN {OFFSET_U} ELSE coalesce({ALL_UNIT}, '-') END AS unit, CASE WHEN {BIND.format(x='s')} THEN 'binding' WHEN {ADVISE.format(x='s')} THEN 'advisory' ELSE 'neither' END AS modality,
  count(*) AS clauses, count(DISTINCT doc_id) AS documents, count(CASE WHEN how = 'fixed' THEN 1 END) AS dated, CAST(sum(CASE how WHEN 'offset' THEN {OFFSET_N} WHEN 'tplus' THEN tn END) AS BIGINT) AS units FROM ({PARSED}) GROUP BY 1, 2""")
def flagship_obligation_rollup(t: Tables) -> DataFrame:
    s, x = F.col("sentence"), F.col("x")
    told = _sentences(t).withColumn("x", D.deadline(s)).select(
        "doc_id", F.coalesce(x["unit"], F.lit("-")).alias("unit"), F.when(G.binding(s), "binding").when(G.advisory(s), "advisory").otherwise("neither").alias("modality"), x["fixed_date"].alias("date"), x["offset"].alias("k")
    )
    return told.groupBy("unit", "modality").agg(F.count("*").alias("clauses"), F.count_distinct("doc_id").alias("documents"), F.count("date").alias("dated"), F.sum("k").alias("units"))


NEEDLES, HAY = SALIENT.format(x=normal("action_required")), "list_distinct(" + SALIENT.format(x=normal("cited")) + ")"
GATED = f"""
SELECT *, len(list_filter(needles, lambda w: list_contains(hay, w))) AS hits FROM (SELECT *, {NEEDLES} AS needles, {HAY} AS hay FROM (
  SELECT *, char_start >= 0 AND char_start < char_end AND char_end <= length(document) AND trim(substr(document, char_start + 1, char_end - char_start)) <> '' AS span_ok,
    CASE WHEN char_start >= 0 AND char_start < char_end AND char_end <= length(document) THEN substr(document, char_start + 1, char_end - char_start) ELSE '' END AS cited, coalesce(verdict, 'neutral') AS entailment FROM ({OBLIGATIONS})))"""
KEYTERM = "coalesce(len(needles) > 0 AND len(hay) > 0 AND CAST(hits AS DOUBLE) / len(needles) >= 0.55, false)"
MODAL = f"span_ok AND CASE WHEN criticality = 'binding' THEN {BIND.format(x='cited')} ELSE {ADVISE.format(x='cited')} OR NOT {BIND.format(x='cited')} END"


def _judged(t: Tables) -> DataFrame:
    return t.sql(OBLIGATIONS).withColumn("entailment", F.coalesce("verdict", F.lit("neutral")))


@query(f"SELECT doc_id, section_no, rn, l_partkey, len(needles) AS needles, hits, {KEYTERM} AS keyterm_ok FROM ({GATED})")
def keyterm_exact(t: Tables) -> DataFrame:
    told = _judged(t).withColumn("cited", F.when(G.span_ok(F.col("char_start"), F.col("char_end"), F.col("document")), F.substring(F.col("document"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))).otherwise(""))
    told = told.withColumns({"a": X.salient(X.normalise_native(F.col("action_required"))), "b": F.array_distinct(X.salient(X.normalise_native(F.col("cited"))))}).withColumn("hits", G.exact_hits(F.col("a"), F.col("b")).cast("bigint"))
    return told.select("doc_id", "section_no", "rn", "l_partkey", F.size("a").cast("bigint").alias("needles"), "hits", G.keyterm_ok(F.col("a"), F.col("b"), F.col("hits")).alias("keyterm_ok"))


def _subsequences(pairs: str) -> str:
    """CTEs that end in lcs(a, b, n): longest common subsequences of the distinct (a, b) of `pairs`, b read one character a step.

    Bits of a machine word stand for the characters of a (62 at most); a table holds where each character stands in a.
    """
    return f"""p AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})), q AS MATERIALIZED (SELECT a, ch, CAST(sum(CAST(1 AS BIGINT) << CAST(i AS INTEGER)) AS BIGINT) AS mask FROM (SELECT a, unnest(range(0, CAST(length(a) AS BIGINT))) AS i, unnest(string_split(a, '')) AS ch FROM (SELECT DISTINCT a FROM p)) GROUP BY a, ch),
r AS (SELECT a, b, CAST(1 AS BIGINT) AS k, (CAST(1 AS BIGINT) << CAST(length(a) AS INTEGER)) - 1 AS state, CAST(length(b) AS BIGINT) AS n FROM p UNION ALL
  SELECT a, b, k + 1, ((state + hit) | (state - hit)) & ((CAST(1 AS BIGINT) << CAST(length(a) AS INTEGER)) - 1), n FROM (SELECT r.a, r.b, r.k, r.state, r.n, r.state & coalesce(q.mask, 0) AS hit FROM r LEFT JOIN q ON q.a = r.a AND q.ch = substr(r.b, r.k, 1) WHERE r.k <= r.n)),
lcs AS MATERIALIZED (SELECT a, b, length(a) - bit_count(state) AS n FROM r WHERE k = n + 1)"""


FUZZY = f"""g AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM ({GATED})), {_subsequences("SELECT a, b FROM (SELECT DISTINCT unnest(needles) AS a FROM g) CROSS JOIN (SELECT DISTINCT unnest(hay) AS b FROM g)")},
m AS MATERIALIZED (SELECT a, list(b) AS near FROM lcs WHERE 200.0 * n / (length(a) + length(b)) >= 82 GROUP BY a), h AS (SELECT id, count(*) AS found FROM (SELECT id, hay, unnest(needles) AS a FROM g) JOIN m USING (a) WHERE list_has_any(hay, near) GROUP BY id),
f AS (SELECT g.*, coalesce(found, 0) AS near FROM g LEFT JOIN h USING (id))"""


@query(f"""WITH RECURSIVE {FUZZY}, s AS (SELECT *, {KEYTERM.replace("hits", "near")} AS keyterm_ok, {MODAL} AS modal FROM f)
SELECT keyterm_ok, CASE WHEN entailment = 'contradicted' OR NOT span_ok THEN 'rejected' WHEN keyterm_ok AND modal AND entailment = 'entailed' AND confidence >= 0.8 THEN 'auto_accepted' ELSE 'needs_review' END AS review_status, count(*) AS n FROM s GROUP BY 1, 2""")
def keyterm_fuzzy(t: Tables) -> DataFrame:
    return ob.evaluate(_judged(t), fuzzy=True).groupBy("keyterm_ok", "review_status").agg(F.count("*").alias("n"))


def _keyed_words(t: Tables) -> DataFrame:
    """Obligations by a key, with their salient words and those of the cited text."""
    span = G.span_ok(F.col("char_start"), F.col("char_end"), F.col("document"))
    cited = F.when(span, F.substring(F.col("document"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))).otherwise("")
    words = _judged(t).withColumns({"key": F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("rn").cast("string")), "cited": cited})
    return words.select("key", X.salient(X.normalise_native(F.col("action_required"))).alias("needles"), F.array_distinct(X.salient(X.normalise_native(F.col("cited")))).alias("words"))


@query(f"WITH RECURSIVE {FUZZY} SELECT l_orderkey || '/' || rn AS key, CAST(len(needles) AS BIGINT) AS needles, CAST(near AS BIGINT) AS hits FROM f")
def keyterm_fuzzy_join(t: Tables) -> DataFrame:
    """Needles of every obligation that are similar to a word of its cited text, by a join of words."""
    return fuzzy_join.fuzzy_hits(_keyed_words(t), "key", "needles", "words", KEYTERM_FUZZ).select("key", F.size("needles").cast("bigint").alias("needles"), "hits")


@query(f"""WITH RECURSIVE w AS MATERIALIZED (SELECT DISTINCT lower(c.word) AS a FROM (SELECT unnest(regexp_extract_all(c_mktsegment || ' ' || c_name, '[A-Za-z]+')) AS word FROM {{customer}}) c UNION SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) FROM {{part}}),
v AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z]+')) AS b FROM {{part}} UNION SELECT DISTINCT unnest(regexp_extract_all(lower(sentence), '[a-z]+')) FROM ({SENTENCES})), {_subsequences("SELECT a, b FROM w JOIN v ON 200.0 * least(length(a), length(b)) >= 60 * (length(a) + length(b))")}
SELECT a, b, round(200.0 * n / (length(a) + length(b)), 6) AS ratio FROM lcs WHERE 200.0 * n / (length(a) + length(b)) >= 60""")
def similar_words(t: Tables) -> DataFrame:
    """Words of two vocabularies whose indel ratio is 60 or more."""
    words = lambda df, column: df.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), 0)).alias("w"))
    part, customer = t.table("part"), t.table("customer")
    a = words(customer, F.concat_ws(" ", "c_mktsegment", "c_name")).union(words(part, F.concat_ws(" ", "p_name", "p_type")))
    b = words(part, F.concat_ws(" ", "p_name", "p_brand")).union(words(_sentences(t), F.col("sentence")))
    return fuzzy_join.similar_words(a.select(F.col("w").alias("a")), b.select(F.col("w").alias("b")), 60.0).withColumn("ratio", F.round("ratio", 6))


SCORE = f"round(0.20 * CAST(span_ok AS INT) + 0.20 * CAST({KEYTERM} AS INT) + 0.15 * CAST({MODAL} AS INT) + 0.45 * CASE entailment WHEN 'entailed' THEN 1.0 WHEN 'neutral' THEN 0.35 ELSE 0.0 END, 4)"


@query(f"SELECT doc_id, section_no, rn, l_partkey, span_ok, {KEYTERM} AS keyterm_ok, {MODAL} AS modality_ok, entailment, CAST({SCORE} AS DOUBLE) AS score FROM ({GATED})")
def gate_score(t: Tables) -> DataFrame:
    return ob.evaluate(_judged(t), fuzzy=False).select("doc_id", "section_no", "rn", "l_partkey", "span_ok", "keyterm_ok", "modality_ok", "entailment", "score")


@query(f"""SELECT criticality, CASE WHEN entailment = 'contradicted' OR NOT span_ok THEN 'rejected' WHEN {KEYTERM} AND {MODAL} AND entailment = 'entailed' AND confidence >= 0.8 THEN 'auto_accepted' ELSE 'needs_review' END AS review_status, count(*) AS n
FROM ({GATED}) GROUP BY 1, 2""")
def gate_status(t: Tables) -> DataFrame:
    return ob.evaluate(_judged(t), fuzzy=False).groupBy("criticality", "review_status").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, section_no, rn, l_partkey, 'C/' || l_orderkey || CASE WHEN part <> '' THEN ' · Part ' || part ELSE '' END || ' · s.' || section_no || CASE WHEN rn % 3 > 0 THEN ' · ' || section_no || '.' || rn ELSE '' END || ' · p.' || q AS citation,
  CASE WHEN q * 977 < 1024 THEN q * 977 || ' B' ELSE CAST(round(q * 977 / 1024.0, 0) AS BIGINT) || ' KB' END AS size, (length(sentence) + length(part)) // 4 AS tokens, replace(replace(sentence || '|', '|', chr(92) || '|'), chr(10), ' ') AS cell FROM ({SENTENCES})""")
def citations(t: Tables) -> DataFrame:
    path = F.when(F.col("rn") % 3 > 0, F.concat_ws(".", F.col("section_no").cast("string"), F.col("rn").cast("string")))
    return _sentences(t).select(
        "doc_id", "section_no", "rn", "l_partkey", X.citation(F.concat(F.lit("C/"), F.col("l_orderkey").cast("string")), F.col("part"), F.col("section_no"), path, F.col("q")).alias("citation"),
        X.size_label(F.col("q") * 977).alias("size"), X.token_estimate(F.col("sentence"), F.col("part")).alias("tokens"), X.markdown_cell(F.concat("sentence", F.lit("|"))).alias("cell"),
    )


TOLD = "the member shall report"
WINDOW = "running account"
# Windows of the longer text are as long as the shorter one, and shorter at both ends.
WINDOWS = f"SELECT s, substr(s, greatest(e - {len(WINDOW)}, 0) + 1, least(e, length(s)) - greatest(e - {len(WINDOW)}, 0)) AS b FROM (SELECT s, unnest(range(1, CAST(length(s) + {len(WINDOW)} AS BIGINT))) AS e FROM (SELECT DISTINCT lower(sentence) AS s FROM d))"


@query(f"""WITH RECURSIVE d AS MATERIALIZED ({SENTENCES}), w AS MATERIALIZED ({WINDOWS}), {_subsequences(f"SELECT '{TOLD}' AS a, s AS b FROM w UNION SELECT '{WINDOW}', b FROM w")},
f AS (SELECT s, max(200.0 * n / ({len(WINDOW)} + length(b))) AS partial FROM w JOIN lcs USING (b) WHERE a = '{WINDOW}' GROUP BY s), g AS (SELECT b AS s, 200.0 * n / ({len(TOLD)} + length(b)) AS ratio FROM lcs WHERE a = '{TOLD}')
SELECT doc_id, section_no, rn, l_partkey, round(ratio, 4) AS ratio, round(partial, 4) AS partial FROM d JOIN f ON f.s = lower(sentence) JOIN g ON g.s = lower(sentence)""")
def title_similarity(t: Tables) -> DataFrame:
    s = _sentences(t)
    return s.select("doc_id", "section_no", "rn", "l_partkey", F.round(ratio(F.lower("sentence"), F.lit(TOLD)), 4).alias("ratio"), F.round(partial_ratio(F.lower("sentence"), F.lit(WINDOW)), 4).alias("partial"))


@query(f"""SELECT doc_id, section_no, rn, l_partkey, v.field, v.value FROM (SELECT *, unnest([{{'field': 'obligation_type', 'value': CASE WHEN obligation_type NOT IN ('registration','conduct','disclosure','reporting','risk_management','investor_protection','grievance','technology','audit','governance') THEN obligation_type END}},
  {{'field': 'criticality', 'value': CASE WHEN criticality NOT IN ('binding', 'advisory') THEN criticality END}}]) AS v FROM ({OBLIGATIONS})) WHERE v.value IS NOT NULL""")
def vocab_violations(t: Tables) -> DataFrame:
    rows = t.sql(OBLIGATIONS).withColumns({"obligation_id": F.struct("doc_id", "section_no", "rn", "l_partkey"), "trigger_class": F.lit(None).cast("string"), "evidence_class": F.lit("none"), "applies_to": F.array("intermediary")})
    return ob.vocabulary_violations(rows).select("obligation_id.*", "field", "value")
