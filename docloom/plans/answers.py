"""Queries on model answers and messages: schema faults, accepted rows, assembled templates."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import templates
from docloom.operators import validation
from docloom.plans.registry import Tables, query
from docloom.sources.synthetic import RANKED


def _item(j: int) -> str:
    """SQL of the j-th obligation of an answer; its faults follow from a number made of order, customer and j."""
    h = f"(o_orderkey * 31 + o_custkey * 7 + {j} * 13)"
    return f"""'{{"action_required": ' || CASE WHEN {h} % 37 = 0 THEN '7' ELSE '"report"' END || CASE WHEN {h} % 23 = 1 THEN '' ELSE ', "obligation_type": ' || CASE {h} % 31 WHEN 0 THEN '"marketing"' WHEN 1 THEN 'null' ELSE '"conduct"' END END
  || ', "applies_to": ' || CASE {h} % 29 WHEN 0 THEN '"stock_broker"' WHEN 1 THEN '["stock_broker", "bank", 3]' WHEN 2 THEN '[]' ELSE '["investor", "merchant_banker"]' END || ', "trigger_class": "periodic", "criticality": ' || CASE {h} % 41 WHEN 0 THEN '"severe"' WHEN 1 THEN '{{"level": 1}}' WHEN 2 THEN '"advisory"' ELSE '"binding"' END
  || ', "evidence_class": ' || CASE {h} % 43 WHEN 0 THEN 'null' WHEN 1 THEN '"photo"' WHEN 2 THEN 'false' ELSE '"none"' END || ', "parameters": ' || CASE WHEN {h} % 47 = 0 THEN '[]' ELSE '{{"n": [1, {{"deep": null}}]}}' END || ', "extra": true'
  || CASE WHEN {h} % 53 = 0 THEN '' ELSE ', "source_sentence": "' || o_orderpriority || '"' END || ', "confidence": ' || CASE {h} % 19 WHEN 0 THEN '"high"' WHEN 1 THEN '1' WHEN 2 THEN 'null' ELSE '0.5' END || '}}'"""


#: Raw nested answers: text that is no JSON, other roots, missing and wrong arrays, and up to three obligations each.
ANSWERS = f"""SELECT o_orderkey, CASE o_orderkey % 59 WHEN 0 THEN '{{"obligations": [' WHEN 1 THEN '[]' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"obligations": {{}}}}' WHEN 4 THEN CAST(NULL AS VARCHAR(1)) WHEN 5 THEN '{{"obligations": [4, null]}}' WHEN 6 THEN '7'
  ELSE '{{"obligations": [' || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN {_item(0)} WHEN 2 THEN {_item(0)} || ', ' || {_item(1)} ELSE {_item(0)} || ', ' || {_item(1)} || ', ' || {_item(2)} END || ']}}' END AS answer FROM {{orders}}"""


def _values(at: str) -> str:
    """Rows (name, types, required, enum) of the fields at a schema path, as SQL values."""
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"
    listed = lambda xs: "NULL::VARCHAR[]" if xs is None else f"[{', '.join(map(quote, xs))}]"
    rows = [r for r in validation.schema_rows(validation.obligation_schema()) if r[0].startswith(at + ".") and "." not in r[0][len(at) + 1 :] and "[" not in r[0][len(at) + 1 :]]
    return ", ".join(f"({n}, {quote(path[len(at) + 1 :])}, {listed(types)}, {str(required).lower()}, {listed(enum)})" for n, (path, types, required, enum) in enumerate(rows))


KIND = "CASE json_type({x}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END"
ALLOWED = f"'[{', '.join(json.dumps(x) for x in schemas.APPLIES_TO)}]'"
CHECKED = f"""WITH a AS MATERIALIZED ({ANSWERS}), g AS MATERIALIZED (SELECT o_orderkey, CAST(answer AS JSON) AS v FROM a WHERE answer IS NOT NULL AND json_valid(answer)), f(n, name, types, required, enum) AS (VALUES {_values("$.obligations[*]")}),
l AS MATERIALIZED (SELECT o_orderkey, json_extract(v, '$.obligations') AS w FROM g WHERE json_type(v) = 'OBJECT'), i AS MATERIALIZED (SELECT o_orderkey, unnest(range(0, CAST(json_array_length(w) AS BIGINT))) AS k, w FROM l WHERE json_type(w) = 'ARRAY'),
x AS MATERIALIZED (SELECT o_orderkey, k, '$.obligations[' || k || ']' AS place, json_extract(w, '$[' || k || ']') AS x FROM i),
c AS MATERIALIZED (SELECT o_orderkey, place || '.' || name AS place, types, required, enum, json_extract(x, '$.' || name) AS y FROM x CROSS JOIN f WHERE json_type(x) = 'OBJECT'),
t AS MATERIALIZED (SELECT *, {KIND.format(x="y")} AS kind FROM c WHERE y IS NOT NULL), ok AS MATERIALIZED (SELECT *, list_contains(types, kind) OR (kind = 'integer' AND list_contains(types, 'number')) AS fits FROM t),
e AS MATERIALIZED (SELECT o_orderkey, place || '[' || k || ']' AS place, json_extract(y, '$[' || k || ']') AS z FROM (SELECT o_orderkey, place, y, unnest(range(0, CAST(json_array_length(y) AS BIGINT))) AS k FROM ok WHERE fits AND kind = 'array'))
SELECT o_orderkey, '$' AS path, 'json' AS fault, 'object' AS expected, 'no JSON' AS found FROM a WHERE answer IS NULL OR NOT json_valid(answer)
UNION ALL SELECT o_orderkey, '$', 'type', 'object', {KIND.format(x="v")} FROM g WHERE json_type(v) <> 'OBJECT'
UNION ALL SELECT o_orderkey, '$.obligations', 'missing', 'array', 'nothing' FROM l WHERE w IS NULL
UNION ALL SELECT o_orderkey, '$.obligations', 'type', 'array', {KIND.format(x="w")} FROM l WHERE w IS NOT NULL AND json_type(w) <> 'ARRAY'
UNION ALL SELECT o_orderkey, place, 'type', 'object', {KIND.format(x="x")} FROM x WHERE json_type(x) <> 'OBJECT'
UNION ALL SELECT o_orderkey, place, 'missing', array_to_string(types, '|'), 'nothing' FROM c WHERE y IS NULL AND required
UNION ALL SELECT o_orderkey, place, 'type', array_to_string(types, '|'), kind FROM ok WHERE NOT fits
UNION ALL SELECT o_orderkey, place, 'enum', array_to_string(enum, '|'), CAST(y AS VARCHAR) FROM ok WHERE fits AND enum IS NOT NULL AND NOT list_contains(enum, CAST(y AS VARCHAR))
UNION ALL SELECT o_orderkey, place, 'type', 'string', {KIND.format(x="z")} FROM e WHERE json_type(z) <> 'VARCHAR'
UNION ALL SELECT o_orderkey, place, 'enum', array_to_string(list_transform(CAST(json({ALLOWED}) AS JSON[]), lambda s: CAST(s AS VARCHAR)), '|'), CAST(z AS VARCHAR) FROM e WHERE json_type(z) = 'VARCHAR' AND NOT list_contains(list_transform(CAST(json({ALLOWED}) AS JSON[]), lambda s: CAST(s AS VARCHAR)), CAST(z AS VARCHAR))"""


def _checked(t: Tables) -> DataFrame:
    return validation.with_faults(t.sql(ANSWERS), validation.schema_table(t.spark, validation.obligation_schema()))


@query(CHECKED)
def answer_faults(t: Tables) -> DataFrame:
    """Every fault of every raw answer, with its path."""
    return validation.faults(_checked(t), "o_orderkey")


@query(f"SELECT fault, regexp_replace(path, '[0-9]+', '*', 'g') AS place, count(*) AS n, count(DISTINCT o_orderkey) AS answers FROM ({CHECKED}) GROUP BY ALL")
def answer_fault_counts(t: Tables) -> DataFrame:
    places = validation.faults(_checked(t), "o_orderkey").withColumn("place", F.regexp_replace("path", "[0-9]+", "*"))
    return places.groupBy("fault", "place").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("answers"))


@query(f"""WITH bad AS (SELECT DISTINCT o_orderkey FROM ({CHECKED})), a AS ({ANSWERS}), i AS (SELECT o_orderkey, CAST(answer AS JSON) AS v, unnest(range(0, CAST(json_array_length(json_extract(answer, '$.obligations')) AS BIGINT))) AS seq FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bad))
SELECT o_orderkey, CAST(seq AS INTEGER) AS seq, json_extract_string(v, '$.obligations[' || seq || '].action_required') AS action_required, json_extract_string(v, '$.obligations[' || seq || '].criticality') AS criticality, json_extract_string(v, '$.obligations[' || seq || '].evidence_class') AS evidence_class,
  array_to_string(CAST(json_extract(v, '$.obligations[' || seq || '].applies_to') AS VARCHAR[]), '|') AS applies_to, json_extract_string(v, '$.obligations[' || seq || '].source_sentence') AS source_sentence, CAST(json_extract(v, '$.obligations[' || seq || '].confidence') AS DOUBLE) AS confidence FROM i""")
def accepted_obligations(t: Tables) -> DataFrame:
    """Obligations of the answers without a fault."""
    fields = {"action_required": "string", "criticality": "string", "evidence_class": "string", "applies_to": "array<string>", "source_sentence": "string", "confidence": "double"}
    return validation.accepted(_checked(t), "obligations", fields, "o_orderkey").withColumn("applies_to", F.array_join("applies_to", "|"))


SYSTEM = """You audit the {{ journey | lower }} journey{# of one customer #}.

{% for r in rulebooks %}<rulebook file="references/{{ r.name }}">
{{ r.content }}
</rulebook>

{% endfor %}Rulebooks: {{ rulebooks | length }}. Submit the whole result once."""
#: Rulebooks are nations, in an order that is no order of their names or keys.
RULE_ORDER = [7, 3, 24, 0, 12, 21, 18, 1, 9, 15]
BOOKS = "SELECT n_nationkey, n_regionkey, 'rules-' || lower(replace(n_name, ' ', '-')) || '.md' AS name, '# ' || n_name || chr(10) || 'Region ' || n_regionkey AS content FROM {nation}"
_PLACES = " ".join(f"WHEN {key} THEN {at}" for at, key in enumerate(RULE_ORDER))


@query(f"""WITH b AS (SELECT *, CASE n_nationkey {_PLACES} END AS place FROM ({BOOKS})), s AS (SELECT n_regionkey, string_agg('<rulebook file="references/' || name || '">' || chr(10) || content || chr(10) || '</rulebook>' || chr(10) || chr(10), '' ORDER BY place) AS blocks, count(*) AS n FROM b WHERE place IS NOT NULL GROUP BY 1)
SELECT o_orderkey, 'You audit the ' || lower(o_orderpriority) || ' journey.' || chr(10) || chr(10) || coalesce(blocks, '') || 'Rulebooks: ' || coalesce(n, 0) || '. Submit the whole result once.' AS message FROM {{orders}} LEFT JOIN s ON n_regionkey = o_custkey % 6""")
def system_messages(t: Tables) -> DataFrame:
    """The system message of every order's audit: the template with the rulebooks of a region in their fixed order."""
    books = t.sql(BOOKS)
    names = {r["n_nationkey"]: r["name"] for r in books.where(F.col("n_nationkey").isin(RULE_ORDER)).collect()}  # one row a rulebook
    by_region = books.groupBy("n_regionkey").agg(F.collect_list(F.struct("name", "content")).alias("books"))
    rows = t.table("orders").withColumn("n_regionkey", (F.col("o_custkey") % 6).cast("int")).join(by_region, "n_regionkey", "left")
    rows = rows.withColumn("rulebooks", templates.in_order(F.coalesce("books", F.array()), [names[k] for k in RULE_ORDER]))
    return rows.select("o_orderkey", templates.render(SYSTEM, journey=F.col("o_orderpriority"), rulebooks=F.col("rulebooks")).alias("message"))


EXTRACTION = """Types: {{ types | join(', ') }}
Circular {{ circular }}{% for s in sections %}
Section {{ s.flag | default('none') }}:{% for c in s.clauses %}
  {{ loop.index }}. {{ c.action | upper }} for {{ c.who }}{% endfor %}{% endfor %}
Bound: {{ applies | join(' or ') }}"""


@query(f"""WITH l AS ({RANKED}), c AS (SELECT l_orderkey, l_returnflag, string_agg(chr(10) || '  ' || nth || '. ' || 'ITEM ' || l_partkey || ' for ' || l_suppkey, '' ORDER BY nth) AS clauses FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY rn) AS nth FROM l) GROUP BY ALL),
s AS (SELECT l_orderkey, string_agg(chr(10) || 'Section ' || CASE l_returnflag WHEN 'N' THEN 'none' ELSE l_returnflag END || ':' || clauses, '' ORDER BY l_returnflag) AS sections FROM c GROUP BY 1)
SELECT o_orderkey, 'Types: {", ".join(schemas.OBLIGATION_TYPES)}' || chr(10) || 'Circular ' || o_custkey || coalesce(sections, '') || chr(10) || 'Bound: {" or ".join(schemas.APPLIES_TO)}' AS message FROM {{orders}} LEFT JOIN s ON l_orderkey = o_orderkey""")
def extraction_messages(t: Tables) -> DataFrame:
    """The extraction message of every order: clauses of its sections, by loops in loops."""
    clause = F.struct("rn", F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("action"), F.col("l_suppkey").alias("who"))
    flags = t.sql(RANKED).groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(clause)).alias("clauses"))
    section = F.struct(F.col("l_returnflag").alias("key"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "clauses")
    sections = flags.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    message = templates.render(EXTRACTION, types=words(schemas.OBLIGATION_TYPES), applies=words(schemas.APPLIES_TO), circular=F.col("o_custkey"), sections=F.col("sections"))
    return t.table("orders").join(sections, "o_orderkey", "left").select("o_orderkey", message.alias("message"))
