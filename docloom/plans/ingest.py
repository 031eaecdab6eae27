"""Queries on sources and sinks: paged files, full texts, documents that fail, golden files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators import changes, registers
from docloom.operators import documents as docs
from docloom.plans.answers import BOOKS, RULE_ORDER
from docloom.plans.registry import ORACLES, Tables, query
from docloom.plans.structure import INDEX, REGISTER, _index, change_paras_vs_clauses
from docloom.plans.texts import WS
from docloom.sources import capture, fixtures, paged, readers, writers
from docloom.sources.scratch import Scratch
from docloom.sources.synthetic import MODELS

# Pages end at sentence marks and line ends, so that there are many and some hold no text.
PAGE_BREAK = "[.\n]"
RAW_PAGES = "SELECT doc_id, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS page_no, unnest(l) AS raw FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split_regex(text, '[.\\n]') AS l FROM {documents} WHERE text IS NOT NULL)"
PAGED = rf"""SELECT doc_id, CAST(page_no AS INTEGER) AS page_no, clean, CAST(coalesce(sum(length(clean)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start,
  CASE WHEN regexp_replace(raw, '{WS}+', '', 'g') = '' THEN 'no_text' END AS gap FROM (
  SELECT *, regexp_replace(array_to_string(list_filter(string_split(raw, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:Page\s+\d+\s+of\s+\d+|\d{{1,4}})\s*$')), chr(10)), '([\p{{L}}\p{{N}}_])-{WS}*\n{WS}*([\p{{L}}\p{{N}}_])', '\1\2', 'g') || chr(10) AS clean FROM ({RAW_PAGES}))
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, NULL, 0, 'no_pages' FROM {{documents}} WHERE text IS NULL"""


def _paged(t: Tables) -> DataFrame:
    return paged.read_paged(t.spark, f"{t.folder}/documents.parquet", pageBreak=PAGE_BREAK)


@query(f"SELECT doc_id, page_no, char_start, gap, length(clean) AS n, sha256(clean) AS digest FROM ({PAGED})")
def paged_documents(t: Tables) -> DataFrame:
    """Pages of the files by the paged source, with offsets that the readers count."""
    return _paged(t).select("doc_id", "page_no", "char_start", "gap", F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("digest"))


@query(f"SELECT doc_id, page_no AS page, gap AS reason, CASE gap WHEN 'no_text' THEN 'empty text layer' ELSE 'no page could be read' END AS detail FROM ({PAGED}) WHERE gap IS NOT NULL")
def paged_gaps(t: Tables) -> DataFrame:
    return paged.pages_and_gaps(_paged(t))[1]


@query(f"""WITH p AS MATERIALIZED ({PAGED}), f AS (SELECT doc_id, string_agg(clean, '' ORDER BY page_no) AS whole FROM p WHERE page_no > 0 GROUP BY doc_id)
SELECT doc_id, page_no, length(whole) AS document_length, sha256(substr(whole, char_start + 1, length(clean))) AS slice, substr(whole, char_start + 1, length(clean)) = clean AS is_page FROM p JOIN f USING (doc_id) WHERE page_no > 0""")
def full_text_slices(t: Tables) -> DataFrame:
    """Every page taken back out of its document's full text by its offset."""
    return docs.slices(paged.pages_and_gaps(_paged(t))[0]).select(
        "doc_id", "page_no", F.length("whole").cast("bigint").alias("document_length"), F.sha2("slice", 256).alias("slice"), (F.col("slice") == F.col("text")).alias("is_page")
    )


# Payloads of documents, some of them broken by a rule: cut off, without pages, without a page, of a wrong type, absent.
PAYLOADS = """SELECT event_id, CASE event_id % 13 WHEN 0 THEN '{"pages": [' WHEN 1 THEN '{"pages": []}' WHEN 2 THEN '{"title": 1}' WHEN 3 THEN CAST(NULL AS STRING) WHEN 4 THEN '{"pages": [1]}'
  ELSE '{"pages": ["' || event_type || '", "", "user ' || CAST(user_id AS STRING) || '", " "]}' END AS payload FROM {events}"""


def _captured(t: Tables) -> DataFrame:
    return capture.capture(t.sql(PAYLOADS), lambda row: capture.parse_payload(row["payload"]), "pages int, blank array<int>, chars bigint", keep=("event_id",))


@query("""SELECT event_id, CAST(4 AS INTEGER) AS pages, '2,4' AS blank, CAST(length(event_type) + length('user ') + length(CAST(user_id AS VARCHAR)) + 1 AS BIGINT) AS chars FROM {events} WHERE event_id % 13 > 4""")
def captured_documents(t: Tables) -> DataFrame:
    """Documents that could be read, though others beside them could not."""
    return capture.succeeded(_captured(t), "event_id").withColumn("blank", F.array_join("blank", ","))


@query("""SELECT event_id, split_part(error, ':', 1) AS kind, error FROM (SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'JSONDecodeError: Expecting value: line 1 column 12 (char 11)' WHEN 1 THEN 'ValueError: no pages' WHEN 2 THEN 'KeyError: ''pages'''
  WHEN 3 THEN 'TypeError: the JSON object must be str, bytes or bytearray, not NoneType' ELSE 'AttributeError: ''int'' object has no attribute ''strip''' END AS error FROM {events} WHERE event_id % 13 <= 4)""")
def captured_faults(t: Tables) -> DataFrame:
    return capture.failed(_captured(t), "event_id")


@query("SELECT CASE event_id % 13 WHEN 0 THEN 'JSONDecodeError' WHEN 1 THEN 'ValueError' WHEN 2 THEN 'KeyError' WHEN 3 THEN 'TypeError' WHEN 4 THEN 'AttributeError' END AS kind, count(*) AS n FROM {events} GROUP BY 1")
def captured_outcome(t: Tables) -> DataFrame:
    return capture.outcome(_captured(t))


TOC_ROW = "block string, part string, section_no int, title string, start_page int"
CHANGE_ROW = "s_no int, description string, source_circular_no string, referenced_pages array<int>, referenced_paras array<string>"
APPENDIX_ROW = "page_no int, s_no int, circular_no string, circular_date string"
#: Folders of golden files: each is moved by the driver as a whole, and listed by the task that reads it.
FOLDERS = 256


@query(f"""WITH c AS MATERIALIZED (SELECT doc_id, page_no, CASE WHEN regexp_matches(c0, '^\\s*\\d{{1,3}}\\.?\\s*$') THEN CAST(regexp_extract(c0, '(\\d+)', 1) AS INT) END AS s_no, c2 AS description,
  nullif(regexp_extract(c2, '\\b(?:SEBI/[A-Za-z0-9/\\-_()]+|[A-Z]{{2,}}/\\d[A-Za-z0-9/\\-_()]*)\\b'), '') AS source_circular_no, list_sort(list_distinct(list_transform(regexp_extract_all(c2, '(?i)page\\s*no\\.?\\s*(\\d{{1,4}})', 1), lambda x: CAST(x AS INT)))) AS referenced_pages,
  list_sort(list_distinct(regexp_extract_all(c2, '(?i)Para\\s+(\\d+(?:\\.\\d+)*)', 1))) AS referenced_paras FROM ({REGISTER})), a AS MATERIALIZED ({ORACLES['appendix_scan']}),
i AS MATERIALIZED ({INDEX}), d AS (SELECT doc_id FROM i UNION SELECT doc_id FROM c UNION SELECT 'none/' || range FROM range(3))
SELECT d.doc_id, coalesce((SELECT '[' || string_agg(to_json({{'block': block, 'part': part, 'section_no': section_no, 'title': title, 'start_page': start_page}}), ',' ORDER BY block, start_page, section_no, row_no) || ']' FROM i WHERE i.doc_id = d.doc_id), '[]') AS toc,
  coalesce((SELECT '[' || string_agg(to_json({{'s_no': s_no, 'description': description, 'source_circular_no': source_circular_no, 'referenced_pages': referenced_pages, 'referenced_paras': referenced_paras}}), ',' ORDER BY page_no) || ']' FROM c WHERE c.doc_id = d.doc_id), '[]') AS annexure_a,
  coalesce((SELECT '[' || string_agg(to_json({{'page_no': page_no, 's_no': s_no, 'circular_no': circular_no, 'circular_date': circular_date}}), ',' ORDER BY page_no) || ']' FROM a WHERE a.doc_id = d.doc_id), '[]') AS appendix FROM d""")
def fixture_files(t: Tables) -> DataFrame:
    """Three whole blocks of every document, written as golden files and read back from them; three documents have none."""
    rows = t.sql(REGISTER)
    listed = registers.change_entries(rows.select("doc_id", "page_no", F.array("c0", "c2", F.lit("")).alias("cells")))
    appendix = registers.appendix_entries(rows.select("doc_id", "page_no", F.array(F.array(F.array("c0", "c1", "c2"))).alias("tables"), F.lit(1).alias("appendix_page")))
    none = t.spark.range(3).select(F.concat(F.lit("none/"), F.col("id").cast("string")).alias("doc_id"))
    index = _index(t)
    documents = index.select("doc_id").union(rows.select("doc_id")).distinct().union(none)
    order = {"toc": (index, ("block", "start_page", "section_no", "row_no"), TOC_ROW), "annexure_a": (listed, ("page_no",), CHANGE_ROW), "appendix": (appendix, ("page_no",), APPENDIX_ROW)}
    folder = Scratch(t.spark, "fixtures").path("golden")
    fixtures.write_fixtures(writers.blocks(documents, order), folder, FOLDERS)
    read = fixtures.read_fixtures(t.spark, folder, {name: row for name, (_, _, row) in order.items()})
    return read.select("doc_id", *[F.to_json(name, {"ignoreNullFields": "false"}).alias(name) for name in order])


@query("SELECT 'item' || item_id AS name, strlen(text || chr(10)) AS size, sha256(text || chr(10)) AS sha256, CAST(row_number() OVER (ORDER BY 'item' || item_id) AS INTEGER) AS place FROM {benchmark}")
def corpus_files(t: Tables) -> DataFrame:
    """Files of a corpus in order of their paths, with size and digest: every item's text is a file."""
    folder = Scratch(t.spark, "corpus").path("files")
    items = t.table("benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), "text")
    items.write.partitionBy("name").text(folder)
    listed = readers.list_documents(t.spark, folder, "*.txt").select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "size", "sha256")
    return listed.withColumn("place", F.row_number().over(Window.orderBy("name")).cast("int"))


_RULE_PLACES = " ".join(f"WHEN {key} THEN {at}" for at, key in enumerate(RULE_ORDER, 1))


@query(f"SELECT CAST(position AS INTEGER) AS position, 'name=' || name AS name, content || chr(10) AS content FROM (SELECT CASE n_nationkey {_RULE_PLACES} END AS position, name, content FROM ({BOOKS})) WHERE position IS NOT NULL")
def rulebook_files(t: Tables) -> DataFrame:
    """Rulebooks read from files in their fixed order; every nation has a file, and some are in the order."""
    folder, books = Scratch(t.spark, "rules").path("files"), t.sql(BOOKS)
    books.select("name", "content").write.partitionBy("name").text(folder)
    names = {r["n_nationkey"]: r["name"] for r in books.select("n_nationkey", "name").collect()}  # one row a rulebook
    return readers.read_rulebooks(t.spark, folder, [f"name={names[k]}" for k in RULE_ORDER])


@query(f"SELECT CAST(row_number() OVER (ORDER BY position) - 1 AS INTEGER) AS position, id, label, provider, coalesce(available, true) AS available, artifacts FROM ({MODELS})")
def models_file(t: Tables) -> DataFrame:
    """Models of a JSON configuration file, in their places there."""
    folder = Scratch(t.spark, "models").path("config")
    model = F.struct("position", "id", "label", "provider", "available", "artifacts")
    config = t.sql(MODELS).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(model)), lambda m: m.dropFields("position")).alias("models"))).alias("value"))  # a configuration is one file
    config.write.text(folder)
    return readers.read_models(t.spark, folder).select("position", "id", "label", "provider", F.coalesce("available", F.lit(True)).alias("available"), "artifacts")


@query(f"SELECT doc_id, count(*) AS named, count(CASE WHEN n = 0 THEN 1 END) AS missing, count(CASE WHEN n = 0 THEN 1 END) = 0 AS covered FROM ({ORACLES['change_paras_vs_clauses']}) GROUP BY doc_id")
def change_paras_covered(t: Tables) -> DataFrame:
    """Whether the paragraphs of each document's change list are a subset of its clauses."""
    return changes.is_covered(change_paras_vs_clauses(t))
