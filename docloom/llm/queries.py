"""The queries of this subpackage and their SQL: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, chat, decontaminate, delta_lloyd, html_text, language_id, ngram_join, periodic_runs, pii, secrets, sharding, topk, toxicity
from docloom.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's score and whether it is kept as a secret."""
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), model, path_col="source")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that overlap; clean documents have none."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose vec_id is divisible by 100."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def reply_traffic(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and messages out of turns that hold no tool calls themselves, by fixed rules.

    Each user turn is a call and the assistant turn right after it its result; all other turns are messages. The length
    n of a user turn's text decides what its call is like. It waits for the call two turns later where n is divisible
    by 3 and for the one two turns before where it is by 4, so there are chains and cycles. Its tool is unknown where n
    is divisible by 7; its arguments have a turn of a wrong type, an unknown field or no turn where n mod 5 is 1, 2, 3.
    """
    name = lambda turn: F.concat(F.lit("c"), F.when(F.col("no_conv"), "-").otherwise(F.col("conv_id").cast("string")), F.lit("-"), turn.cast("string"))
    n, text, turn = F.length("text"), F.col("text"), F.col("turn")
    arguments = (
        F.when(n % 5 == 1, F.to_json(F.struct(text, turn.cast("string").alias("turn"))))
        .when(n % 5 == 2, F.to_json(F.struct(F.lit("x").alias("hint"), text, turn)))
        .when(n % 5 == 3, F.to_json(F.struct(text)))
        .otherwise(F.to_json(F.struct(text, turn)))
    )
    calls = rows.where("role = 'user'").select(
        *chat.CONV, "turn", F.lit(0).alias("seq"), name(turn).alias("call_id"), F.when(n % 7 == 0, "find").otherwise("reply").alias("name"), arguments.alias("arguments"),
        F.array_compact(F.array(F.when(n % 3 == 0, name(turn + 2)), F.when(n % 4 == 0, name(turn - 2)))).alias("after"),
    )
    results = rows.where("role = 'assistant'").select(*chat.CONV, "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, rows.where("role is null or role not in ('user', 'assistant')")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all conversations, with calls and results that `reply_traffic` takes from their turns."""
    schemas = chat.schema_table(spark, {"reply": {"text": ("string", True), "turn": ("integer", True)}})
    return chat.format_records(*reply_traffic(chat.read_turns(table(spark, sf_dir, "conversations"))), schemas)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


OP10_SQL = """
WITH RECURSIVE k AS (
  SELECT conv_id, turn, role, text, length(text) AS n,
    CASE WHEN role = 'user' THEN 'c' || conv_id || '-' || turn WHEN role = 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id
  FROM conversations
), u AS (
  SELECT DISTINCT conv_id, turn, call_id FROM k WHERE role = 'user'
), e AS (
  SELECT DISTINCT a.conv_id, a.call_id, b.call_id AS other, b.turn FROM k a JOIN u b ON a.role = 'user' AND b.conv_id = a.conv_id
    AND (a.n % 3 = 0 AND b.turn = a.turn + 2 OR a.n % 4 = 0 AND b.turn = a.turn - 2)
), nodes AS (
  SELECT conv_id, count(*) AS most FROM u GROUP BY conv_id
), p AS (
  SELECT conv_id, call_id, other, turn, 1 AS steps FROM e
  UNION
  SELECT p.conv_id, p.call_id, e.other, e.turn, p.steps + 1 FROM p JOIN e ON e.conv_id = p.conv_id AND e.call_id = p.other JOIN nodes m ON m.conv_id = p.conv_id
  WHERE p.steps <= m.most
), w AS (
  SELECT p.conv_id, p.call_id, max(p.steps) > max(m.most) AS cyclic, max(p.turn * 1000000 + p.steps) AS place FROM p JOIN nodes m USING (conv_id) GROUP BY p.conv_id, p.call_id
), r AS (
  SELECT k.*, coalesce(w.cyclic, false) AS cyclic, CASE WHEN role = 'user' AND NOT w.cyclic THEN greatest(w.place, k.turn * 1000000) ELSE k.turn * 1000000 END AS place,
    EXISTS (SELECT 1 FROM k x WHERE x.role = 'assistant' AND k.role = 'user' AND x.call_id = k.call_id) AS answered,
    EXISTS (SELECT 1 FROM k x WHERE x.role = 'user' AND k.role = 'assistant' AND x.call_id = k.call_id) AS asked,
    row_number() OVER (PARTITION BY k.call_id, k.role ORDER BY k.turn, k.text) AS nth
  FROM k LEFT JOIN w ON k.role = 'user' AND w.conv_id = k.conv_id AND w.call_id = k.call_id
), j AS (
  SELECT conv_id, turn, call_id, cyclic, place,
    CASE WHEN role <> 'user' THEN '' WHEN n % 7 = 0 THEN 'tool' WHEN text IS NULL THEN 'missing:text'
      WHEN n % 5 = 1 THEN 'type:turn' WHEN n % 5 = 2 THEN 'unknown:hint' WHEN n % 5 = 3 THEN 'missing:turn' ELSE '' END AS errors,
    CASE role WHEN 'user' THEN CASE WHEN answered THEN 'call' ELSE 'open_call' END
      WHEN 'assistant' THEN CASE WHEN NOT asked THEN 'orphan_result' WHEN nth = 1 THEN 'result' ELSE 'extra_result' END ELSE 'message' END AS record,
    CASE role WHEN 'user' THEN '{"arguments":{' || CASE WHEN n % 5 = 2 THEN '"hint":"x",' ELSE '' END || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) END
        || CASE WHEN n % 5 = 3 THEN '' WHEN text IS NULL THEN '"turn":' || turn WHEN n % 5 = 1 THEN ',"turn":"' || turn || '"' ELSE ',"turn":' || turn END
        || '},"id":"' || call_id || '","name":"' || CASE WHEN n % 7 = 0 THEN 'find' ELSE 'reply' END || '","type":"call"}'
      WHEN 'assistant' THEN '{"call_id":"' || call_id || '","content":' || coalesce(to_json(text), 'null') || ',"type":"result"}'
      ELSE '{"content":' || coalesce(to_json(text), 'null') || ',"role":"' || role || '","type":"message"}' END AS json,
    CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE -1 END AS seq, CASE WHEN role IN ('user', 'assistant') THEN call_id END AS id
  FROM r
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, turn, seq, record, json) - 1 AS position, turn, record, id AS call_id, cyclic, errors, json
FROM j
"""


def _rounds(rounds: int) -> str:
    """Lloyd's rounds one after the other: `a` has each vector's least distance * 8 + centroid, `c` the centroids."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT v.vec_id, min(CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 8 + c.k) AS best
  FROM v CROSS JOIN c{k} c GROUP BY v.vec_id
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY pos) AS x FROM (
    SELECT a.best % 8 AS k, u.pos, sum(u.value) AS s, count(*) AS n FROM a{k} a JOIN u USING (vec_id) GROUP BY ALL
  ) GROUP BY k
), c{k + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (k)
)""")
    return ", ".join(steps)


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), u AS MATERIALIZED (
  SELECT vec_id, unnest(x) AS value, unnest(range(64)) AS pos FROM v
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, x FROM v ORDER BY k LIMIT 8
), {_rounds(10)}, d AS (
  SELECT vec_id, best % 8 AS k, best // 8 AS distance FROM a10
)
SELECT vec_id, CAST(d.k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY d.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d JOIN c10 c ON c.k = d.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_text, op2_toxicity, op3_secrets, op4_decontaminate, op5_byte_bpe, op6_kd_shards, op7_ngram_join, op8_pii, op9_top_k, op10_chat, op11_periodic_runs, op12_language_id, op13_delta_lloyd)}


def oracle_sql() -> dict[str, str]:
    return {"op9_top_k": OP9_SQL, "op10_chat": OP10_SQL, "op13_delta_lloyd": OP13_SQL}
