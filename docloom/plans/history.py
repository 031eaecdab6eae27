"""Queries on many versions: stretches in which obligations hold, chains of supersession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import versions
from docloom.plans.registry import Tables, query

# Nine versions of five families; obligations come, change, go and come again by rules on the customer's number.
ISSUES = "SELECT c_mktsegment AS family, CAST(c_nationkey % 9 AS INT) AS version FROM {customer} GROUP BY c_mktsegment, c_nationkey % 9"
HELD = "SELECT family, version, obligation_id, terms FROM (SELECT c_mktsegment AS family, CAST(v.c_nationkey AS INT) AS version, c.c_custkey AS obligation_id, CASE WHEN c.c_custkey % 10 = 0 THEN NULL ELSE floor((v.c_nationkey + c.c_custkey % 4) / (2 + c.c_custkey % 3)) END AS terms, (c.c_custkey * 7 + v.c_nationkey * v.c_nationkey * 3) % 11 AS k FROM {customer} c JOIN (SELECT n_nationkey AS c_nationkey FROM {nation}) v ON v.c_nationkey < 11) h WHERE k > 2"
ISLANDS = f"""WITH p AS (SELECT family, version, row_number() OVER (PARTITION BY family ORDER BY version) AS pos, count(*) OVER (PARTITION BY family) AS ended FROM ({ISSUES})),
h AS (SELECT family, obligation_id, terms, pos, ended, version FROM ({HELD}) JOIN p USING (family, version)), g AS (SELECT *, pos - row_number() OVER (PARTITION BY family, obligation_id, terms ORDER BY pos) AS island FROM h),
r AS (SELECT family, obligation_id, terms, min(pos) AS a, max(pos) AS z, min(version) AS since, max(version) AS until, max(ended) AS final FROM g GROUP BY family, obligation_id, terms, island),
n AS (SELECT *, row_number() OVER w AS nth, lag(z) OVER w AS before, lead(a) OVER w AS after FROM r WINDOW w AS (PARTITION BY family, obligation_id ORDER BY a))
SELECT family, obligation_id, CAST(nth AS INTEGER) AS nth, CAST(terms AS BIGINT) AS terms, since, until, CAST(z - a + 1 AS INTEGER) AS versions, CASE WHEN before IS NULL THEN CASE WHEN a = 1 THEN 'original' ELSE 'added' END WHEN before = a - 1 THEN 'modified' ELSE 'reappeared' END AS began,
  CASE WHEN z = final THEN 'in_force' WHEN after = z + 1 THEN 'modified' ELSE 'superseded' END AS ended FROM n"""


def _history(t: Tables) -> DataFrame:
    return versions.obligation_history(t.sql(ISSUES), t.sql(HELD).withColumn("terms", F.col("terms").cast("bigint")))


@query(ISLANDS)
def obligation_history(t: Tables) -> DataFrame:
    return _history(t)


@query(f"SELECT family, began, ended, count(*) AS n, count(DISTINCT obligation_id) AS obligations, CAST(sum(versions) AS BIGINT) AS versions FROM ({ISLANDS}) GROUP BY ALL")
def history_counts(t: Tables) -> DataFrame:
    return _history(t).groupBy("family", "began", "ended").agg(F.count("*").alias("n"), F.count_distinct("obligation_id").alias("obligations"), F.sum("versions").alias("versions"))


# Each circular supersedes one of the three before it, some nothing, some one that isn't there, and some a later one.
CHAIN = """SELECT 'N' || CAST(c_custkey AS STRING) AS version, c_nationkey AS issued, CASE WHEN c_custkey % 611 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 503 = 0 THEN 'lost' WHEN c_custkey % 97 = 5 THEN 'N' || CAST(c_custkey + 2 AS STRING)
  ELSE 'N' || CAST(c_custkey - 1 - c_custkey % 3 AS STRING) END AS supersedes FROM {customer}"""


@query(f"""WITH RECURSIVE l AS (SELECT c.version, c.issued, p.version AS supersedes FROM ({CHAIN}) c LEFT JOIN ({CHAIN}) p ON p.version = c.supersedes),
w AS (SELECT version, version AS root, CAST(0 AS BIGINT) AS depth FROM l WHERE supersedes IS NULL UNION ALL SELECT l.version, w.root, w.depth + 1 FROM w JOIN l ON l.supersedes = w.version),
t AS (SELECT root, arg_max(version, struct_pack(i := issued, v := version)) AS latest FROM w JOIN l USING (version) GROUP BY root)
SELECT l.version, w.root, w.depth, w.root IS NULL AS cyclic, t.latest FROM l LEFT JOIN w USING (version) LEFT JOIN t ON t.root = w.root""")
def supersession_chains(t: Tables) -> DataFrame:
    """Root, depth and latest version of every circular's whole chain."""
    return versions.supersession_chains(t.sql(CHAIN))
