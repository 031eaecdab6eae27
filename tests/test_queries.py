"""Every query with SQL equals it on the smallest tables; entry() and the streams run."""

import json

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalog
from docloom.plans.registry import TABLES
from docloom.streaming.usage import drain, guarded

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def flat(df: pd.DataFrame) -> list:
    """Rows in one order, with values that compare alike in both engines."""

    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "None"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19].removesuffix("T00:00:00")
        return str(round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    columns = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](catalog.Tables(spark, FOLDER)).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert flat(got) == flat(want)
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](catalog.Tables(spark, FOLDER)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_budget_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(r, k, 10.0, 10.0) for r in (1, 2) for k in range(6)], "run bigint, seq bigint, projected_inr double, cost_inr double")
    rows.write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "calls"))
    got = drain(guarded(stream, cap=35, max_calls=9), spark, "guarded_calls", "append").where("allowed").groupBy("run").count().collect()
    assert {r.run: r["count"] for r in got} == {1: 3, 2: 3}


def test_canonical_documents_hold_whole_texts(spark, tmp_path):
    rows = [(1, "one text \u00e9\n\"q\""), (2, "x" * 100_000), (3, None)]
    found = []
    for k, more in enumerate(("", "!")):
        spark.createDataFrame([(i, t and t + more) for i, t in rows], "doc_id bigint, text string").write.parquet(f"{tmp_path}/{k}/documents.parquet")
        found.append({r.doc_id: r for r in catalog.QUERIES["canonical_documents"](catalog.Tables(spark, f"{tmp_path}/{k}")).collect()})
    assert all(json.loads(found[0][i].canonical)["text"] == t for i, t in rows)
    assert [found[0][i].dom_hash != found[1][i].dom_hash for i, _ in rows] == [True, True, False]
