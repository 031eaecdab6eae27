"""The streamed budget against the one that sorts all calls."""

import random

from pyspark.sql import functions as F

from docloom.operators import ledger
from docloom.streaming import budget

SCHEMA = "ts timestamp, run bigint, seq bigint, projected_inr double, cost_inr double"


def feed(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, "at bigint, run bigint, seq bigint, projected_inr double, cost_inr double").withColumn("at", F.timestamp_seconds("at")).withColumnRenamed("at", "ts").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_and_unordered_calls_are_decided_in_order(spark, tmp_path):
    rng = random.Random(3)
    start = 1_700_000_000
    calls = [(start + k, k % 5, k, float(rng.randrange(1, 9)), float(rng.randrange(1, 9))) for k in range(400)]
    place = sorted(calls, key=lambda c: c[2] + rng.randrange(50))  # at most 50 seconds late
    batches = [place[k : k + 100] for k in range(0, 400, 100)]
    too_late = (start - 10_000, 0, 999, 1.0, 1.0)
    batches[2] = [*batches[2], too_late]
    batches.append([(start + 100_000, -1, 0, 0.0, 0.0)])
    stream = feed(spark, str(tmp_path / "in"), batches)
    got = {(r["run"], r["seq"]): r["allowed"] for r in budget.decide(budget.guarded_in_order(stream, "60 seconds", cap=90, max_calls=25), "test").collect()}
    whole = spark.createDataFrame([c[1:] for c in calls], "run bigint, seq bigint, projected_inr double, cost_inr double")
    want = {(r["run"], r["seq"]): r["allowed"] for r in ledger.run_budget(whole, cap=90, warn=10, max_calls=25).collect()}
    assert got == want and 0 < sum(want.values()) < 400
