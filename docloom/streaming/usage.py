"""An extension: the usage ledger over a stream of calls, with late calls bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.config import BUDGET
from docloom.sources.scratch import Scratch


def windowed_usage(calls: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls and value by job and window of event time (ts, event_type, value)."""
    by = calls.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.col("window.start").alias("window_start"), "event_type", "calls", "cents")


def guarded(calls: DataFrame, cap: float = BUDGET["per_run_inr"], max_calls: int = BUDGET["max_calls"]) -> DataFrame:
    """The budget's stop over a stream of calls (run, seq, projected_inr, cost_inr): run, seq, allowed.

    The state of a run is what it spent, how many calls it made and whether it was stopped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, made, stopped = state.get if state.exists else (0.0, 0, False)
        rows = pd.concat(list(parts)).sort_values("seq")  # one run's calls of one micro-batch
        allowed = []
        for r in rows.itertuples():
            stopped = stopped or made >= max_calls or spent + r.projected_inr > cap
            allowed.append(not stopped)
            if not stopped:
                spent, made = spent + r.cost_inr, made + 1
        state.update((spent, made, stopped))
        yield pd.DataFrame({"run": key[0], "seq": rows["seq"], "allowed": allowed})

    return calls.groupBy("run").applyInPandasWithState(step, "run bigint, seq bigint, allowed boolean", "spent double, made bigint, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result from files: the last table in complete mode, else all parts.

    Each micro-batch writes a folder of its own, so one that runs again replaces what it had written.
    """
    scratch = Scratch(spark, name)
    out, done = scratch.path("result"), []

    def keep(part: DataFrame, k: int) -> None:
        part.write.mode("overwrite").parquet(f"{out}/batch={k}")
        done.append(f"{out}/batch={k}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", scratch.path("progress")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    kept = list(dict.fromkeys(done))
    return spark.read.schema(stream.schema).parquet(*(kept[-1:] if mode == "complete" else kept)) if kept else spark.createDataFrame([], stream.schema)
