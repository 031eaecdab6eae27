"""An extension: the budget's stop over a stream of calls that come late and out of order.

Whether a call is allowed follows from all calls of its run before it, so a call waits until none before it can come
any more: until the watermark has passed its time. Waiting calls are state of their run; a timer at the earliest of them
wakes the run, which then decides what is due, in order, and goes to sleep again. What a run holds is its calls of the
watermark's delay, and decisions leave by a file sink, whose files count once their micro-batch is committed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.config import BUDGET
from docloom.sources.scratch import Scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECISION = "run bigint, seq bigint, allowed boolean"


class BudgetGuard(StatefulProcessor):
    """Decides the calls of one run (ts, seq, projected_inr, cost_inr) in order of time and number."""

    def __init__(self, cap: float, max_calls: int):
        self.cap, self.max_calls = cap, max_calls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "spent double, made bigint, stopped boolean")
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, projected double, cost double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        at = (came["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        calls = list(zip(at, came["seq"].tolist(), came["projected_inr"].astype(float).tolist(), came["cost_inr"].astype(float).tolist(), strict=True))
        self.waiting.appendList(calls)
        self.handle.registerTimer(min(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        calls = sorted(tuple(c) for c in self.waiting.get())
        due, later = [c for c in calls if c[0] <= now], [c for c in calls if c[0] > now]
        if not due:
            return
        spent, made, stopped = self.total.get() if self.total.exists() else (0.0, 0, False)
        allowed = []
        for _, _, projected, cost in due:
            stopped = stopped or made >= self.max_calls or spent + projected > self.cap
            allowed.append(not stopped)
            if not stopped:
                spent, made = spent + cost, made + 1
        self.total.update((spent, made, stopped))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        yield pd.DataFrame({"run": [key[0]] * len(due), "seq": [c[1] for c in due], "allowed": allowed})

    def close(self) -> None:
        pass


def guarded_in_order(calls: DataFrame, late: str, cap: float = BUDGET["per_run_inr"], max_calls: int = BUDGET["max_calls"]) -> DataFrame:
    """run, seq and allowed of a stream of calls (ts, run, seq, projected_inr, cost_inr) that come up to `late` late.

    Calls that come later than that are left out, as the watermark does; calls of one time are taken by seq. State is
    kept by RocksDB, which the session must name when the stream starts.
    """
    by_run = calls.withWatermark("ts", late).groupBy("run")
    return by_run.transformWithStateInPandas(BudgetGuard(cap, max_calls), DECISION, "Append", "EventTime")


def decide(decisions: DataFrame, name: str) -> DataFrame:
    """Run a stream of decisions over all that is there into files of the shared folder, and read them."""
    spark = decisions.sparkSession
    scratch = Scratch(spark, name)
    out, key = scratch.path("decisions"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        query = decisions.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path("progress")).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(decisions.schema).parquet(out)
