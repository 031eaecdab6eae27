"""Usage of hosted models: totals, cost, and the budget's stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import BUDGET, USD_TO_INR


def usage_by_job(usage: DataFrame) -> DataFrame:
    return usage.groupBy("job").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cache_read_tokens").alias("cache_read_tokens"), F.round(F.sum("seconds"), 4).alias("seconds"),
    )


def with_cost(usage: DataFrame, prices: DataFrame, usd_to_inr: float = USD_TO_INR) -> DataFrame:
    """`usage` with cost_inr; a model without a price is an error; a missing cache price is the input price."""
    p = prices.select(F.col("model"), F.col("input").alias("_in"), F.col("output").alias("_out"), F.coalesce("cache_write", "input").alias("_cw"), F.coalesce("cache_read", "input").alias("_cr"))
    joined = usage.join(p, "model", "left")
    usd = F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out") + F.col("cache_write_tokens") * F.col("_cw") + F.col("cache_read_tokens") * F.col("_cr")
    priced = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double")).otherwise(usd / 1_000_000 * usd_to_inr)
    return joined.withColumn("cost_inr", priced).drop("_in", "_out", "_cw", "_cr")


def with_route(jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """`jobs` with the model of their route; a job without one is an error."""
    joined = jobs.drop("model").join(routes, "job", "left")
    return joined.withColumn("model", F.when(F.col("model").isNull(), F.raise_error(F.concat(F.lit("no route for job "), F.col("job"))).cast("string")).otherwise(F.col("model")))


def run_budget(calls: DataFrame, cap: float = BUDGET["per_run_inr"], warn: float = BUDGET["warn_at_inr"], max_calls: int = BUDGET["max_calls"]) -> DataFrame:
    """Calls of runs (run, seq, projected_inr, cost_inr) with what the budget says before each.

    A call is refused when max_calls were made, or what was spent and is projected passes the cap; the first refusal
    stops the run. `warned` marks the call after which spending first reached the warning line.
    """
    order = Window.partitionBy("run").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost_inr").over(before), F.lit(0.0))
    made = F.row_number().over(order) - 1
    told = calls.withColumns({"spent_before": spent, "calls_before": made})
    fine = (F.col("calls_before") < max_calls) & ~(F.col("spent_before") + F.col("projected_inr") > cap)
    told = told.withColumn("fits", fine)
    told = told.withColumn("allowed", F.min("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    after = F.col("spent_before") + F.col("cost_inr")
    return told.withColumn("warned", F.col("allowed") & (F.col("spent_before") < warn) & (after >= warn))
