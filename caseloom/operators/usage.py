"""Token and cost report over a fact table of calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from caseloom.constants import INPUT_PRICE_PER_MILLION, OUTPUT_PRICE_PER_MILLION


def usage_facts(df: DataFrame, step: str, call_id: str = "file_id") -> DataFrame:
    """Calls of one step, from rows that went through a model; rows without a call are left out."""
    called = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull() | F.col("model_error").isNotNull()
    return df.filter(called).select(
        F.col(call_id).alias("call_id"), "package_id", F.lit(step).alias("step"), "input_tokens", "output_tokens"
    )


def usage_totals(calls: DataFrame) -> DataFrame:
    """Calls and tokens per package, step and model, from rows with these columns, one per call. A call without token
    counts adds none."""
    tokens = (F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("input_tokens", "output_tokens"))
    return calls.groupBy("package_id", "step", "model").agg(F.count(F.lit(1)).alias("calls"), *tokens)


def usage_report(
    usage: DataFrame,
    by: Sequence[str] = (),
    input_price: float = INPUT_PRICE_PER_MILLION,
    output_price: float = OUTPUT_PRICE_PER_MILLION,
) -> DataFrame:
    """Tokens and USD, overall or per package, step or model. A failed call has NULL tokens."""
    sums = usage.groupBy(*by).agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    cost = F.col("input_tokens") / 1e6 * input_price + F.col("output_tokens") / 1e6 * output_price
    return sums.withColumn("total_cost_usd", cost)
