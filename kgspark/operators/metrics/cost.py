"""Cost and duration of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def priced(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Successful calls with their cost from a price list per million tokens; calls without a price are dropped."""
    cost = F.col("input_tokens") / 1e6 * F.col("price_in") + F.col("output_tokens") / 1e6 * F.col("price_out")
    return log.where("success").join(prices, "model").withColumn("cost", cost)


def totals(calls: DataFrame) -> DataFrame:
    """Per model and for all (model null) from one rollup: calls, tokens, cost."""
    return calls.rollup("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.round(F.avg("duration_ms"), 4).alias("mean_duration"), F.round(F.avg("amount"), 4).alias("mean_amount"), F.round(F.avg("cost"), 6).alias("mean_cost"), F.round(F.sum("cost"), 4).alias("total_cost"))
