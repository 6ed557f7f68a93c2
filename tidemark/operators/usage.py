"""Usage cost and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Price in dollars per million input and output tokens.
TOKEN_PRICES = [
    ("claude-3-5-sonnet-20241022", 3.0, 15.0),
    ("claude-3-5-haiku-20241022", 1.0, 5.0),
    ("claude-3-opus-20240229", 15.0, 75.0),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4-turbo", 10.0, 30.0),
    ("gpt-3.5-turbo", 0.5, 1.5),
]

# Outcomes a run log may hold.
OUTCOMES = ("successful", "fallback", "failed", "skipped")


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOKEN_PRICES, "model string, input_price double, output_price double")


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost per model from (model, input_tokens, output_tokens); no price means 0.

    Tokens are summed per model first: the price join sees one row per model, so
    a model with most of the usage is no hot key.
    """
    per_model = usage.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    cost = (
        F.col("input_tokens") / 1e6 * F.col("input_price") + F.col("output_tokens") / 1e6 * F.col("output_price")
    )
    return per_model.join(prices, "model", "left").select(
        "model", "calls", "input_tokens", "output_tokens", F.coalesce(cost, F.lit(0.0)).alias("cost")
    )


def run_summary(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Totals per run from (run, status, cost, duration, error)."""
    return log.groupBy(run).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s) for s in OUTCOMES],
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_time"),
        F.count("error").alias("errors"),
    )


def run_errors(log: DataFrame, run: str = "run_id") -> DataFrame:
    """The failing entries themselves, one row each."""
    return log.where(F.col("error").isNotNull()).select(run, "item", "status", "error")
