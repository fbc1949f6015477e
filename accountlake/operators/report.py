"""Run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def writes_by_action(writes: DataFrame) -> DataFrame:
    return writes.groupBy("action").agg(F.count("*").alias("n")).orderBy("action")


def failures(writes: DataFrame) -> DataFrame:
    return writes.where(F.col("action") == "failed").select("domain", "error")


def spend(results: DataFrame) -> DataFrame:
    """Tokens and cost of fresh and of reused results; no cost where nothing has a price."""
    p = F.col("provenance")
    tokens = F.coalesce(p["input_tokens"], F.lit(0)) + F.coalesce(p["output_tokens"], F.lit(0))
    cost = F.coalesce(p["cost_usd"], F.lit(0.0))
    totals = results.where(p.isNotNull()).groupBy("from_cache").agg(
        F.count("*").alias("results"),
        F.sum(tokens).alias("tokens"),
        F.sum(cost).alias("_cost"),
        F.bool_or(cost != 0).alias("priced"),
    )
    return totals.select(
        "from_cache", "results", "tokens", F.when(F.col("priced"), F.col("_cost")).alias("cost_usd"), "priced"
    )


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def delivery_counts(events: DataFrame, queued: str = "queued") -> DataFrame:
    """Received, queued and skipped events per delivery."""
    return events.groupBy("delivery").agg(
        F.count("*").alias("received"),
        F.count_if(F.col(queued)).alias("queued"),
        F.count_if(~F.col(queued)).alias("skipped"),
    )
