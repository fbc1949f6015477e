"""Where payloads, results, snapshots and run records go."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from accountlake.schemas import RUN_LOG


def write_payloads_json(payloads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Dry run, nested: one JSON object per account, absent properties left out."""
    good = payloads.where("error is null")
    good.select("domain", "object_type", "match_key", "match_value", "properties").write.mode(mode).json(path)


def flat_payloads(payloads: DataFrame) -> DataFrame:
    """One column per property, the domain first and once."""
    names = [n for n in payloads.schema["properties"].dataType.names if n.lower() != "domain"]
    return payloads.where("error is null").select("domain", *[F.col(f"properties.`{n}`") for n in names])


def write_payloads_flat(payloads: DataFrame, path: str, mode: str = "overwrite") -> None:
    flat_payloads(payloads).write.mode(mode).csv(path, header=True, escape='"')


def write_results_json(results: DataFrame, writes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full nested results and what became of them, side by side."""
    results.write.mode(mode).json(f"{path}/results")
    writes.write.mode(mode).json(f"{path}/writes")


def write_snapshot(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Pages by fetch day, so that reuse reads only days young enough."""
    dated = pages.withColumn("fetch_date", F.to_date("fetched_at"))
    dated.write.mode(mode).partitionBy("fetch_date").parquet(path)


def read_snapshot(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    pages = spark.read.parquet(path)
    if since is not None:
        pages = pages.where((F.col("fetch_date") >= F.lit(since.date())) & (F.col("fetched_at") >= F.lit(since)))
    return pages.drop("fetch_date")


def append_run_log(
    spark: SparkSession, path: str, key: str, started_at: datetime, records: int, recorded_at: datetime
) -> None:
    """Remember a run by its start: what changed while it ran is then read again."""
    row = spark.createDataFrame([(key, started_at, records, recorded_at)], RUN_LOG)
    row.coalesce(1).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).parquet(path)
