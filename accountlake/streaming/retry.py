"""Jobs whose record has no website yet: when they are tried again, and which may run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from accountlake import vocab


def no_website(record_id: Column | str) -> Column:
    c = F.col(record_id) if isinstance(record_id, str) else record_id
    return F.concat(F.lit("record "), F.coalesce(c, F.lit("None")), F.lit(" has no website yet"))


def due_after(time: str, attempts: int, retry_seconds: int = vocab.RETRY_SECONDS) -> Column:
    """When the attempt after ``attempts`` is due: attempt n waits n times ``retry_seconds`` for the next."""
    return F.col(time) + F.make_dt_interval(secs=F.lit(float(retry_seconds * attempts * (attempts + 1) / 2)))


def first_attempt(jobs: DataFrame, retry_seconds: int = vocab.RETRY_SECONDS, time: str = "ingest_ts") -> DataFrame:
    """Status of every job right after its first try: ready, or pending until ``run_after``."""
    has_domain = F.col("domain").isNotNull()
    return jobs.select(
        "key", "system", "record_id", "domain", "event",
        F.when(has_domain, "ready").otherwise("pending").alias("status"),
        F.lit(1).alias("attempts"),
        F.when(~has_domain, due_after(time, 1, retry_seconds)).alias("run_after"),
        F.when(~has_domain, no_website("record_id")).alias("last_error"),
    )


def ready_jobs(jobs: DataFrame, now: datetime, n: int = 0) -> DataFrame:
    """Pending jobs that may run now, oldest id first; ``n`` of them, 0 for all."""
    ready = jobs.where((F.col("status") == "pending") & (F.col("run_after") <= F.lit(now))).orderBy("id")
    return ready.limit(n) if n else ready
