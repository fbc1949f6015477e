"""Not doing the same work twice: snapshots, prior analyses, run watermarks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from accountlake import vocab
from accountlake.operators.keys import row_per_key

ANALYSIS_KEY = ("domain", "content_hash", "analyzer", "profile")


def latest_pages(snapshots: DataFrame, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """The newest snapshot of every domain."""
    return row_per_key(snapshots, keys, ["fetched_at"], last=True)


def stale_domains(
    domains: DataFrame, snapshots: DataFrame, now: datetime, ttl_hours: float = vocab.PAGE_TTL_HOURS
) -> DataFrame:
    """Domains without a page young enough to reuse."""
    oldest = F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_hours * 3600.0))
    # distinct first: a domain crawled very often must not fill one task of the join
    fresh = snapshots.where(F.col("fetched_at") >= oldest).select("domain").distinct()
    return domains.join(fresh, "domain", "left_anti")


def latest_analyses(prior: DataFrame) -> DataFrame:
    return row_per_key(prior, ANALYSIS_KEY, ["analyzed_at"], last=True)


def _keyed(pages: DataFrame, analyzer: str, profile: str) -> DataFrame:
    return pages.withColumns({"analyzer": F.lit(analyzer), "profile": F.lit(profile)})


def reuse_analyses(pages: DataFrame, prior: DataFrame, *, analyzer: str, profile: str) -> DataFrame:
    """All pages; the ones with a prior analysis of the same content, analyzer and profile carry it.

    ``prior``: the key columns, ``analyzed_at``, ``analysis``, ``provenance``.
    ``pages`` has one row per domain, so no key is hot on either side.
    """
    wanted = prior.where((F.col("analyzer") == analyzer) & (F.col("profile") == profile))
    known = latest_analyses(wanted).select("domain", "content_hash", "analysis", "provenance")
    joined = pages.join(known, ["domain", "content_hash"], "left")
    return joined.select(
        *pages.columns, "analysis", "provenance", F.col("analysis").isNotNull().alias("from_cache")
    )


def pages_to_analyse(pages: DataFrame, prior: DataFrame, *, analyzer: str, profile: str) -> DataFrame:
    """Only the pages ``reuse_analyses`` finds nothing for."""
    known = prior.where("analysis is not null").select(*ANALYSIS_KEY).distinct()
    return (
        _keyed(pages, analyzer, profile)
        .join(known, list(ANALYSIS_KEY), "left_anti")
        .select(*pages.columns)
    )


def watermarks(run_log: DataFrame) -> DataFrame:
    """Start time and record count of the last recorded run of every key."""
    last = F.max_by(F.struct("ran_at", "records"), F.col("recorded_at")).alias("r")
    return run_log.groupBy("key").agg(last).select("key", "r.*")


def last_run(run_log: DataFrame, key: str) -> datetime | None:
    """Start of the last run of one key: a single value for the driver."""
    row = watermarks(run_log.where(F.col("key") == key)).first()
    return row["ran_at"] if row else None
