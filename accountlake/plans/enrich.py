"""Accounts and a crawl table in, results and an upsert plan out."""

from __future__ import annotations

from collections.abc import Mapping as MappingABC
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from accountlake import vocab
from accountlake.config import Mapping, Profile
from accountlake.operators.analysis import analyse
from accountlake.operators.answers import with_fallback
from accountlake.operators.pages import resolve_homepages, targets, with_signals
from accountlake.operators.payload import build_payloads
from accountlake.operators.reuse import reuse_analyses
from accountlake.operators.upsert import upsert_plan
from accountlake.schemas import ANALYSIS, PROVENANCE, SIGNALS


def enrich_pages(
    pages: DataFrame,
    profile: Profile,
    *,
    prior: DataFrame | None = None,
    answers: DataFrame | None = None,
    analyzer: str = vocab.HEURISTIC_ANALYZER,
    analyzed_at: datetime | None = None,
    patterns: MappingABC[str, tuple[str, ...]] | None = None,
    **analysis,
) -> DataFrame:
    """Results for pages, one row each. A page with an ``error`` gives a failed row.

    Good, failed and reused pages stay in one DataFrame: a page's text is blanked
    where no analysis is wanted, which makes the string work on it free.
    """
    signals = with_signals(pages, patterns)
    keyword = analyzer == vocab.HEURISTIC_ANALYZER
    if prior is None:
        known = signals.withColumns({
            "_analysis": F.lit(None).cast(ANALYSIS), "_provenance": F.lit(None).cast(PROVENANCE),
            "from_cache": F.lit(False),
        })
    else:
        fingerprint = profile.fingerprint(with_keywords=keyword)
        known = reuse_analyses(signals, prior, analyzer=analyzer, profile=fingerprint)
        known = known.withColumnsRenamed({"analysis": "_analysis", "provenance": "_provenance"})
    wanted = ~F.col("from_cache") & F.col("error").isNull()
    masked = known.withColumns({
        c: F.when(wanted, F.col(c)) for c in ("title", "meta_description", "markdown")
    })
    fresh = analyse(masked, profile, analyzed_at=analyzed_at, **analysis)
    if answers is not None:
        fresh = with_fallback(fresh, answers, analyzed_at=analyzed_at)
    ok = F.col("error").isNull()
    return fresh.select(
        "domain", "ord", ok.alias("ok"),
        F.when(ok, F.coalesce("_analysis", "analysis")).alias("analysis"),
        F.when(ok, F.coalesce("_provenance", "provenance")).alias("provenance"),
        F.when(ok, F.col("tech_signals")).alias("tech_signals"),
        F.when(ok, F.col("page_signals")).alias("page_signals"),
        "error", "from_cache",
    )


def rejected(rejects: DataFrame, signals=SIGNALS) -> DataFrame:
    """Inputs that name no domain, as failed results."""
    return rejects.select(
        "domain", "ord", F.lit(False).alias("ok"),
        F.lit(None).cast(ANALYSIS).alias("analysis"), F.lit(None).cast(PROVENANCE).alias("provenance"),
        F.lit(None).cast("array<string>").alias("tech_signals"), F.lit(None).cast(signals).alias("page_signals"),
        "error", F.lit(False).alias("from_cache"),
    )


def enrich(accounts: DataFrame, crawl: DataFrame, profile: Profile, *, raw: str = "domain", **options) -> DataFrame:
    """One result per domain and one per unusable input; a bad row stops nothing.

    ``accounts`` has the raw domain and ``ord``, its place in the input.
    """
    domains, rejects = targets(accounts, raw)
    build = {k: options.pop(k) for k in ("signatures", "max_chars", "robots", "agent") if k in options}
    results = enrich_pages(resolve_homepages(domains, crawl, **build), profile, **options)
    return results.unionByName(rejected(rejects, results.schema["page_signals"].dataType))


def in_input_order(results: DataFrame) -> DataFrame:
    """Sorted for a reader; only sinks need it."""
    return results.orderBy("ord")


def plan_writes(
    results: DataFrame, mapping: Mapping, destination: str, existing: DataFrame | None, **options
) -> DataFrame:
    payloads = build_payloads(results, mapping, destination)
    return upsert_plan(
        payloads, existing, destination=destination, match_key=mapping.match_keys[destination], **options
    )


def analyses_to_keep(results: DataFrame, profile: Profile) -> DataFrame:
    """Fresh analyses in the shape ``prior`` is read in next time."""
    p = F.col("provenance")
    keyword = p["analyzer"] == vocab.HEURISTIC_ANALYZER
    return results.where(F.col("ok") & ~F.col("from_cache")).select(
        "domain", p["content_hash"].alias("content_hash"), p["analyzer"].alias("analyzer"),
        F.when(keyword, profile.fingerprint(with_keywords=True)).otherwise(profile.fingerprint()).alias("profile"),
        p["analyzed_at"].alias("analyzed_at"), "analysis", "provenance",
    )
