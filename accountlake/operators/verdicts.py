"""Soft-404 verdicts: candidate pages against their site's control page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from accountlake import vocab
from accountlake.functions import probing as P
from accountlake.functions.text import first_marker, token_hashes, token_overlap
from accountlake.operators.keys import lookup_join, row_per_key
from accountlake.spark import stored


def calibrate(controls: DataFrame) -> DataFrame:
    """One row per domain: how the site answers an impossible path, and the words it uses.

    ``controls``: answers per ``domain`` with ``status_code, fetch_error, text``; of several the one with the smallest status,
    error and hash counts. Words are 64-bit hashes, a fraction of the text.
    """
    mode = P.control_mode("fetch_error", "status_code", "text")
    # Looked at twice, for the winner and for its row.
    asked = stored(controls.select("domain", "status_code", "fetch_error", "text"), "controls")
    one = row_per_key(asked, ["domain"], ["status_code", "fetch_error"]).withColumn("mode", mode)
    return one.select("domain", "mode", F.when(F.col("mode") == P.SOFT, token_hashes("text")).alias("control_tokens"))


def path_verdicts(
    candidates: DataFrame,
    controls: DataFrame,
    *,
    gated_markers: Sequence[str] = vocab.GATED_MARKERS,
    missing_markers: Sequence[str] = vocab.MISSING_MARKERS,
    topics: Mapping[str, Sequence[str]] | None = None,
    **join,
) -> DataFrame:
    """``verdict, reason, confidence, similarity`` for every candidate.

    ``candidates``: ``domain, path, final_url, status_code, fetch_error, text``. All
    that is read off the text is read before the join, so neither the text nor its words are shuffled, only their hashes. The join
    looks at its rows twice, to count keys and to join: what led here is worked out once, and stored without the text.
    """
    facts = candidates.select(
        *[c for c in candidates.columns if c != "text"],
        token_hashes("text").alias("_tokens"),
        F.length(F.coalesce("text", F.lit(""))).alias("text_length"),
        first_marker("text", gated_markers).alias("_gated"),
        first_marker("text", missing_markers).alias("_missing"),
        P.on_topic("path", "text", topics).alias("_topic"),
    )
    joined = lookup_join(stored(facts, "candidates"), calibrate(controls), ["domain"], **join)
    compared = joined.withColumn(
        "similarity", F.when(F.col("mode") == P.SOFT, token_overlap("_tokens", "control_tokens"))
    )
    verdict = P.path_verdict(
        path="path", final_url="final_url", status="status_code", fetch_error="fetch_error",
        length="text_length", gated="_gated", missing="_missing",
        mode="mode", similarity="similarity", topic_hit="_topic",
    )
    judged = compared.withColumn("_v", verdict)
    return judged.select(
        *[c for c in candidates.columns if c != "text"],
        "text_length", "mode", "similarity", "_v.verdict", "_v.reason", "_v.confidence",
    )
