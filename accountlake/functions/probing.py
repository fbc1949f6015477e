"""Is an answered path a real page? Rules over one candidate and its site's control page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from accountlake import vocab
from accountlake.functions.text import any_contained, col
from accountlake.functions.urls import is_root

HONEST, SOFT, BLIND = "honest_404", "soft_404", "soft_404_blind"


def control_mode(fetch_error: Column | str, status: Column | str, text: Column | str) -> Column:
    """What a site does when asked for a page that cannot exist."""
    length = F.length(F.coalesce(col(text), F.lit("")))
    return (
        F.when(col(fetch_error).isNotNull() | (col(status) >= 400), HONEST)
        .when(length < vocab.MIN_CONTROL_TEXT, BLIND)
        .otherwise(SOFT)
    )


def on_topic(
    path: Column | str, text: Column | str, topics: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """Whether the text has one of the path's words; null for a path without a word list."""
    topics = vocab.PATH_TOPICS if topics is None else topics
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    answer = F.lit(None).cast("boolean")
    for known, words in topics.items():
        if words:
            answer = F.when(col(path) == known, any_contained(lowered, words)).otherwise(answer)
    return answer


def path_verdict(
    *,
    path: Column | str,
    final_url: Column | str,
    status: Column | str,
    fetch_error: Column | str,
    length: Column | str,
    gated: Column | str,
    missing: Column | str,
    mode: Column | str,
    similarity: Column | str,
    topic_hit: Column | str,
) -> Column:
    """``struct<verdict,reason,confidence>``; the first rule that fires decides."""
    path, final_url, status, fetch_error, length = map(col, (path, final_url, status, fetch_error, length))
    gated, missing, mode, similarity, topic_hit = map(col, (gated, missing, mode, similarity, topic_hit))
    similar = (mode == SOFT) & (similarity > vocab.SOFT_404_SIMILARITY)

    def say(verdict: str, reason: Column | str, sure: float) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit(verdict).alias("verdict"), reason.alias("reason"), F.lit(sure).alias("confidence")
        )

    def quoted(before: str, marker: Column) -> Column:
        mark = F.when(marker.contains("'"), F.lit('"')).otherwise(F.lit("'"))
        return F.concat(F.lit(before), mark, marker, mark, F.lit(")"))

    return (
        F.when(fetch_error.isNotNull(), say("missing", F.concat(F.lit("fetch failed: "), fetch_error), 0.9))
        .when(status >= 400, say("missing", F.concat(F.lit("HTTP "), status.cast("string")), 0.98))
        .when(
            is_root(final_url) & (F.btrim(path, F.lit("/")) != ""),
            say("missing", "redirected to the homepage", 0.95),
        )
        .when(gated.isNotNull(), say("gated", quoted("login wall (", gated), 0.85))
        .when(missing.isNotNull(), say("missing", quoted("not-found copy (", missing), 0.9))
        .when(
            similar,
            say("missing", F.format_string("soft 404: %.2f similar to the control page", similarity), 0.95),
        )
        .when(
            length < vocab.MIN_PAGE_TEXT,
            say("missing", F.format_string("only %d chars of content", length), 0.8),
        )
        .when(topic_hit, say("exists", "on-topic content found", 0.95))
        .when(
            mode == BLIND,
            say(
                "exists",
                "looks real, but the control page rendered nothing so soft 404s cannot be ruled out",
                0.5,
            ),
        )
        .when(~topic_hit, say("exists", "real page, but off-topic content", 0.6))
        .otherwise(say("exists", "real page", 0.8))
    )
