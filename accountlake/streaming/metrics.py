"""Counts of a running stream, taken on the way: no job of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "deliveries"
COUNTS = ("received", "queued", "skipped")


def observed(events: DataFrame, queued: Column, name: str = NAME) -> DataFrame:
    """``events``, counted as they pass: received, of them queued, and skipped.

    Rows that are read again after an executor was lost count again: these are figures to watch a stream by.
    """
    wanted = F.coalesce(queued, F.lit(False))
    return events.observe(
        name, F.count(F.lit(1)).alias("received"), F.count_if(wanted).alias("queued"), F.count_if(~wanted).alias("skipped"))


def _counts(progress, name: str) -> tuple[int, ...] | None:
    row = (progress.observedMetrics or {}).get(name)
    return None if row is None else tuple(row[c] for c in COUNTS)


def observed_counts(query: StreamingQuery, name: str = NAME) -> dict[int, tuple[int, ...]]:
    """Received, queued and skipped of every micro-batch the query still knows of, by batch."""
    found = {p.batchId: _counts(p, name) for p in query.recentProgress}
    return {batch: c for batch, c in found.items() if c is not None}


class DeliveryListener(StreamingQueryListener):
    """Hands the counts of every micro-batch of every query to ``report(query name or id, batch, counts)`` as it ends.

    ``spark.streams.addListener(DeliveryListener(print))``
    """

    def __init__(self, report, name: str = NAME):
        self.report, self.name = report, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = _counts(event.progress, self.name)
        if counts is not None:
            self.report(event.progress.name or str(event.progress.id), event.progress.batchId, dict(zip(COUNTS, counts, strict=True)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
