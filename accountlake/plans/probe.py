"""Which of the usual paths exist on which sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from accountlake import vocab
from accountlake.functions.text import blank_to_null
from accountlake.functions.urls import url_path
from accountlake.operators.keys import row_per_key
from accountlake.operators.verdicts import path_verdicts
from accountlake.spark import stored


def probe_paths(
    controls: DataFrame,
    crawl: DataFrame,
    topics: Mapping[str, Sequence[str]] | None = None,
    **options,
) -> DataFrame:
    """A verdict for every domain of ``controls`` and every path of ``topics``.

    ``crawl`` holds answers by requested ``url``; a path that was never answered
    counts as a failed fetch. Answers under the paths are stored before the newest is picked, which looks at them twice:
    whatever made their text is run once.
    """
    topics = vocab.PATH_TOPICS if topics is None else topics
    paths = F.array(*map(F.lit, topics))
    asked = controls.select("domain", F.explode(paths).alias("path")).withColumn(
        "url", F.concat(F.lit("https://"), F.col("domain"), F.col("path"))
    )
    asked_for = crawl.where(url_path("url").isin(*topics)).select(
        "url", "final_url", "status_code", "fetch_error", "fetched_at",
        F.coalesce(blank_to_null("markdown"), "html").alias("text"),
    )
    answers = row_per_key(stored(asked_for, "answers"), ["url"], ["fetched_at"], last=True)
    candidates = asked.join(answers, "url", "left").select(
        "domain", "path",
        F.coalesce("final_url", "url").alias("final_url"), "status_code",
        F.when(F.col("fetched_at").isNull(), F.concat("url", F.lit(": no answer")))
        .otherwise(F.col("fetch_error")).alias("fetch_error"),
        "text",
    )
    return path_verdicts(candidates, controls, topics=topics, **options)
