"""Change events to jobs. Every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accountlake import vocab
from accountlake.functions.text import blank_to_null, col
from accountlake.operators.keys import lookup_join, one_per_key


def event_wanted(subscription: Column | str, property_name: Column | str) -> Column:
    """A new account, or a change of its website."""
    changed = (col(subscription) == vocab.CHANGE_EVENT) & col(property_name).isin(*vocab.WEBSITE_PROPERTIES)
    return F.coalesce((col(subscription) == vocab.CREATION_EVENT) | changed, F.lit(False))


def event_domain(property_name: Column | str, value: Column | str) -> Column:
    return F.when(col(property_name).isin(*vocab.WEBSITE_PROPERTIES), blank_to_null(value))


def event_key(
    event_id: Column | str, object_id: Column | str, property_name: Column | str, occurred_at: Column | str,
    system: str = "hubspot",
) -> Column:
    """The event's id where it has one, else what it is about and when."""
    fallback = F.concat_ws(
        ":", F.lit(system), col(object_id).cast("string"),
        F.coalesce(col(property_name), F.lit("None")),
        F.unix_millis(col(occurred_at).cast("timestamp")).cast("string"),
    )
    by_id = F.concat(F.lit(f"{system}:"), F.nullif(col(event_id), F.lit(0)).cast("string"))
    return F.coalesce(by_id, fallback)


def account_event_key(record_id: Column | str, website: Column | str, system: str = "salesforce") -> Column:
    return F.concat(F.lit(f"{system}:"), F.coalesce(blank_to_null(record_id), blank_to_null(website)))


def crm_jobs(events: DataFrame) -> DataFrame:
    """Jobs for the events worth acting on: ``key, system, record_id, domain, event, ingest_ts``."""
    return events.where(event_wanted("subscriptionType", "propertyName")).select(
        event_key("eventId", "objectId", "propertyName", "occurredAt").alias("key"),
        F.lit("hubspot").alias("system"),
        F.col("objectId").cast("string").alias("record_id"),
        event_domain("propertyName", "propertyValue").alias("domain"),
        F.col("subscriptionType").alias("event"),
        "ingest_ts",
    )


def account_jobs(records: DataFrame) -> DataFrame:
    """Jobs for account records that carry an id or a website."""
    key = account_event_key("record_id", "website")
    return records.where(key.isNotNull()).select(
        key.alias("key"), F.lit("salesforce").alias("system"),
        blank_to_null("record_id").alias("record_id"), blank_to_null("website").alias("domain"),
        F.lit(None).cast("string").alias("event"), "ingest_ts",
    )


def too_old(
    sent: Column | str, arrived: Column | str, seconds: int = vocab.MAX_EVENT_AGE_SECONDS
) -> Column:
    """A delivery older than the limit on arrival is a replay."""
    age_ms = F.unix_millis(col(arrived).cast("timestamp")) - F.unix_millis(col(sent).cast("timestamp"))
    return age_ms > seconds * 1000


def split_replays(events: DataFrame, sent: str, arrived: str) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``."""
    old = too_old(sent, arrived)
    return events.where(~old), events.where(old)


def dedupe_batch(jobs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First delivery of every key in a bounded set; of deliveries at the same time the smallest."""
    order = order or ["ingest_ts"]
    return one_per_key(jobs, ["key"], [*order, *[c for c in jobs.columns if c not in ("key", *order)]])


def resolve_event_domain(jobs: DataFrame, accounts: DataFrame, **join) -> DataFrame:
    """Fill in the domain of jobs that only know a record id.

    ``accounts``: ``record_id`` and its ``domain``; of several domains the smallest counts. Streams
    join it as a static table; in a batch the busiest record ids are spread.
    """
    known = accounts.select("record_id", blank_to_null("domain").alias("_known")).where("_known is not null")
    known = one_per_key(known, ["record_id"], ["_known"])
    if jobs.isStreaming:
        joined = jobs.join(known, "record_id", "left")
    else:
        joined = lookup_join(jobs, known, ["record_id"], **join)
    domain = F.coalesce(blank_to_null("domain"), blank_to_null("_known")).alias("domain")
    return joined.select(*[domain if c == "domain" else F.col(c) for c in jobs.columns])
