"""Reuse of earlier pages, analyses and runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from accountlake.config import Profile
from accountlake.functions.text import content_hash
from accountlake.functions.urls import domain_of
from accountlake.operators import reuse
from accountlake.operators.predicates import modified_since
from suite.registry import query, table
from suite.sqltext import domain

PROFILE = Profile.default()
ANALYZER = "openai:gpt-5-mini"


def pages(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("domain"), "doc_id", content_hash("text").alias("content_hash")
    )


def prior(spark, sf):
    """Two analyses of every labelled document; some of other content, another model or another profile."""
    labelled = pages(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    other_text = (F.col("toxic") == 1) & (F.col("quality") == 1)
    keyed = labelled.select(
        "domain", F.when(other_text, "0" * 16).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "anthropic:claude-haiku-4-5").otherwise(ANALYZER).alias("analyzer"),
        F.when(F.left("content_hash", F.lit(1)) == "a", "stale").otherwise(PROFILE.fingerprint()).alias("profile"),
        F.col("quality"), F.posexplode(F.array(F.lit("2024-01-01"), F.lit("2024-02-01"))).alias("version", "day"),
    )
    return keyed.select(
        "domain", "content_hash", "analyzer", "profile", F.to_timestamp("day").alias("analyzed_at"),
        F.struct((F.col("quality") * 10 + F.col("version")).cast("long").alias("score")).alias("analysis"),
        F.struct(F.col("analyzer")).alias("provenance"),
    )


_PRIOR = """WITH d AS (SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents),
known AS (SELECT doc_id, quality * 10 + 1 AS score FROM labels JOIN d USING (doc_id) WHERE toxic = 0 AND left(h, 1) <> 'a')"""


@query("reuse_analyses", _PRIOR + " SELECT d.doc_id, k.doc_id IS NOT NULL AS from_cache, k.score::BIGINT AS score FROM d LEFT JOIN known k USING (doc_id)")
def reuse_analyses(spark, sf):
    joined = reuse.reuse_analyses(pages(spark, sf), prior(spark, sf), analyzer=ANALYZER, profile=PROFILE.fingerprint())
    return joined.select("doc_id", "from_cache", F.col("analysis.score").alias("score"))


@query("pages_to_analyse", _PRIOR + " SELECT doc_id, h AS content_hash FROM d WHERE doc_id NOT IN (SELECT doc_id FROM known)")
def pages_to_analyse(spark, sf):
    left = reuse.pages_to_analyse(pages(spark, sf), prior(spark, sf), analyzer=ANALYZER, profile=PROFILE.fingerprint())
    return left.select("doc_id", "content_hash")


@query("latest_analyses", _PRIOR + """ SELECT d.doc_id::VARCHAR AS domain, quality::BIGINT * 10 + 1 AS score, CASE WHEN toxic = 1 AND quality = 1 THEN '0000000000000000' ELSE h END AS content_hash
FROM labels JOIN d USING (doc_id)""")
def latest_analyses(spark, sf):
    return reuse.latest_analyses(prior(spark, sf)).select("domain", F.col("analysis.score").alias("score"), "content_hash")


@query("latest_pages", f"SELECT {domain('url')} AS domain, arg_max(url, page_id) AS url, substr(sha256(arg_max(html, page_id)), 1, 16) AS digest FROM pages GROUP BY 1")
def latest_pages(spark, sf):
    snapshots = table(spark, sf, "pages").select(
        domain_of("url").alias("domain"), "url", content_hash("html").alias("digest"), F.timestamp_seconds("page_id").alias("fetched_at")
    )
    return reuse.latest_pages(snapshots).select("domain", "url", "digest")


NOW = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)


@query("stale_domains", """
SELECT c_custkey::VARCHAR AS domain FROM customer WHERE c_custkey NOT IN (
  SELECT user_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 168 HOUR)""")
def stale_domains(spark, sf):
    """Accounts without a view in the last week; each view counts as a fetched page."""
    domains = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("domain"))
    snapshots = table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("domain"), F.col("ts").cast("timestamp").alias("fetched_at")
    )
    return reuse.stale_domains(domains, snapshots, NOW)


def run_log(spark, sf):
    """Every event as a finished run of a job named after its type; it started an hour before."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("key"), (F.col("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("ran_at"),
        F.col("user_id").alias("records"), F.col("ts").cast("timestamp").alias("recorded_at"),
    )


@query("watermarks", "SELECT event_type AS key, strftime(max(ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS ran_at, arg_max(user_id, ts) AS records FROM events GROUP BY 1")
def watermarks(spark, sf):
    return reuse.watermarks(run_log(spark, sf)).select("key", F.date_format("ran_at", "yyyy-MM-dd HH:mm:ss").alias("ran_at"), "records")


@query("since_last_run", "SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'signup')")
def since_last_run(spark, sf):
    """Events after the start of the last 'signup' run: the incremental read."""
    start = reuse.last_run(run_log(spark, sf), "signup")
    return modified_since(table(spark, sf, "events"), "ts", start).select("event_id", "user_id")


SHOPS = Profile("Shops", "Sells things.", good_fit=("one", "two"))


@query("profile_fingerprint", """WITH p AS (SELECT left(sha256('ICP: Shops' || chr(10) || chr(10) || 'Sells things.' || chr(10) || chr(10)
    || 'Strong fit signals:' || chr(10) || '- one' || chr(10) || '- two'), 8) AS profile)
SELECT doc_id, substr(sha256(text || '-' || profile), 1, 16) AS cache_key, profile FROM documents, p""")
def profile_fingerprint(spark, sf):
    key = SHOPS.fingerprint()
    return table(spark, sf, "documents").select("doc_id", content_hash(F.concat("text", F.lit("-" + key))).alias("cache_key"), F.lit(key).alias("profile"))
