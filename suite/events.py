"""Change events, in batches and as streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from accountlake.config import Mapping, Profile
from accountlake.operators import report
from accountlake.plans.enrich import enrich_pages, plan_writes
from accountlake.spark import shared_dir, stored
from accountlake.streaming import events as E
from accountlake.streaming.jobs import run_dedupe, run_jobs, run_resolve
from accountlake.streaming.metrics import observed, observed_counts
from accountlake.streaming.retry import first_attempt, ready_jobs
from suite.pages import rendered
from suite.registry import query, table

SUBSCRIPTION = "CASE event_type WHEN 'signup' THEN 'company.creation' WHEN 'error' THEN 'company.deletion' ELSE 'company.propertyChange' END"
PROPERTY = "CASE event_type WHEN 'click' THEN 'domain' WHEN 'purchase' THEN 'website' WHEN 'view' THEN 'phone' END"


def crm_events(raw, arrival="ts"):
    """Site events as change events of company records; expensive ones carry no id of their own."""
    return raw.select(
        F.when(F.col("value") <= 30, F.col("event_id")).alias("eventId"), F.col("user_id").alias("objectId"),
        F.expr(SUBSCRIPTION).alias("subscriptionType"), F.expr(PROPERTY).alias("propertyName"),
        F.when(F.col("value") < 5, "").when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".example"))).alias("propertyValue"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("occurredAt"), F.col(arrival).cast("timestamp").alias("ingest_ts"),
        "event_id",
    )


def with_redeliveries(df, arrival="ingest_ts"):
    """Every event twice, the second time an hour later."""
    return df.unionByName(df.withColumn(arrival, F.col(arrival) + F.expr("interval 1 hour")))


def events(spark, sf):
    return table(spark, sf, "events")


CRM_SQL = f"""crm AS (SELECT event_id, CASE WHEN value <= 30 AND event_id <> 0 THEN event_id END AS eid, user_id, {SUBSCRIPTION} AS sub, {PROPERTY} AS prop,
  CASE WHEN value < 5 THEN '' WHEN event_type IN ('click', 'purchase') THEN 'user' || user_id || '.example' END AS val, ts FROM events),
jobs AS (SELECT 'hubspot:' || CASE WHEN eid IS NOT NULL THEN eid::VARCHAR ELSE user_id || ':' || coalesce(prop, 'None') || ':' || epoch_ms(date_trunc('day', ts)::TIMESTAMP) END AS key,
  'hubspot' AS system, user_id::VARCHAR AS record_id, CASE WHEN prop IN ('domain', 'website') THEN nullif(val, '') END AS domain, sub AS event, event_id, ts
  FROM crm WHERE sub = 'company.creation' OR (sub = 'company.propertyChange' AND prop IN ('domain', 'website')))"""


@query("crm_jobs", f"WITH {CRM_SQL} SELECT key, system, record_id, domain, event FROM jobs")
def crm_jobs(spark, sf):
    return E.crm_jobs(crm_events(events(spark, sf))).drop("ingest_ts")


@query("event_keys", f"WITH {CRM_SQL} SELECT event_id, 'hubspot:' || CASE WHEN eid IS NOT NULL THEN eid::VARCHAR ELSE user_id || ':' || coalesce(prop, 'None') || ':' || epoch_ms(date_trunc('day', ts)::TIMESTAMP) END AS key, CASE WHEN prop IN ('domain', 'website') THEN nullif(val, '') END AS domain FROM crm")
def event_keys(spark, sf):
    e = crm_events(events(spark, sf))
    return e.select(
        "event_id", E.event_key("eventId", "objectId", "propertyName", "occurredAt").alias("key"), E.event_domain("propertyName", "propertyValue").alias("domain")
    )


def account_records(spark, sf):
    return events(spark, sf).select(
        F.when(F.col("event_type").isin("view", "click"), F.col("user_id").cast("string")).when(F.col("event_type") == "error", "").alias("record_id"),
        F.when(F.col("event_type").isin("click", "signup"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example"))).alias("website"),
        F.col("ts").cast("timestamp").alias("ingest_ts"), "event_id",
    )


ACCOUNT_SQL = """acc AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN user_id::VARCHAR END AS rid,
  CASE WHEN event_type IN ('click', 'signup') THEN 'u' || user_id || '.example' END AS site, ts, event_id FROM events),
ajobs AS (SELECT 'salesforce:' || coalesce(rid, site) AS key, 'salesforce' AS system, rid AS record_id, site AS domain, ts, event_id FROM acc WHERE coalesce(rid, site) IS NOT NULL)"""


@query("account_jobs", f"WITH {ACCOUNT_SQL} SELECT key, system, record_id, domain FROM ajobs")
def account_jobs(spark, sf):
    return E.account_jobs(account_records(spark, sf)).select("key", "system", "record_id", "domain")


@query("refused_replays", "SELECT event_type, count(*) FILTER (WHERE value * 10 > 300) AS refused, count(*) FILTER (WHERE value * 10 <= 300) AS accepted FROM (SELECT event_type, trunc(value * 10000) / 10000 AS value FROM events) GROUP BY 1")
def refused_replays(spark, sf):
    """Deliveries that arrive ``value * 10`` seconds after they were signed."""
    sent = events(spark, sf).select("event_type", F.col("ts").cast("timestamp").alias("sent"), "value")
    late = sent.withColumn("arrived", F.timestamp_millis(F.unix_millis("sent") + F.floor(F.col("value") * 10000)))
    accepted, refused = E.split_replays(late, "sent", "arrived")
    each = accepted.select("event_type", F.lit(0).alias("r")).unionByName(refused.select("event_type", F.lit(1).alias("r")))
    return each.groupBy("event_type").agg(F.count_if(F.col("r") == 1).alias("refused"), F.count_if(F.col("r") == 0).alias("accepted"))


@query("first_event_per_key", f"WITH {CRM_SQL} SELECT key, arg_min(event_id, ts) AS event_id, arg_min(domain, ts) FILTER (WHERE true) AS first_known_domain FROM jobs GROUP BY key")
def first_event_per_key(spark, sf):
    e = with_redeliveries(crm_events(events(spark, sf)))
    jobs = e.where(E.event_wanted("subscriptionType", "propertyName")).select(
        E.event_key("eventId", "objectId", "propertyName", "occurredAt").alias("key"), "event_id",
        E.event_domain("propertyName", "propertyValue").alias("domain"), "ingest_ts",
    )
    first_domain = E.dedupe_batch(jobs.where("domain is not null")).select("key", F.col("domain").alias("first_known_domain"))
    return E.dedupe_batch(jobs).select("key", "event_id").join(first_domain, "key", "left")


def accounts(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("record_id"), F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit(".example")).alias("domain")
    )


RESOLVED_SQL = CRM_SQL + """,
resolved AS (SELECT j.key, j.event_id, j.event, record_id, ts, coalesce(domain, CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) || c_custkey || '.example' END) AS domain
  FROM jobs j LEFT JOIN customer ON c_custkey::VARCHAR = record_id)"""


@query("resolve_event_domain", f"WITH {RESOLVED_SQL} SELECT key, record_id, domain, event FROM resolved")
def resolve_event_domain(spark, sf):
    """Domains looked up by record id; the busiest records are spread over several tasks."""
    jobs = E.crm_jobs(crm_events(events(spark, sf)))
    return E.resolve_event_domain(jobs, accounts(spark, sf), rows_per_task=100).select("key", "record_id", "domain", "event")


@query("delivery_counts", f"WITH {CRM_SQL} SELECT c.user_id AS delivery, count(*) AS received, count(j.event_id) AS queued, count(*) - count(j.event_id) AS skipped FROM crm c LEFT JOIN jobs j USING (event_id) GROUP BY 1")
def delivery_counts(spark, sf):
    e = crm_events(events(spark, sf)).select(F.col("objectId").alias("delivery"), E.event_wanted("subscriptionType", "propertyName").alias("queued"))
    return report.delivery_counts(e)


@query("first_attempts", f"WITH {RESOLVED_SQL} SELECT key, CASE WHEN domain IS NULL THEN 'pending' ELSE 'ready' END AS status, CASE WHEN domain IS NULL THEN strftime(ts + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') END AS run_after, CASE WHEN domain IS NULL THEN 'record ' || record_id || ' has no website yet' END AS last_error FROM resolved")
def first_attempts(spark, sf):
    jobs = E.resolve_event_domain(E.crm_jobs(crm_events(events(spark, sf))), accounts(spark, sf))
    return first_attempt(jobs).select("key", "status", F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"), "last_error")


@query("jobs_by_status", f"WITH {RESOLVED_SQL} SELECT CASE WHEN domain IS NULL THEN 'pending' ELSE 'ready' END AS status, count(*) AS n FROM resolved GROUP BY 1")
def jobs_by_status(spark, sf):
    jobs = E.resolve_event_domain(E.crm_jobs(crm_events(events(spark, sf))), accounts(spark, sf))
    return report.jobs_by_status(first_attempt(jobs))


@query("ready_jobs", "SELECT event_id AS id, user_id FROM events WHERE event_type = 'signup' AND ts + value * INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-15'")
def ready_jobs_query(spark, sf):
    jobs = events(spark, sf).select(
        F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type") == "signup", "pending").otherwise("done").alias("status"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=F.lit(0), secs=F.col("value") * 60)).alias("run_after"),
    )
    return ready_jobs(jobs, datetime(2024, 1, 15, tzinfo=timezone.utc)).select("id", "user_id")


# --- streams ---------------------------------------------------------------


def event_stream(spark, sf):
    """The events file as a stream source."""
    schema = events(spark, sf).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(df, purpose, mode="append"):
    """Run a stream over everything there is and read back what it wrote."""
    spark = df.sparkSession
    out, checkpoint = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-checkpoint")
    started = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("stream_jobs", f"WITH {CRM_SQL} SELECT key, system, record_id, domain, event FROM jobs")
def stream_jobs(spark, sf):
    return drain(E.crm_jobs(crm_events(event_stream(spark, sf))), "jobs").drop("ingest_ts")


PERIODS, PERIOD_DAYS = 3, 10
FIRST_DAY = "2024-01-01"


def delivered(raw, start, purpose):
    """Every event twice, an hour apart, in three deliveries by arrival, each read by a run of the stream that takes what is new.

    The folder the runs wrote to.
    """
    arrivals = with_redeliveries(raw.withColumn("arrived", F.col("ts")), "arrived")
    spark = arrivals.sparkSession
    source, out, mark = (shared_dir(spark, f"{purpose}-{x}") for x in ("arrivals", "out", "checkpoint"))
    period = F.floor(F.datediff(F.to_date("arrived"), F.to_date(F.lit(FIRST_DAY))) / PERIOD_DAYS)
    for k in range(PERIODS):
        due = period <= 0 if k == 0 else period >= k if k == PERIODS - 1 else period == k
        arrivals.where(due).write.mode("append").parquet(source)
        start(spark.readStream.schema(arrivals.schema).parquet(source), out, mark).awaitTermination()
    return out


BATCH_SQL = f"greatest(0, least({PERIODS - 1}, date_diff('day', DATE '{FIRST_DAY}', ts::DATE) // {PERIOD_DAYS}))"


@query("stream_dedupe", f"""WITH RECURSIVE {ACCOUNT_SQL},
arr AS (SELECT key, system, domain, ts FROM ajobs UNION ALL SELECT key, system, domain, ts + INTERVAL 1 HOUR FROM ajobs),
accepted AS (SELECT key, min(ts) AS ts FROM arr GROUP BY key
  UNION ALL SELECT d.key, min(d.ts) FROM accepted a JOIN arr d ON d.key = a.key AND d.ts > a.ts + INTERVAL 72 HOUR GROUP BY d.key)
SELECT a.key, any_value(system) AS system, (list(domain ORDER BY domain NULLS FIRST))[1] AS domain, strftime(a.ts, '%Y-%m-%d %H:%M:%S.%g') AS arrived
FROM accepted a JOIN arr d ON d.key = a.key AND d.ts = a.ts GROUP BY a.key, a.ts""")
def stream_dedupe(spark, sf):
    """Redeliveries dropped over three batches: a record id counts at its first arrival, and again after 72 hours."""
    def start(stream, out, mark):
        jobs = E.account_jobs(stream.select(
            F.when(F.col("event_type").isin("view", "click"), F.col("user_id").cast("string")).alias("record_id"),
            F.when(F.col("event_type").isin("click", "signup"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example"))).alias("website"),
            F.col("arrived").cast("timestamp").alias("ingest_ts"),
        ))
        return run_dedupe(jobs, out=out, checkpoint=mark)

    out = delivered(events(spark, sf), start, "dedupe")
    return spark.read.parquet(f"{out}/new").select(
        "key", "system", "domain", F.date_format("ingest_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("arrived"))


@query("stream_resolve_domain", f"""WITH {RESOLVED_SQL} SELECT key, record_id, domain, event FROM resolved
UNION ALL SELECT key, record_id, domain, event FROM resolved""")
def stream_resolve_domain(spark, sf):
    """Every delivery with its record's domain, over three batches; the busiest records are spread over several tasks."""
    def start(stream, out, mark):
        return run_resolve(E.crm_jobs(crm_events(stream, "arrived")), lambda: accounts(spark, sf), out=out, checkpoint=mark, rows_per_task=100)

    out = delivered(events(spark, sf), start, "resolved")
    return spark.read.parquet(f"{out}/resolved").select("key", "record_id", "domain", "event")


DAY = 86_400  # seconds between attempts: long enough to wait from batch to batch

# One row per job: the batch it arrived in, the one it got a domain in (null: none), and how many attempts there are.
TRIED_SQL = CRM_SQL + f""",
arr AS (SELECT key, record_id, domain, event, ts, {BATCH_SQL} AS b FROM (
  SELECT * FROM jobs UNION ALL SELECT * REPLACE (ts + INTERVAL 1 HOUR AS ts) FROM jobs)),
clocks AS (SELECT b, max(ts) AS clock FROM arr GROUP BY b),
named AS (SELECT record_id, b, (list(domain ORDER BY ts DESC, key DESC))[1] AS named FROM arr WHERE domain IS NOT NULL GROUP BY 1, 2),
firsts AS (SELECT key, min(ts) AS ts, min(b) AS b, (list(struct_pack(record_id, domain, event) ORDER BY ts))[1] AS j FROM arr GROUP BY key),
known AS (SELECT f.key, f.ts, f.b, f.j.record_id AS record_id, f.j.event AS event,
    coalesce(f.j.domain, n.named, CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) || c_custkey || '.example' END) AS at_once
  FROM firsts f LEFT JOIN named n ON n.record_id = f.j.record_id AND n.b = f.b LEFT JOIN customer ON c_custkey::VARCHAR = f.j.record_id),
given AS (SELECT k.*, (SELECT min(c.b) FROM clocks c WHERE c.b >= k.b AND k.ts + 3 * {DAY} * INTERVAL 1 SECOND <= c.clock) AS fails,
    (SELECT min(n.b) FROM named n WHERE n.record_id = k.record_id AND n.b > k.b) AS later FROM known k),
settled AS (SELECT g.*, CASE WHEN at_once IS NOT NULL THEN g.b WHEN later <= coalesce(fails, later) THEN later END AS ready,
    CASE WHEN at_once IS NOT NULL THEN at_once WHEN later <= coalesce(fails, later) THEN n.named END AS domain
  FROM given g LEFT JOIN named n ON n.record_id = g.record_id AND n.b = g.later),
tries AS (SELECT s.*, CASE WHEN at_once IS NOT NULL THEN 1 ELSE (ready IS NOT NULL)::INT
    + 1 + (s.ts + {DAY} * INTERVAL 1 SECOND <= c.clock)::INT + (s.ts + 3 * {DAY} * INTERVAL 1 SECOND <= c.clock)::INT END AS n
  FROM settled s LEFT JOIN clocks c ON c.b = coalesce(s.ready - 1, {PERIODS - 1}))"""


@query("stream_wait_for_website", f"""WITH {TRIED_SQL},
each AS (SELECT *, unnest(generate_series(1, n)) AS attempts FROM tries)
SELECT key, attempts::BIGINT AS attempts, CASE WHEN ready IS NOT NULL AND attempts = n THEN 'ready' WHEN attempts = 3 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN attempts = n THEN domain END AS domain,
  CASE WHEN attempts < 3 AND NOT (ready IS NOT NULL AND attempts = n) THEN strftime(ts + attempts * (attempts + 1) / 2 * {DAY} * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') END AS run_after,
  CASE WHEN NOT (ready IS NOT NULL AND attempts = n) THEN 'record ' || record_id || ' has no website yet' END AS last_error FROM each""")
def stream_wait_for_website(spark, sf):
    """Every attempt of every job over three batches: looked up, completed by a later event of the same record, waiting, given up."""
    def start(stream, out, mark):
        return run_jobs(E.crm_jobs(crm_events(stream, "arrived")), lambda: accounts(spark, sf), lambda targets: targets.select("domain").limit(0),
                        out=out, checkpoint=mark, retry_seconds=DAY)

    out = delivered(events(spark, sf), start, "waiting")
    return spark.read.parquet(f"{out}/attempts").select(
        "key", F.col("attempts").cast("long").alias("attempts"), "status", "domain",
        F.date_format("run_after", "yyyy-MM-dd HH:mm:ss").alias("run_after"), "last_error",
    )


@query("stream_enrich_and_plan", f"""WITH {TRIED_SQL}, d AS (SELECT DISTINCT ready AS batch, domain FROM tries WHERE ready IS NOT NULL)
SELECT batch::INT AS batch, domain, CASE WHEN regexp_extract(domain, '([0-9]+)', 1)::BIGINT % 2 = 0 THEN 'updated' ELSE 'created' END AS action,
  CASE WHEN regexp_extract(domain, '([0-9]+)', 1)::BIGINT % 2 = 0 THEN 'R' || domain END AS record_id,
  row_number() OVER (PARTITION BY domain ORDER BY batch) > 1 AS from_cache FROM d""")
def stream_enrich_and_plan(spark, sf):
    """Events to planned writes over three batches: a page that was analysed in one is not analysed again in the next.

    Every domain's homepage is the page numbered like its record.
    """
    mapping, profile = Mapping.default(), Profile.default()
    pages = stored(rendered(spark, sf).drop("domain"), "rendered")
    number = F.regexp_extract("domain", "([0-9]+)", 1).cast("long")
    n_pages = table(spark, sf, "pages").agg(F.max("page_id") + 1).first()[0]

    def enrich(targets, prior):
        found = targets.withColumn("page_id", number % n_pages).join(pages, "page_id").drop("page_id")
        return enrich_pages(found.withColumn("error", F.lit(None).cast("string")), profile, prior=prior)

    def write_plan(results):
        stored = results.where(number % 2 == 0).select(F.concat(F.lit("R"), "domain").alias("record_id"), "domain")
        return plan_writes(results, mapping, "hubspot", stored)

    def start(stream, out, mark):
        return run_jobs(E.crm_jobs(crm_events(stream, "arrived")), lambda: accounts(spark, sf), write_plan, out=out, checkpoint=mark, enrich=enrich,
                        profile=profile, retry_seconds=DAY)

    out = delivered(events(spark, sf), start, "planned")
    cached = spark.read.parquet(f"{out}/results").select("batch", "domain", "from_cache")
    return spark.read.parquet(f"{out}/writes").select("batch", "domain", "action", "record_id").join(cached, ["batch", "domain"])


@query("stream_deliveries", f"""WITH {CRM_SQL}, arr AS (SELECT {BATCH_SQL.replace("ts::", "c.ts::")} AS batch, j.event_id FROM (
  SELECT event_id, ts FROM crm UNION ALL SELECT event_id, ts + INTERVAL 1 HOUR FROM crm) c LEFT JOIN jobs j ON j.event_id = c.event_id)
SELECT batch::BIGINT AS batch, count(*) AS received, count(event_id) AS queued, count(*) - count(event_id) AS skipped FROM arr GROUP BY 1""")
def stream_deliveries(spark, sf):
    """What each batch of the running stream received, queued and skipped, counted while it runs."""
    counts = {}

    def start(stream, out, mark):
        e = crm_events(stream, "arrived")
        seen = observed(e, E.event_wanted("subscriptionType", "propertyName"))
        started = run_dedupe(E.crm_jobs(seen), out=out, checkpoint=mark)
        started.awaitTermination()
        counts.update(observed_counts(started))
        return started

    delivered(events(spark, sf), start, "counted")
    rows = [(batch, *c) for batch, c in sorted(counts.items())]
    return spark.createDataFrame(rows, "batch long, received long, queued long, skipped long")


@query("stream_late_files", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-07') AS late FROM events GROUP BY 1""")
def stream_late_files(spark, sf):
    """Read by checkpoint: a file that arrives last with the oldest events is read too, once; a run with nothing new reads nothing."""
    raw = events(spark, sf)
    source, out, mark = (shared_dir(spark, f"late-{x}") for x in ("arrivals", "out", "checkpoint"))
    early = F.col("ts") < F.lit("2024-01-07").cast("timestamp")
    for rows in (raw.where(~early), raw.where(early), raw.limit(0)):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(raw.schema).parquet(source)
        stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    read = spark.read.schema(raw.schema).parquet(out)
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(early).alias("late"))
