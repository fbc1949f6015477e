"""Event rules, redeliveries, waiting for a website, jobs to writes."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from samples import HOMEPAGE, NOW
from pyspark.sql import functions as F

from accountlake.config import Mapping, Profile
from accountlake.plans.enrich import enrich_pages, plan_writes
from accountlake.operators.pages import resolve_homepages
from accountlake.operators.payload import build_payloads
from accountlake.schemas import CRM_EVENT
from accountlake.streaming import events as E
from accountlake.streaming.jobs import new_jobs, run_dedupe, run_jobs, run_resolve, with_ticks
from accountlake.streaming.metrics import DeliveryListener, observed, observed_counts
from accountlake.streaming.retry import first_attempt, ready_jobs

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def event(i, sub="company.propertyChange", prop="domain", value="acme.com", at=0, obj=42):
    moment = T0 + timedelta(seconds=at)
    return (i, obj, sub, prop, value, T0, moment)


@pytest.fixture
def crm(spark):
    return lambda *rows: spark.createDataFrame(rows, CRM_EVENT)


def test_which_events_become_jobs(crm):
    df = crm(
        event(1), event(2, prop="phone", value="555"), event(3, "company.creation", None, None, obj=99), event(4, "company.deletion", None, None),
        event(5, prop="website", value=""), event(None, at=1), event(0, at=2), event(None, "company.creation", None, None, obj=7),
    )
    got = [(r.key, r.record_id, r.domain) for r in E.crm_jobs(df).collect()]
    ms = int(T0.timestamp() * 1000)
    assert got == [
        ("hubspot:1", "42", "acme.com"), ("hubspot:3", "99", None), ("hubspot:5", "42", None),
        (f"hubspot:42:domain:{ms}", "42", "acme.com"), (f"hubspot:42:domain:{ms}", "42", "acme.com"), (f"hubspot:7:None:{ms}", "7", None),
    ]


def test_account_records(spark):
    rows = [("001", "https://a.com", T0), (None, "https://b.com", T0), ("", "", T0), (None, None, T0)]
    df = spark.createDataFrame(rows, "record_id string, website string, ingest_ts timestamp")
    assert [r.key for r in E.account_jobs(df).collect()] == ["salesforce:001", "salesforce:https://b.com"]


def test_replays(spark):
    df = spark.createDataFrame([(T0, T0 + timedelta(seconds=s)) for s in (0, 300, 300.001, 9999)], "sent timestamp, got timestamp")
    accepted, refused = E.split_replays(df, "sent", "got")
    assert (accepted.count(), refused.count()) == (2, 2)


def stream(spark, path, df):
    """Write one more file for a file stream."""
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_redeliveries_are_dropped_across_restarts(spark, crm, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    hours = 3600
    batches = [
        [event(7, value="late.com", at=9), event(7, value="first.com"), event(7, value="later.com", at=5), event(8, at=6)],
        [event(7, at=hours), event(9, at=2 * hours)],
        [event(8, at=70 * hours), event(10, at=400 * hours)],
        [event(8, value="again.com", at=401 * hours)],
        [event(11, at=500 * hours)],
    ]
    for rows in batches:
        jobs = E.crm_jobs(stream(spark, src, crm(*rows)))
        run_dedupe(jobs, out=out, checkpoint=ck).awaitTermination()
    got = sorted((r.key, r.domain) for r in spark.read.parquet(f"{out}/new").collect())
    # 8 comes back long after it was forgotten and is taken again
    assert got == [
        ("hubspot:10", "acme.com"), ("hubspot:11", "acme.com"), ("hubspot:7", "first.com"), ("hubspot:8", "acme.com"),
        ("hubspot:8", "again.com"), ("hubspot:9", "acme.com"),
    ]


def test_the_first_of_many_deliveries_wins(spark, crm, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [event(k, value=f"{at}.com", at=at) for k in range(1, 201) for at in range(20, 0, -1)]
    run_dedupe(E.crm_jobs(stream(spark, src, crm(*rows))), out=out, checkpoint=ck).awaitTermination()
    got = spark.read.parquet(f"{out}/new").collect()
    assert len(got) == 200 and {r.domain for r in got} == {"1.com"}


def greedy(deliveries, hours):
    """Accepted ``(key, time)`` of deliveries, one after the other."""
    last, out = {}, []
    for at, key in sorted((t, k) for k, t in deliveries):
        if key not in last or at > last[key] + timedelta(hours=hours):
            last[key] = at
            out.append((key, at))
    return sorted(out)


@pytest.mark.parametrize("cuts", [0, 1, 5])
def test_batches_do_not_change_what_is_accepted(spark, cuts):
    """Two months of deliveries in one batch or in several; one key has a third of them."""
    rnd = random.Random(3)
    rows = sorted(
        (T0 + timedelta(minutes=rnd.randrange(60 * 24 * 60)), rnd.choice(["hot", f"k{rnd.randrange(9)}", f"r{i}"])) for i in range(900))
    rows += rows[::7]  # delivered again at the same time
    want = greedy([(k, t) for t, k in rows], 72)
    schema = "ingest_ts timestamp, key string, domain string"
    seen, got = None, []
    size = -(-len(rows) // (cuts + 1))
    rows.sort()
    for s in range(0, len(rows), size):
        batch = spark.createDataFrame([(t, k, "x") for t, k in rows[s : s + size]], schema)
        fresh = new_jobs(batch, seen, 72).select("key", "ingest_ts").collect()
        got += [(r.key, r.ingest_ts.replace(tzinfo=timezone.utc)) for r in fresh]
        seen = spark.createDataFrame([(k, t) for k, t in got], "key string, ingest_ts timestamp")
    assert sorted(got) == want


def test_a_batch_writes_its_own_keys_and_old_days_go(spark, crm, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    day = 24 * 3600
    for k, rows in enumerate(([event(1), event(2)], [event(3, at=day)], [event(4, at=9 * day)])):
        run_dedupe(E.crm_jobs(stream(spark, src, crm(*rows))), out=out, checkpoint=ck).awaitTermination()
        log = spark.read.parquet(f"{out}/seen").where(F.col("batch") == k)
        assert sorted(r.key for r in log.collect()) == sorted(f"hubspot:{r[0]}" for r in rows)
    assert sorted(p.name for p in (tmp_path / "out" / "seen").glob("day=*")) == ["day=2026-01-10"]


def test_time_passes_although_nothing_arrives(spark, crm, tmp_path):
    """One event, then only a clock: the job is tried again and given up."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    none = spark.createDataFrame([], "record_id string, domain string")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).option(
        "startTimestamp", int(T0.timestamp() * 1000)).option("advanceMillisPerBatch", 40_000).load()
    jobs = with_ticks(E.crm_jobs(stream(spark, src, crm(creation(1, 0, 5)))), ticks)
    query = run_jobs(jobs, lambda: none, lambda t: t, out=out, checkpoint=ck, available_now=False)
    try:
        for _ in range(120):
            time.sleep(1)
            assert query.exception() is None
            done = list((tmp_path / "out").glob("writes/batch=*/_SUCCESS"))
            if len(done) >= 4:
                break
    finally:
        query.stop()
    got = sorted((r.attempts, r.status) for r in spark.read.parquet(f"{out}/attempts").collect())
    assert got == [(1, "pending"), (2, "pending"), (3, "failed")]
    assert len(list((tmp_path / "out").glob("waiting/batch=*"))) <= 3


def test_counts_of_the_running_stream(spark, crm, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [event(1), event(2, prop="phone"), event(3, "company.deletion", None, None), event(4)]
    raw = observed(stream(spark, src, crm(*rows)), E.event_wanted("subscriptionType", "propertyName"))
    heard = []
    listener = DeliveryListener(lambda name, batch, counts: heard.append((batch, counts)))
    spark.streams.addListener(listener)
    try:
        query = run_dedupe(E.crm_jobs(raw), out=out, checkpoint=ck)
        query.awaitTermination()
        for _ in range(50):
            if heard:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert observed_counts(query) == {0: (4, 2, 2)}
    assert heard == [(0, {"received": 4, "queued": 2, "skipped": 2})]


def test_analyses_are_kept_from_batch_to_batch(spark, crm, tmp_path):
    """A second event about an unchanged page reuses the analysis; a page that changed is analysed again."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    accounts = spark.createDataFrame([], "record_id string, domain string")
    profile = Profile.default()
    html = {"page": HOMEPAGE}

    def enrich(domains, prior):
        crawl = spark.createDataFrame(
            [("https://acme.com/", "https://acme.com/", 200, html["page"], NOW)],
            "url string, final_url string, status_code int, html string, fetched_at timestamp")
        return enrich_pages(resolve_homepages(domains, crawl), profile, prior=prior, analyzed_at=NOW)

    for k, page in enumerate((HOMEPAGE, HOMEPAGE, HOMEPAGE.replace("webinar", "seminar"))):
        html["page"] = page
        jobs = E.crm_jobs(stream(spark, src, crm(event(10 + k, at=k))))
        run_jobs(jobs, lambda: accounts, lambda r: r.select("domain", "from_cache"), out=out, checkpoint=ck, enrich=enrich, profile=profile).awaitTermination()
    got = sorted((r.batch, r.from_cache) for r in spark.read.parquet(f"{out}/writes").collect())
    assert got == [(0, False), (1, True), (2, False)]
    assert spark.read.parquet(f"{out}/analyses").count() == 2


def test_first_delivery_wins(crm):
    got = E.dedupe_batch(E.crm_jobs(crm(event(7, value="late.com", at=9), event(7, value="first.com"), event(8)))).collect()
    assert sorted((r.key, r.domain) for r in got) == [("hubspot:7", "first.com"), ("hubspot:8", "acme.com")]


def test_domains_are_looked_up(spark, crm):
    jobs = E.crm_jobs(crm(event(1, "company.creation", None, None, obj=1), event(2, "company.creation", None, None, obj=2), event(3, obj=1)))
    accounts = spark.createDataFrame([("1", "one.com"), ("3", "three.com")], "record_id string, domain string")
    got = {r.key: r.domain for r in E.resolve_event_domain(jobs, accounts, rows_per_task=1).collect()}
    assert got == {"hubspot:1": "one.com", "hubspot:2": None, "hubspot:3": "acme.com"}
    states = {r.key: (r.status, r.attempts) for r in first_attempt(E.resolve_event_domain(jobs, accounts)).collect()}
    assert states == {"hubspot:1": ("ready", 1), "hubspot:2": ("pending", 1), "hubspot:3": ("ready", 1)}


def creation(i, at, obj):
    return event(i, "company.creation", None, None, at=at, obj=obj)


def test_three_tries_then_failed(spark, crm, tmp_path):
    """A job without a website is tried at once, 30 s and 60 s more later, then given up visibly."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    none = spark.createDataFrame([], "record_id string, domain string")
    for rows in ([creation(1, 0, 5)], [event(2, at=40)], [event(3, at=60)], [event(4, at=100)], [event(5, at=55 * 3600)]):
        jobs = E.crm_jobs(stream(spark, src, crm(*rows)))
        run_jobs(jobs, lambda: none, lambda t: t, out=out, checkpoint=ck).awaitTermination()
    got = sorted((r.attempts, r.status, r.run_after, r.last_error) for r in spark.read.parquet(f"{out}/attempts").where("key = 'hubspot:1'").collect())
    at = lambda s: (T0 + timedelta(seconds=s)).replace(tzinfo=None)
    assert [(a, s, t) for a, s, t, _ in got] == [(1, "pending", at(30)), (2, "pending", at(90)), (3, "failed", None)]
    assert got[0][3] == "record 5 has no website yet"


def test_attempts_that_fell_due_together(spark, crm, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    none = spark.createDataFrame([], "record_id string, domain string")
    for rows in ([creation(1, 0, 5)], [event(2, at=1000)]):
        run_jobs(E.crm_jobs(stream(spark, src, crm(*rows))), lambda: none, lambda t: t, out=out, checkpoint=ck).awaitTermination()
    got = sorted((r.attempts, r.status) for r in spark.read.parquet(f"{out}/attempts").where("key = 'hubspot:1'").collect())
    assert got == [(1, "pending"), (2, "pending"), (3, "failed")]


def test_a_wait_ends_with_a_later_event_or_a_record(spark, crm, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    found = [[], [], [("6", "six.com")]]
    batches = [[creation(1, 0, 5), creation(2, 0, 6)], [event(3, value="five.com", at=10, obj=5)], [event(4, at=35)]]
    for rows, known in zip(batches, found, strict=True):
        accounts = spark.createDataFrame(known, "record_id string, domain string")
        run_jobs(E.crm_jobs(stream(spark, src, crm(*rows))), lambda a=accounts: a, lambda t: t, out=out, checkpoint=ck).awaitTermination()
    got = sorted((r.key, r.attempts, r.status, r.domain) for r in spark.read.parquet(f"{out}/attempts").collect())
    assert got == [
        ("hubspot:1", 1, "pending", None), ("hubspot:1", 2, "ready", "five.com"), ("hubspot:2", 1, "pending", None),
        ("hubspot:2", 2, "ready", "six.com"), ("hubspot:3", 1, "ready", "five.com"), ("hubspot:4", 1, "ready", "acme.com"),
    ]
    targets = sorted((r.domain, r.batch) for r in spark.read.parquet(f"{out}/writes").collect())
    assert targets == [("acme.com", 2), ("five.com", 1), ("six.com", 2)]


def test_a_busy_record_is_spread(spark, crm, tmp_path):
    """One record with a third of the events lies in several files; rows are those of a plain join."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [creation(i, i, 7 if i % 3 == 0 else 100 + i) for i in range(1, 301)]
    accounts = spark.createDataFrame([("7", "seven.com"), ("101", "one.com")], "record_id string, domain string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run_resolve(E.crm_jobs(stream(spark, src, crm(*rows))), lambda: accounts, out=out, checkpoint=ck, rows_per_task=10).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = spark.read.parquet(f"{out}/resolved")
    assert {(r.record_id, r.domain) for r in got.collect()} == {
        (str(7 if i % 3 == 0 else 100 + i), {7: "seven.com", 101: "one.com"}.get(7 if i % 3 == 0 else 100 + i)) for i in range(1, 301)}
    assert got.count() == 300
    assert got.where("record_id = '7'").select(F.input_file_name()).distinct().count() > 1


def test_ready_jobs(spark):
    rows = [(3, "pending", T0), (1, "pending", T0 + timedelta(hours=1)), (2, "done", T0), (4, "pending", T0 - timedelta(hours=1))]
    df = spark.createDataFrame(rows, "id int, status string, run_after timestamp")
    assert [r.id for r in ready_jobs(df, T0).collect()] == [3, 4]
    assert [r.id for r in ready_jobs(df, T0, 1).collect()] == [3]


def test_events_to_planned_writes(spark, crm, tmp_path):
    """New records are created; a second event about them reuses the analysis and writes nothing."""
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = [("https://acme.com/", "https://acme.com/", 200, HOMEPAGE, NOW)]
    crawl = spark.createDataFrame(rows, "url string, final_url string, status_code int, html string, fetched_at timestamp")
    accounts = spark.createDataFrame([("99", "acme.com")], "record_id string, domain string")
    stored = {"existing": None}

    def write_plan(domains):
        results = enrich_pages(resolve_homepages(domains, crawl), Profile.default(), analyzed_at=NOW)
        payloads = build_payloads(results, Mapping.default(), "hubspot").where("error is null")
        existing = stored["existing"]
        if existing is None:
            existing = payloads.select(F.lit("").alias("record_id"), "properties.*").limit(0)
        plan = plan_writes(results, Mapping.default(), "hubspot", existing)
        kept = payloads.select(F.concat(F.lit("R"), "domain").alias("record_id"), "properties.*").collect()
        stored["next"] = spark.createDataFrame(kept, existing.schema) if kept else None
        return plan

    for batch in ([event(1), event(1, at=1), creation(2, 0, 99)], [creation(3, 2, 5), event(4, at=3)]):
        run_jobs(E.crm_jobs(stream(spark, src, crm(*batch))), lambda: accounts, write_plan, out=out, checkpoint=ck).awaitTermination()
        stored["existing"] = stored["next"] or stored["existing"]
    writes = sorted((w.batch, w.domain, w.action) for w in spark.read.parquet(f"{out}/writes").collect())
    assert writes == [(0, "acme.com", "created"), (1, "acme.com", "skipped")]
    states = {r.key: r.status for r in spark.read.parquet(f"{out}/jobs").collect()}
    assert states == {"hubspot:1": "done", "hubspot:2": "done", "hubspot:3": "pending", "hubspot:4": "done"}
