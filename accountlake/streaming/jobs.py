"""A stream of jobs, micro-batch by micro-batch, against tables in the shared folder.

What a stream has to remember is kept in tables that grow, or hold little. Accepted keys are appended to a log, one folder
per day of arrival; a batch reads the days that can still matter and writes its own keys only. Jobs that wait are a
table of their own, versioned by batch. Analyses are appended as they are made. Every folder is named after its batch, so
a batch that is run again after a failure reads what it read before and leaves the same files; days and versions
that no batch can ask for again are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from accountlake import vocab
from accountlake.config import Profile
from accountlake.functions.text import blank_to_null
from accountlake.operators.keys import ROWS_PER_TASK, lookup_join
from accountlake.plans.enrich import analyses_to_keep
from accountlake.spark import shared_dir
from accountlake.streaming.events import dedupe_batch, resolve_event_domain
from accountlake.streaming.retry import due_after, no_website

TICK = "tick"


def _write(df: DataFrame, folder: str, batch_id: int) -> DataFrame:
    """The batch's rows, as they were written: later steps take them, whatever is run again."""
    path = f"{folder}/batch={batch_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _version(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """The version the batch before this one wrote; none for the first batch."""
    return spark.read.parquet(f"{folder}/batch={batch_id - 1}") if batch_id else None


def _log(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """What the batches before this one appended; none where nothing was."""
    if not batch_id:
        return None
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.where(F.col("batch") < batch_id)


def _delete(spark: SparkSession, folder: str, old: Callable[[str], bool]) -> None:
    """Delete the subfolders whose name is ``old``; a folder that is gone already is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        for status in fs.listStatus(path):
            if status.isDirectory() and old(status.getPath().getName()):
                fs.delete(status.getPath(), True)


def _hours(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(n * 3600)))


# --- keys seen -------------------------------------------------------------


def new_jobs(arrived: DataFrame, seen: DataFrame | None, ttl_hours: float, time: str = "ingest_ts") -> DataFrame:
    """Deliveries that start a job: a key's first, then each that lies more than ``ttl_hours`` after the last one accepted.

    ``seen``: keys accepted before, and when. The result does not depend on how deliveries in order of time are cut
    into batches. A batch that spans several times ``ttl_hours`` takes a round for each: a key's earliest delivery is accepted, later
    ones within its time are dropped. Minima are combined before the shuffle, so a key with very many deliveries is no large group.
    """
    later = F.col("_last").isNull() | (F.col(time) > F.col("_last") + _hours(ttl_hours))

    def after(rows: DataFrame, accepted: DataFrame) -> DataFrame:
        last = accepted.groupBy("key").agg(F.max(time).alias("_last"))
        return lookup_join(rows, last, ["key"]).where(later).select(*arrived.columns)

    rest = arrived if seen is None else after(arrived, seen)
    span = arrived.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    if span["low"] is None or span["high"] - span["low"] <= timedelta(hours=ttl_hours):
        return dedupe_batch(rest, [time])
    spark = arrived.sparkSession
    found, folder, turn = None, shared_dir(spark, "rounds"), 0
    while True:
        first = _write(dedupe_batch(rest, [time]), f"{folder}/first", turn)
        if first.isEmpty():
            return found if found is not None else first
        found = first if found is None else found.unionByName(first)
        # Of a key that was accepted now, only what is later; other keys have nothing left.
        last = first.select("key", F.col(time).alias("_last"))
        rest = _write(lookup_join(rest, last, ["key"]).where(F.col(time) > F.col("_last") + _hours(ttl_hours)).select(*arrived.columns),
                      f"{folder}/rest", turn)
        turn += 1


def remembered(spark: SparkSession, folder: str, batch_id: int, since: datetime | None) -> DataFrame | None:
    """Keys accepted by the batches before, of the days from ``since`` on: other days are not read."""
    log = _log(spark, folder, batch_id)
    if log is None or since is None:
        return None
    # A day more: the driver's zone need not be the session's.
    return log.where(F.col("day") >= F.lit(since.date() - timedelta(days=1)))


def remember(accepted: DataFrame, folder: str, batch_id: int, time: str = "ingest_ts") -> None:
    """Append accepted keys to the folders of their days; a batch that is run again replaces its own files."""
    rows = accepted.select("key", time, F.to_date(time).alias("day"), F.lit(batch_id).alias("batch"))
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)


def forget(spark: SparkSession, folder: str, clock: datetime | None, ttl_hours: float) -> None:
    """Delete the days that lie ``ttl_hours`` and a day behind the clock."""
    if clock is not None:
        oldest = (clock - timedelta(hours=ttl_hours, days=1)).date().isoformat()
        _delete(spark, folder, lambda name: name.startswith("day=") and name[4:] < oldest)


def _bounds(arrived: DataFrame, time: str) -> tuple[datetime | None, datetime | None]:
    return tuple(arrived.agg(F.min(time), F.max(time)).first())


def _started(stream: DataFrame, process, checkpoint: str, available_now: bool) -> StreamingQuery:
    def held(batch: DataFrame, batch_id: int) -> None:
        """The source is read once for all steps; what lost executors held is read again."""
        batch.persist()
        try:
            process(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(held).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_dedupe(
    jobs: DataFrame, *, out: str, checkpoint: str, time: str = "ingest_ts", ttl_hours: float = vocab.SEEN_TTL_HOURS,
    available_now: bool = True,
) -> StreamingQuery:
    """The deliveries that start a job, in ``out/new``; keys are forgotten after ``ttl_hours``, their days deleted later."""
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        low, high = _bounds(batch, time)
        since = None if low is None else low - timedelta(hours=ttl_hours)
        seen = remembered(spark, f"{out}/seen", batch_id, since)
        fresh = _write(new_jobs(batch, seen, ttl_hours, time), f"{out}/new", batch_id)
        remember(fresh, f"{out}/seen", batch_id, time)
        forget(spark, f"{out}/seen", high, ttl_hours)

    return _started(jobs, process, checkpoint, available_now)


def run_resolve(
    jobs: DataFrame, accounts: Callable[[], DataFrame], *, out: str, checkpoint: str, rows_per_task: int = ROWS_PER_TASK,
    available_now: bool = True,
) -> StreamingQuery:
    """Jobs with the domains their records are known by, in ``out/resolved``; the busiest records of a batch are spread over tasks.

    A plain join of a stream to a table puts all events of one record into one task; here each batch finds its own busy ones.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        _write(resolve_event_domain(batch, accounts(), rows_per_task=rows_per_task), f"{out}/resolved", batch_id)

    return _started(jobs, process, checkpoint, available_now)


# --- jobs that wait --------------------------------------------------------


def with_ticks(jobs: DataFrame, ticks: DataFrame, time: str = "ingest_ts") -> DataFrame:
    """A stream of jobs that also gets a row whenever time has passed, so that waiting jobs are tried although nothing arrives.

    ``ticks`` is a stream with a ``timestamp``, as the ``rate`` source gives.
    """
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in jobs.schema if f.name not in (time, "event")]
    rows = ticks.select(*empty, F.col("timestamp").alias(time), F.lit(TICK).alias("event"))
    return jobs.unionByName(rows.select(*jobs.columns))


def tried(
    arrived: DataFrame, waiting: DataFrame | None, accounts: DataFrame, clock: datetime, seen: DataFrame | None = None, *,
    retry_seconds: int = vocab.RETRY_SECONDS, max_attempts: int = vocab.MAX_ATTEMPTS, ttl_hours: float = vocab.SEEN_TTL_HOURS,
    **join,
) -> DataFrame:
    """Jobs that are tried in a micro-batch, with all their attempts up to ``clock``.

    These are new jobs (of keys not in ``seen``), waiting ones whose next attempt is due, and waiting ones whose record got a
    website by an event of this batch. A website comes from the job, from such an event, or from ``accounts``, looked up anew.
    A job without one fails at its last attempt; else it waits until ``run_after``.
    """
    fresh = new_jobs(arrived, seen, ttl_hours).select(
        "key", "system", "record_id", "domain", "event", "ingest_ts", F.lit(0).alias("attempts"))
    named = arrived.select("record_id", blank_to_null("domain").alias("_named"), F.struct("ingest_ts", "key").alias("_at")).where(
        "_named is not null and record_id is not null"
    ).groupBy("record_id").agg(F.max_by("_named", "_at").alias("_named"))
    ahead = fresh
    if waiting is not None:
        due = lookup_join(waiting, named, ["record_id"], **join).where(
            (F.col("run_after") <= F.lit(clock)) | F.col("_named").isNotNull())
        ahead = fresh.unionByName(due.select(*fresh.columns))
    ahead = lookup_join(ahead, named, ["record_id"], **join).withColumn("domain", F.coalesce(blank_to_null("domain"), "_named")).drop("_named")
    looked_up = resolve_event_domain(ahead.select(*fresh.columns), accounts, **join)
    # Attempt n + 1 follows n * retry_seconds after attempt n; several may be due by now.
    passed = sum(
        (F.when(due_after("ingest_ts", n, retry_seconds) <= F.lit(clock), 1).otherwise(0) for n in range(1, max_attempts)), F.lit(1))
    last = F.when(F.col("domain").isNotNull(), F.col("attempts") + 1).otherwise(F.greatest(passed, F.col("attempts") + 1))
    return looked_up.withColumns({"first": F.col("attempts") + 1, "attempts": last}).withColumns({
        "status": F.when(F.col("domain").isNotNull(), "ready").when(F.col("attempts") >= max_attempts, "failed").otherwise("pending"),
    }).withColumns({
        "run_after": F.when(F.col("status") == "pending", _due("ingest_ts", F.col("attempts"), retry_seconds)),
        "last_error": F.when(F.col("domain").isNull(), no_website("record_id")),
    })


def _due(time: str, attempts: Column, retry_seconds: int) -> Column:
    seconds = attempts * (attempts + 1) / 2 * retry_seconds
    return F.col(time) + F.make_dt_interval(secs=seconds)


def attempts_of(rows: DataFrame, retry_seconds: int = vocab.RETRY_SECONDS) -> DataFrame:
    """One row per attempt of :func:`tried` rows, with the state the job was in after it."""
    each = rows.withColumn("attempt", F.explode(F.sequence("first", "attempts")))
    final = F.col("attempt") == F.col("attempts")
    return each.select(
        "key", "system", "record_id", "domain", "event", F.col("attempt").alias("attempts"),
        F.when(final, F.col("status")).otherwise("pending").alias("status"),
        F.when(final, F.col("run_after")).otherwise(_due("ingest_ts", F.col("attempt"), retry_seconds)).alias("run_after"), "last_error",
    )


def run_jobs(
    jobs: DataFrame,
    accounts: Callable[[], DataFrame],
    write_plan: Callable[[DataFrame], DataFrame],
    *,
    out: str,
    checkpoint: str,
    enrich: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None,
    profile: Profile | None = None,
    retry_seconds: int = vocab.RETRY_SECONDS,
    max_attempts: int = vocab.MAX_ATTEMPTS,
    ttl_hours: float = vocab.SEEN_TTL_HOURS,
    rows_per_task: int = ROWS_PER_TASK,
    available_now: bool = True,
) -> StreamingQuery:
    """Redeliveries dropped, websites looked up and waited for, what is ready enriched and its writes planned.

    ``accounts`` is read anew for every batch. ``enrich`` gets ``domain, ord`` and the analyses kept so far, and returns results,
    whose fresh analyses are kept for later batches (of ``profile``); ``write_plan`` gets the results and returns write rows. Without
    ``enrich`` it gets ``domain, ord``.

    Folders under ``out``: ``attempts`` (every attempt), ``jobs`` (state of the jobs tried), ``waiting`` (those that wait, the
    batch's version), ``seen`` (keys, by day), ``analyses``, ``results``, ``writes``.
    """
    if enrich is not None and profile is None:
        raise ValueError("analyses are kept by profile: enrich needs one")

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = _bounds(batch, "ingest_ts")[1]
        arrived = batch.where(F.coalesce(F.col("event") != TICK, F.lit(True)))
        low = _bounds(arrived, "ingest_ts")[0]
        waiting = _version(spark, f"{out}/waiting", batch_id)
        if waiting is not None:  # time never goes back
            clock = max((t for t in (clock, waiting.agg(F.max("ingest_ts")).first()[0]) if t is not None), default=None)
        since = None if low is None else low - timedelta(hours=ttl_hours)
        seen = remembered(spark, f"{out}/seen", batch_id, since)
        rows = tried(arrived, waiting, accounts(), clock or datetime(1970, 1, 1), seen, retry_seconds=retry_seconds,
                     max_attempts=max_attempts, ttl_hours=ttl_hours, rows_per_task=rows_per_task)
        rows = _write(rows, f"{out}/tried", batch_id)
        _write(attempts_of(rows, retry_seconds), f"{out}/attempts", batch_id)
        targets = rows.where("status = 'ready'").groupBy("domain").agg(F.min(F.unix_micros("ingest_ts")).alias("ord"))
        if enrich is not None:
            results = _write(enrich(targets, _log(spark, f"{out}/analyses", batch_id)), f"{out}/results", batch_id)
            _write(analyses_to_keep(results, profile), f"{out}/analyses", batch_id)
            targets = results
        _write(write_plan(targets), f"{out}/writes", batch_id)
        state = rows.drop("first")
        _write(state.withColumn("status", F.when(F.col("status") == "ready", "done").otherwise(F.col("status"))), f"{out}/jobs", batch_id)
        left = state.where("status = 'pending'")
        if waiting is not None:
            left = left.unionByName(waiting.join(rows.select("key", "ingest_ts"), ["key", "ingest_ts"], "left_anti").select(*state.columns))
        _write(left, f"{out}/waiting", batch_id)
        remember(rows.where("first = 1"), f"{out}/seen", batch_id)
        # The version before is what this batch would read again; older ones are nobody's.
        _delete(spark, f"{out}/waiting", lambda name: name.startswith("batch=") and int(name[6:]) < batch_id - 1)
        forget(spark, f"{out}/seen", clock, ttl_hours)

    return _started(jobs, process, checkpoint, available_now)
