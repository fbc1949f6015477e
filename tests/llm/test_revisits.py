from __future__ import annotations

import random

from pyspark.sql import functions as F

from accountlake.llm import revisits as rv

RECORDS = "record_id long, url string, ts long, is_full boolean, headers map<string,string>, outcome string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], RECORDS)


def test_canonical_url(spark):
    pairs = [
        ("HTTP://www.Example.org:80/a/?utm_source=x&b=2&a=1#top", "example.org/a?a=1&b=2"), ("https://example.org", "example.org"),
        ("example.org/A//", "example.org/A"), ("https://example.org/?ref=1", "example.org"), ("", None), (None, None), ("#x", None),
    ]
    df = spark.createDataFrame([(a,) for a, _ in pairs], "u string").select(rv.canonical_url(F.col("u")).alias("k"))
    assert [r.k for r in df.collect()] == [k for _, k in pairs]


def walk(rows):
    """Every revisit against every response."""
    out = {}
    key = {u: k for u, k in [("http://a.org/", "a.org"), ("https://www.a.org", "a.org"), ("http://b.org/x", "b.org/x"), (None, None)]}
    for rid, url, ts, full, headers in rows:
        if full:
            continue
        before = [r for r in rows if r[3] and key[r[1]] and key[r[1]] == key[url] and ts is not None and r[2] is not None and r[2] < ts]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        fresh = headers or {}
        if key[url] is None or ts is None:
            outcome = rv.NO_ADDRESS
        elif best is None:
            outcome = rv.NO_RESPONSE
        else:
            stored = best[4] or {}
            outcome = rv.UNCHECKED
            for name in ("last-modified", "etag"):
                if name in fresh and name in stored:
                    outcome = rv.RESOLVED if fresh[name].removeprefix("W/") == stored[name].removeprefix("W/") else rv.CHANGED
        merged = dict(fresh)
        if outcome in (rv.RESOLVED, rv.UNCHECKED):
            merged = dict(best[4] or {}) | {k: v for k, v in fresh.items() if k in rv.PERMITTED}
        out[rid] = (outcome, best and best[0], merged)
    return out


def test_against_all_earlier_responses(spark):
    rnd = random.Random(1)
    urls = ["http://a.org/"] * 6 + ["https://www.a.org", "http://b.org/x", None]
    rows = []
    for i in range(300):
        headers = {}
        if rnd.random() < 0.7:
            headers["etag"] = rnd.choice(["", "W/"]) + rnd.choice(["p", "q"])
        if rnd.random() < 0.5:
            headers["last-modified"] = rnd.choice(["1", "2"])
        if rnd.random() < 0.5:
            headers |= {"expires": str(i), "content-length": str(i)}
        ts = None if rnd.random() < 0.05 else rnd.randint(0, 80)
        rows.append((i, rnd.choice(urls), ts, rnd.random() < 0.4, headers if rnd.random() < 0.9 else None))
    got = rv.resolve_revisits(records(spark, rows).repartition(5)).collect()
    want = walk(rows)
    assert len(got) == len(want)
    for r in got:
        assert (r.outcome, r.full_id, r.headers) == want[r.record_id], r


def test_names_of_headers_fall_together(spark):
    rows = [(1, "a.org", 1, True, {"ETag": "x", "etag": "y", "Server": "s"}), (2, "a.org", 2, False, {"ETAG": "y", "Server": "t"})]
    got = rv.resolve_revisits(records(spark, rows)).first()
    assert got.outcome == rv.RESOLVED and got.headers == {"etag": "y", "server": "s"}


def test_repeated_and_no_rows(spark):
    rows = [(1, "a.org", 1, True, {}), (2, "a.org", 2, False, None), (2, "a.org", 2, False, None), (3, "a.org", 1, False, {})]
    got = sorted((r.record_id, r.outcome) for r in rv.resolve_revisits(records(spark, rows)).collect())
    assert got == [(2, rv.UNCHECKED), (2, rv.UNCHECKED), (3, rv.NO_RESPONSE)]
    assert rv.resolve_revisits(records(spark, rows).limit(0)).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, "a.org", None)], "page_id long, url string, html string")
    assert rv.report(rv.resolve_revisits(rv.capture_log(pages))).count() == 2
