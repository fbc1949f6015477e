"""Not-modified revisits resolved: each one to the latest earlier full response of its address.

Records are sorted by canonical address and time over ranges, so an address with very many records spreads
over many tasks. Inside a range a window carries the last full response on; what the first rows of
a range lack comes from the ranges before, one small row per address and range. Bodies take no part:
a resolved row names the response it stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountlake.llm.common import pick, saved

# Fixed: headers of a not-modified response that replace those of the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")
# Fixed: query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)"

RESOLVED, CHANGED, NO_RESPONSE, UNCHECKED, NO_ADDRESS = "resolved", "changed", "no response", "unchecked", "no address"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, default port, fragment, tracking parameters and last slash.

    The host is lower-cased, the parameters that are left are sorted. Null for a null or blank address.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    front = F.split_part(plain, F.lit("?"), F.lit(1))
    host = F.regexp_replace(F.lower(F.regexp_extract(front, r"^[^/]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(front, r"^[^/]*(.*)$", 1), r"/+$", "")
    rest = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(rest, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.length(host) > 0, F.concat(host, path, tail))


def lowered(headers: Column) -> Column:
    """A header map under lower-case names; of names that fall together the last by code point counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]))


def merged(stored: Column, fresh: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The stored headers with those of the revisit that may replace them. Both maps have lower-case names."""
    allowed = F.map_filter(fresh, lambda k, _: k.isin(*permitted))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per revisit of ``records`` (``record_id, url, ts, is_full, headers``).

    ``full_id`` is the latest full response of the same canonical address with a smaller ``ts`` (of equal times the
    larger id). Its entity tags, compared weakly, must agree where both have one; else the
    modification times must; where neither can be compared the outcome is ``unchecked``. ``headers`` are merged for
    ``resolved`` and ``unchecked`` rows, the revisit's own otherwise. Rows without address or time have no response; null
    headers are empty; repeated revisits give repeated rows; an empty table gives none.
    """
    rows = pick(records, "record_id", "url", "ts", "is_full", "headers").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts",
        F.coalesce(F.col("is_full"), F.lit(False)).alias("is_full"), lowered(F.col("headers")).alias("headers"),
    )
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    # A response counts for later revisits only, so at equal times revisits come first.
    order = ["ts", "is_full", "record_id"]
    dealt = saved(
        rows.where(known).repartitionByRange("url_key", *order).withColumn("range", F.spark_partition_id()), "records")
    full = F.when(F.col("is_full"), F.struct("record_id", "headers"))
    inside = Window.partitionBy("range", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = dealt.withColumn("inside", F.last(full, ignorenulls=True).over(inside)).where("not is_full")
    # What each range hands on, for the addresses that go over a seam.
    ends = dealt.groupBy("url_key", "range").agg(
        F.max_by(F.when(F.col("is_full"), F.struct("record_id", "headers")),
                 F.when(F.col("is_full"), F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where(
        "carried is not null").select("url_key", "range", "carried")
    found = here.join(carried, ["url_key", "range"], "left").select(
        "record_id", "url_key", "ts", "headers", F.coalesce("inside", "carried").alias("full"))
    nowhere = rows.where(~known & ~F.col("is_full")).select(
        "record_id", "url_key", "ts", "headers", F.lit(None).cast(found.schema["full"].dataType).alias("full"))
    fresh, stored = F.col("headers"), F.col("full.headers")
    tags = _weak(fresh["etag"]), _weak(stored["etag"])
    times = F.trim(fresh["last-modified"]), F.trim(stored["last-modified"])
    outcome = (
        F.when(~known, NO_ADDRESS).when(F.col("full").isNull(), NO_RESPONSE)
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], RESOLVED).otherwise(CHANGED))
        .when(times[0].isNotNull() & times[1].isNotNull(), F.when(times[0] == times[1], RESOLVED).otherwise(CHANGED))
        .otherwise(UNCHECKED)
    )
    done = found.unionByName(nowhere).withColumn("outcome", outcome)
    stands = F.col("outcome").isin(RESOLVED, UNCHECKED)
    return done.select(
        "record_id", "url_key", "ts", "outcome", F.col("full.record_id").alias("full_id"),
        F.when(stands, merged(stored, fresh, permitted)).otherwise(fresh).alias("headers"),
    )


def capture_log(pages: DataFrame) -> DataFrame:
    """Records of a crawl of ``pages``: each page's full response, and a later visit that was answered as not modified.

    Times follow from the page's number and a hash of its text, so that a visit may fall before the first
    response, or behind a newer one of the same address. Some servers send entity tags, some times, some nothing.
    """
    rows = pick(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    digest = F.md5(F.col("html").cast("binary"))
    kind = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % 10
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    at = F.col("page_id") * 1000
    wait = F.when(kind == 0, -500).otherwise(F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % 50_000_000 + 1)
    day = (F.col("page_id") % 365).cast("string")
    rows = rows.select("page_id", "url", kind.alias("kind"), tag.alias("tag"), at.alias("at"), (at + wait).alias("again"),
                       day.alias("day"), F.octet_length("html").cast("string").alias("length"))

    def headers(**items):
        flat = [x for k, v in items.items() for x in (F.lit(k.replace("_", "-")), v)]
        return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())

    etag = F.when(F.col("kind") < 6, F.col("tag"))
    time = F.when(F.col("kind") < 8, F.col("day"))
    first = rows.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit(True).alias("is_full"),
        headers(ETag=etag, Last_Modified=time, Content_Type=F.lit("text/html"), Content_Length=F.col("length"),
                Date=F.col("at").cast("string"), Cache_Control=F.lit("max-age=60")).alias("headers"))
    second = rows.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.col("again").alias("ts"), F.lit(False).alias("is_full"),
        headers(etag=F.when(etag.isNotNull(), F.concat(F.lit("W/"), etag)), last_modified=time, content_length=F.lit("0"),
                date=F.col("again").cast("string"), expires=F.lit("0")).alias("headers"))
    return first.unionByName(second)


def report(resolved: DataFrame) -> DataFrame:
    """Resolved revisits with their headers as one sorted text."""
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return resolved.select(
        "record_id", "url_key", "ts", "outcome", "full_id", F.array_join(entries, ";").alias("headers"))


REPORT_SQL = r"""
WITH r AS (
    SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS html,
        regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain
    FROM pages
), k AS (
    SELECT *, regexp_replace(lower(regexp_extract(split_part(plain, '?', 1), '^[^/]*')), '^www\.|:(80|443)$', '', 'g') AS host,
        regexp_replace(regexp_extract(split_part(plain, '?', 1), '^[^/]*(.*)$', 1), '/+$', '') AS path,
        list_sort(list_filter(string_split(regexp_extract(plain, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT
            regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)'))) AS params
    FROM r
), h AS (
    SELECT page_id, html, CASE WHEN host <> '' THEN
            host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url_key,
        ('0x' || substr(md5(u), 1, 7))::BIGINT % 10 AS kind, md5(html) AS digest
    FROM k
), c AS (
    SELECT page_id, url_key, kind, octet_length(encode(html)) AS length, page_id * 1000 AS at,
        page_id * 1000 + CASE WHEN kind = 0 THEN -500 ELSE ('0x' || substr(digest, 1, 7))::BIGINT % 50000000 + 1 END AS again,
        CASE WHEN kind < 6 THEN '"' || digest || '"' END AS tag, CASE WHEN kind < 8 THEN (page_id % 365)::VARCHAR END AS day
    FROM h
), f AS (
    SELECT v.page_id, v.url_key, v.again, v.tag, v.day, max(p.page_id) AS full_page
    FROM c v LEFT JOIN c p ON p.url_key = v.url_key AND p.at < v.again
    GROUP BY ALL
), o AS (
    SELECT f.*, p.tag AS full_tag, p.day AS full_day, p.at, p.length, CASE WHEN f.url_key IS NULL THEN 'no address'
        WHEN full_page IS NULL THEN 'no response'
        WHEN f.tag IS NOT NULL AND p.tag IS NOT NULL THEN CASE WHEN f.tag = p.tag THEN 'resolved' ELSE 'changed' END
        WHEN f.day IS NOT NULL AND p.day IS NOT NULL THEN CASE WHEN f.day = p.day THEN 'resolved' ELSE 'changed' END
        ELSE 'unchecked' END AS outcome
    FROM f LEFT JOIN c p ON p.page_id = f.full_page
)
SELECT page_id * 2 + 1 AS record_id, url_key, again AS ts, outcome, full_page * 2 AS full_id,
    array_to_string(list_filter(CASE WHEN outcome IN ('resolved', 'unchecked') THEN [
        'cache-control=max-age=60', 'content-length=' || length, 'content-type=text/html', 'date=' || again,
        'etag=' || coalesce('W/' || tag, full_tag), 'expires=0', 'last-modified=' || coalesce(day, full_day)]
    ELSE ['content-length=0', 'date=' || again, 'etag=W/' || tag, 'expires=0', 'last-modified=' || day] END,
        lambda x: x IS NOT NULL), ';') AS headers
FROM o
"""
