"""Domains, candidate URLs, link resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountlake.functions import urls as U
from accountlake.operators.pages import targets
from suite.registry import query, table
from suite.sqltext import domain, host


def _variants(spark, sf):
    """Page URLs the way people type them."""
    bare = F.regexp_replace("url", "^https?://", "")
    site = F.regexp_extract("url", "^https?://([^/]*)", 1)
    return table(spark, sf, "pages").select(
        "page_id",
        F.posexplode(F.array(
            F.col("url"),
            F.concat(F.lit("  HTTPS://"), F.upper(bare), F.lit(" ")),
            bare,
            F.concat(F.lit("me@"), site, F.lit(":8080/x")),
            F.regexp_replace("url", r"^https?://.*$", ""),
            F.concat(F.lit("page "), F.col("page_id").cast("string")),
        )).alias("variant", "raw"),
    )


@query("normalise_domain", f"""
WITH v AS (
  SELECT page_id, unnest([0, 1, 2, 3, 4, 5]) AS variant, url, {host('url')} AS host, {domain('url')} AS d FROM pages)
SELECT page_id, variant::BIGINT AS variant,
       CASE WHEN variant < 4 THEN d END AS domain,
       CASE WHEN variant = 4 THEN 'Empty domain.'
            WHEN variant = 5 THEN 'Not a domain: ''page ' || page_id || '''' END AS error
FROM v""")
def normalise_domain(spark, sf):
    return _variants(spark, sf).select(
        "page_id", F.col("variant").cast("long").alias("variant"),
        U.domain_of("raw").alias("domain"), U.domain_error("raw").alias("error"),
    )


@query("candidate_urls", f"""
SELECT page_id, 'https://' || {domain('url')} || '/' AS first_try,
       'https://www.' || {domain('url')} || '/' AS second_try FROM pages""")
def candidate_urls(spark, sf):
    tries = table(spark, sf, "pages").select("page_id", U.candidate_urls(U.domain_of("url")).alias("c"))
    return tries.select("page_id", F.col("c")[0].alias("first_try"), F.col("c")[1].alias("second_try"))


@query("first_per_domain", f"""
SELECT {domain('url')} AS domain, min(page_id) AS ord FROM pages GROUP BY 1""")
def first_per_domain(spark, sf):
    accounts = table(spark, sf, "pages").select(F.col("url").alias("domain"), F.col("page_id").alias("ord"))
    return targets(accounts)[0]


@query("unusable_inputs", f"""
SELECT 'page ' || page_id AS domain, page_id AS ord, 'Not a domain: ''page ' || page_id || '''' AS error FROM pages
UNION ALL SELECT '', page_id, 'Empty domain.' FROM pages""")
def unusable_inputs(spark, sf):
    raw = _variants(spark, sf).select(F.col("raw").alias("domain"), F.col("page_id").alias("ord"))
    return targets(raw)[1]


HREFS = ("/x", "x.html", "../up", "?q=1", "//cdn.example.com/a.js", "https://o.example/z?a#b", "./s/./a/../b", "/p/../q#f")


@query("absolute_url", """
WITH b AS (
  SELECT page_id, url, regexp_extract(url, '^(https?://[^/]*)', 1) AS root, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) AS path,
         unnest(['/x','x.html','../up','?q=1','//cdn.example.com/a.js','https://o.example/z?a#b','./s/./a/../b','/p/../q#f']) AS href
  FROM pages),
d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS dir FROM b)
SELECT page_id, href, CASE href
  WHEN '/x' THEN root || '/x' WHEN 'x.html' THEN root || dir || 'x.html'
  WHEN '../up' THEN root || regexp_replace(dir, '[^/]+/$', '') || 'up'
  WHEN '?q=1' THEN root || path || '?q=1' WHEN '//cdn.example.com/a.js' THEN regexp_extract(url, '^[a-z]+:', 0) || '//cdn.example.com/a.js'
  WHEN 'https://o.example/z?a#b' THEN href WHEN './s/./a/../b' THEN root || dir || 's/b'
  ELSE root || '/q#f' END AS resolved FROM d""")
def absolute_url(spark, sf):
    hrefs = F.explode(F.array(*map(F.lit, HREFS))).alias("href")
    return table(spark, sf, "pages").select("page_id", "url", hrefs).select(
        "page_id", "href", U.absolute_url("url", F.col("href")).alias("resolved")
    )
