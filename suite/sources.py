"""Files in, files out. What is written is read back and compared with what went in."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from accountlake.config import Mapping
from accountlake.functions.text import content_hash
from accountlake.operators.payload import field_catalogue
from accountlake.operators.reuse import latest_pages, watermarks
from accountlake.operators.upsert import upsert_plan
from accountlake.sources import sinks
from accountlake.sources.accounts import read_account_file
from accountlake.sources.envelopes import normalise_envelopes
from accountlake.spark import shared_dir
from accountlake.vocab import VENDOR_SIGNATURES
from suite.pages import rendered
from suite.registry import query, table
from suite.scoring import (
    ANALYSED_SQL, AREAS, B2B, B2C, BIG, CART, GOOD, NOTES, SERVICES, SIGNALS, SMALL, _audience, _score_sql, _segment, found, hits,
)
from suite.sqltext import TEXT, decode, host, squash, strip
from suite.writes import UPSERT_SQL, _RESULTS_SQL, existing, proposals, results
from accountlake.operators.payload import build_payloads


@query("read_account_csv", f"""WITH sites AS (SELECT {host('url')} AS domain, page_id, page_id % 3 AS part FROM pages)
SELECT domain, row_number() OVER (ORDER BY part, page_id) - 1 AS ord FROM sites""")
def read_account_csv(spark, sf):
    """A folder of CSV files with a Website column behind quoted names; rows count in file order."""
    path = shared_dir(spark, "accounts") + ".csv"
    site = F.lower(F.regexp_extract("url", "^https?://([^/]*)", 1))
    name = F.concat(F.lit('"Big", '), F.col("page_id").cast("string"), F.lit(" Inc"))
    empty = table(spark, sf, "nation").select(F.lit(1).alias("part"), F.lit(-1).cast("long").alias("page_id"), F.col("n_name").alias("name"), F.lit("").alias(" Website"))
    rows = table(spark, sf, "pages").select((F.col("page_id") % 3).cast("int").alias("part"), "page_id", name.alias("name"), F.concat(F.lit(" "), site).alias(" Website"))
    rows = rows.unionByName(empty).repartitionByRange(3, "part").sortWithinPartitions("part", "page_id")
    rows.select("name", " Website", F.lit("y").alias("owner")).write.option("escape", '"').csv(path, header=True)
    return read_account_file(spark, path).select("domain", "ord")


@query("read_account_csv_bare", f"SELECT {host('url')} AS domain, count(*) AS n FROM pages GROUP BY 1")
def read_account_csv_bare(spark, sf):
    """A CSV without a header."""
    path = shared_dir(spark, "bare") + ".csv"
    site = F.lower(F.regexp_extract("url", "^https?://([^/]*)", 1))
    table(spark, sf, "pages").select(site, "page_id").write.csv(path, header=False)
    return read_account_file(spark, path).groupBy("domain").agg(F.count("*").alias("n"))


@query("read_account_list", "SELECT 'c' || c_custkey || '.example' AS domain FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def read_account_list(spark, sf):
    """One domain per line, with comments and blank lines in between."""
    path = shared_dir(spark, "list") + ".txt"
    line = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example"))
    table(spark, sf, "customer").select(
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("# "), line)).when(F.col("c_mktsegment") == "MACHINERY", "   ").otherwise(F.concat(F.lit("  "), line))
    ).write.text(path)
    return read_account_file(spark, path).select("domain")


# --- envelopes -------------------------------------------------------------


def _envelope_columns(df):
    return df.select(
        "page_id", "final_url", F.col("status_code").cast("long").alias("status_code"), "title", "description",
        content_hash("html").alias("html_hash"), "markdown", "fetch_error",
    )


def dump(spark, sf, body):
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("asked"), body.alias("body"))


@query("envelope_nested", """
SELECT page_id, CASE WHEN contains(url, '#top') THEN url ELSE url || '&to' END AS final_url, CASE WHEN contains(url, 'www.') THEN 404::BIGINT ELSE 200::BIGINT END AS status_code,
  CASE WHEN contains(url, 'blog.') THEN 'first' ELSE 'T ' || page_id END AS title, CASE WHEN contains(url, 'blog.') THEN 'D' END AS description,
  CASE WHEN NOT contains(url, '.net/') THEN substr(sha256(CASE WHEN contains(url, '.org/') THEN '<p>clean</p>' ELSE html END), 1, 16) END AS html_hash,
  CASE WHEN contains(url, '.net/') AND NOT ends_with(url, '/') THEN '# md' END AS markdown,
  CASE WHEN contains(url, '?page') THEN url || ': firecrawl reported failure' WHEN contains(url, '.net/') AND ends_with(url, '/') THEN url || ': firecrawl returned no content' END AS fetch_error FROM pages""")
def envelope_nested(spark, sf):
    u = F.col("url")
    title = F.when(u.contains("blog."), F.lit('["first","second"]')).otherwise(F.concat(F.lit('"T '), F.col("page_id").cast("string"), F.lit('"')))
    html = F.regexp_replace(F.to_json(F.struct(F.col("html").alias("h"))), r'^\{"h":|\}$', "")
    body = F.concat(
        F.lit('{"success":'), F.when(u.contains("?page"), "false").otherwise("true"), F.lit(',"data":{"metadata":{"title":'), title,
        F.when(u.contains("blog."), ',"description":["D"]').otherwise(""), F.when(u.contains("www."), ',"statusCode":404').otherwise(""),
        F.lit(',"sourceURL":"'), u, F.lit('"'), F.when(~u.contains("#top"), F.concat(F.lit(',"url":"'), u, F.lit('&to"'))).otherwise(""), F.lit("}"),
        F.when(u.contains(".net/"), F.when(u.endswith("/"), "").otherwise(',"markdown":"# md"'))
        .when(u.contains(".org/"), ',"rawHtml":"","html":"<p>clean</p>"').otherwise(F.concat(F.lit(',"html":"<p>clean</p>","rawHtml":'), html)),
        F.lit("}}"),
    )
    return _envelope_columns(normalise_envelopes(dump(spark, sf, body), "firecrawl", url="asked"))


@query("envelope_results", """
SELECT page_id, CASE WHEN contains(url, '#top') THEN url ELSE 'https://r.example/' || page_id END AS final_url, CASE WHEN contains(url, 'www.') THEN 503::BIGINT ELSE 200::BIGINT END AS status_code,
  'T' AS title, NULL AS description, CASE WHEN contains(url, '.com/') THEN substr(sha256('<b>raw</b>'), 1, 16) END AS html_hash,
  CASE WHEN contains(url, '.net/') THEN 'plain ' || page_id WHEN contains(url, '.org/') THEN 'raw md' END AS markdown, CASE WHEN ends_with(url, '/') THEN url || ': crawl4ai reported failure' END AS fetch_error FROM pages""")
def envelope_results(spark, sf):
    """Three wrappers, told from the URL: a results list, a bare list, a bare object."""
    u = F.col("url")
    result = F.concat(
        F.lit('{"success":'), F.when(u.endswith("/"), "false").otherwise("true"), F.when(u.contains("www."), ',"status_code":503').otherwise(""),
        F.when(~u.contains("#top"), F.concat(F.lit(',"url":"https://r.example/'), F.col("page_id").cast("string"), F.lit('"'))).otherwise(""),
        F.when(u.contains(".net/"), F.concat(F.lit(',"markdown":"plain '), F.col("page_id").cast("string"), F.lit('"')))
        .when(u.contains(".org/"), ',"markdown":{"raw_markdown":"raw md","fit_markdown":"fit"}').otherwise(',"raw_html":"<b>raw</b>","cleaned_html":"x"'),
        F.lit(',"metadata":{"title":"T"}}'),
    )
    body = F.when(u.contains("/fr/"), F.concat(F.lit('{"success":true,"results":['), result, F.lit("]}"))).when(u.contains("/de/"), F.concat(F.lit("["), result, F.lit("]"))).otherwise(result)
    return _envelope_columns(normalise_envelopes(dump(spark, sf, body), "crawl4ai", url="asked"))


@query("envelope_items", """
SELECT page_id, CASE WHEN contains(url, '.org/') OR contains(url, '#top') THEN url ELSE 'https://l.example/' END AS final_url, 200::BIGINT AS status_code,
  CASE WHEN contains(url, '.org/') THEN NULL WHEN contains(url, 'www.') THEN 'Outer' ELSE 'Inner' END AS title,
  NULL AS description, CASE WHEN contains(url, '.com/') THEN substr(sha256('<i>b</i>'), 1, 16) END AS html_hash, CASE WHEN contains(url, '.net/') THEN 'text' END AS markdown,
  CASE WHEN contains(url, '.org/') THEN url || ': apify not JSON' END AS fetch_error FROM pages""")
def envelope_items(spark, sf):
    """Items with outer and inner fields; a body that is not JSON names neither a page nor a title."""
    u = F.col("url")
    item = F.concat(
        F.lit('[{"url":"'), u, F.lit('"'), F.when(~u.contains("#top"), ',"loadedUrl":"https://l.example/"').otherwise(""),
        F.when(u.contains("www."), ',"title":"Outer"').otherwise(""), F.when(u.contains(".net/"), ',"text":"text"').otherwise(',"body":"<i>b</i>"'),
        F.lit(',"metadata":{"title":"Inner"}}]'),
    )
    broken = F.concat(F.lit('{"url":'), u)
    return _envelope_columns(normalise_envelopes(dump(spark, sf, F.when(u.contains(".org/"), broken).otherwise(item)), "apify", url="asked"))


# --- sinks -----------------------------------------------------------------


@query("payloads_json", _RESULTS_SQL + " SELECT rdomain AS domain, 'companies' AS object_type, company AS name, score::BIGINT AS score, confidence::DOUBLE AS confidence, industries FROM results WHERE NOT failed")
def payloads_json(spark, sf):
    path = shared_dir(spark, "payloads")
    payloads = build_payloads(results(spark, sf), Mapping.default(), "hubspot")
    sinks.write_payloads_json(payloads, path)
    back = spark.read.schema(payloads.drop("error").schema).json(path)
    p = F.col("properties")
    return back.select(
        "domain", "object_type", p["name"].alias("name"), p["gtm_icp_fit_score"].cast("long").alias("score"),
        p["gtm_enrichment_confidence"].alias("confidence"), p["gtm_industries_served"].alias("industries"),
    )


@query("payloads_csv", UPSERT_SQL + " SELECT domain, c_name AS name, c_acctbal AS balance, CASE WHEN c_nationkey <> 5 THEN c_mktsegment END AS segment FROM f WHERE NOT failed")
def payloads_csv(spark, sf):
    path = shared_dir(spark, "flat")
    sinks.write_payloads_flat(proposals(spark, sf), path)
    schema = "domain string, name string, balance double, nation int, active boolean, segment string"
    return spark.read.schema(schema).csv(path, header=True, escape='"').select("domain", "name", "balance", "segment")


@query("results_json", UPSERT_SQL + " SELECT (SELECT count(*) FROM pages) AS results, count(*) AS writes, count(*) FILTER (WHERE failed) AS failed FROM f")
def results_json(spark, sf):
    path = shared_dir(spark, "results")
    res = results(spark, sf).drop("page_id")
    plan = upsert_plan(proposals(spark, sf), existing(spark, sf), destination="hubspot", match_key="domain")
    sinks.write_results_json(res, plan, path)
    writes = spark.read.schema(plan.schema).json(f"{path}/writes").select(F.lit("write").alias("kind"), "action")
    both = writes.unionByName(spark.read.schema(res.schema).json(f"{path}/results").select(F.lit("result").alias("kind"), F.lit(None).cast("string").alias("action")))
    return both.agg(
        F.count_if(F.col("kind") == "result").alias("results"), F.count_if(F.col("kind") == "write").alias("writes"),
        F.count_if(F.col("action") == "failed").alias("failed"),
    )


@query("page_snapshot", TEXT + " SELECT domain, arg_max(url, page_id) AS final_url, substr(sha256(arg_max(text, page_id)), 1, 16) AS content_hash FROM page_text GROUP BY domain")
def page_snapshot(spark, sf):
    """Pages written by fetch day and read back, newest per domain."""
    path = shared_dir(spark, "snapshot")
    sinks.write_snapshot(rendered(spark, sf), path)
    back = sinks.read_snapshot(spark, path, since=datetime(2024, 1, 1, tzinfo=timezone.utc))
    return latest_pages(back.select("domain", "final_url", "content_hash", "fetched_at")).select("domain", "final_url", "content_hash")


@query("run_log", "SELECT 'table:prospects' AS key, count(*) AS records, '2024-01-03 00:00:00' AS ran_at FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'table:all', count(*), '2024-01-01 00:00:00' FROM customer")
def run_log(spark, sf):
    path = shared_dir(spark, "runs")
    customers = table(spark, sf, "customer")
    runs = (("table:all", 1, customers), ("table:prospects", 5, customers), ("table:prospects", 3, customers.where("c_acctbal > 0")))
    for i, (key, day, df) in enumerate(runs):
        sinks.append_run_log(
            spark, path, key, datetime(2024, 1, day, tzinfo=timezone.utc), df.count(), datetime(2024, 2, 1 + i, tzinfo=timezone.utc)
        )
    return watermarks(sinks.read_run_log(spark, path)).select("key", "records", F.date_format("ran_at", "yyyy-MM-dd HH:mm:ss").alias("ran_at"))


def _signal_sql(name):
    return "(" + " OR ".join(f"regexp_matches(c, '{p}')" for p in SIGNALS[name]) + ")"


def _list_sql(*notes):
    return "nullif(array_to_string(list_filter([" + ", ".join(notes) + "], lambda x: x IS NOT NULL), '; '), '')"


# Every field of the catalogue: property, source, and the value it gets.
FIELDS_SQL = (
    ("name", "analysis.company_name", "company"),
    ("gtm_one_liner", "analysis.one_liner", "left(CASE WHEN paragraph <> '' THEN paragraph ELSE company || ' homepage.' END, 200)"),
    ("gtm_category", "analysis.category", "CASE WHEN best_category.score >= 2 THEN best_category.name ELSE 'unknown' END"),
    ("gtm_sells_to", "analysis.sells_to", _audience(hits(B2B), hits(B2C))),
    ("gtm_segment", "analysis.segment", _segment(hits(BIG), hits(SMALL))),
    ("gtm_business_model", "analysis.business_model", f"CASE WHEN {_signal_sql('has_pricing_page')} AND {_signal_sql('has_login')} THEN 'SaaS' WHEN {hits(CART)} > 0 THEN 'Ecommerce' WHEN {hits(SERVICES)} > 0 THEN 'Services' ELSE 'Unclear' END"),
    ("gtm_industries_served", "analysis.industries_served", f"nullif(array_to_string({found(AREAS, 'raw')}[1:8], '; '), '')"),
    ("gtm_icp_fit_score", "analysis.icp_fit_score", _score_sql(len(GOOD))),
    ("gtm_icp_fit_rationale", "analysis.icp_fit_rationale", "len(g) || ' good-fit and ' || len(p) || ' poor-fit ICP terms found on the page.'"),
    ("gtm_buying_signals", "analysis.buying_signals", _list_sql(
        f"CASE WHEN {_signal_sql('has_careers_page')} THEN 'Careers page is live (hiring)' END", *[f"CASE WHEN regexp_matches(raw, '{p}') THEN '{note}' END" for p, note in NOTES.items()])),
    ("gtm_disqualifiers", "analysis.disqualifiers", _list_sql(
        "CASE WHEN len(p) > 0 THEN 'Poor-fit ICP terms present: ' || array_to_string(p[1:4], ', ') END",
        "CASE WHEN length(full_copy) < 800 THEN 'Homepage is very thin; may be a placeholder or JS-only site' END")),
    ("gtm_primary_cta", "analysis.primary_cta", f"CASE WHEN {_signal_sql('has_demo_cta')} THEN 'Book a demo' WHEN {_signal_sql('has_free_trial')} THEN 'Start a free trial' WHEN {_signal_sql('has_contact_sales')} THEN 'Contact sales' ELSE 'None' END"),
    ("gtm_enrichment_confidence", "analysis.confidence", "CASE WHEN length(full_copy) > 1500 THEN 0.4 ELSE 0.2 END"),
    ("gtm_tech_signals", "tech_signals", f"nullif(array_to_string({found(VENDOR_SIGNATURES, 'assets')}, '; '), '')"),
    ("gtm_has_pricing_page", "page_signals.has_pricing_page", _signal_sql("has_pricing_page")),
    ("gtm_has_demo_cta", "page_signals.has_demo_cta", _signal_sql("has_demo_cta")),
    ("gtm_has_careers_page", "page_signals.has_careers_page", _signal_sql("has_careers_page")),
    ("gtm_enriched_from_url", "provenance.source_url", f"nullif({strip('url')}, '')"),
    ("gtm_enriched_at", "provenance.analyzed_at", "'2024-05-06T07:08:09.250000+00:00'"),
    ("gtm_enrichment_source", "provenance.analyzer", "'heuristic:v1'"),
    ("gtm_source_content_hash", "provenance.content_hash", "substr(sha256(full_copy), 1, 16)"),
)

# Link lines and asset URLs are made row by row: page ids need not be unique.
FILL_SQL = ANALYSED_SQL + f""",
tags AS (SELECT *, coalesce(text, '') AS full_copy, regexp_extract_all(m, '<a href="[^"]*">[^<]*</a>') AS anchors,
  regexp_extract_all(m, '(?is)<(?:script|img|iframe)\\s[^>]*>') AS sources, regexp_extract_all(m, '(?is)<link\\s[^>]*>') AS targets FROM scored),
parsed AS (SELECT *, list_transform(anchors, lambda a: root || {decode("regexp_extract(a, '" + '"([^"]*)"' + "', 1)")}) AS urls,
  list_transform(anchors, lambda a: {squash(decode("regexp_extract(a, '>([^<]*)<', 1)"))}) AS names,
  lower(array_to_string(list_concat(list_transform(sources, lambda t: root || '/' || regexp_extract(t, '(?is)\\ssrc\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
    list_transform(targets, lambda t: root || '/' || regexp_extract(t, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1))), chr(10))) AS assets FROM tags),
marked AS (SELECT *, contains(url, '#top') AS failed, lower(coalesce(array_to_string(list_filter(list_transform(urls, lambda u, i:
  CASE WHEN list_position(urls, u) = i THEN u || ' ' || names[i] END), lambda x: x IS NOT NULL), chr(10)), '') || chr(10) || full_copy) AS c FROM parsed),
counts AS (SELECT {", ".join(f"count({value}) FILTER (WHERE NOT failed) AS {name}" for name, _, value in FIELDS_SQL)} FROM marked)
SELECT property, source, filled FROM (VALUES {", ".join(f"('{name}', '{source}')" for name, source, _ in FIELDS_SQL)}) AS catalogue(property, source)
JOIN (FROM counts UNPIVOT (filled FOR property IN ({", ".join(name for name, _, _ in FIELDS_SQL)}))) USING (property)"""


@query("field_fill", FILL_SQL)
def field_fill(spark, sf):
    """The whole field catalogue next to how many payloads fill each field."""
    mapping = Mapping.default()
    payloads = build_payloads(results(spark, sf), mapping, "hubspot")
    names = mapping.property_names("hubspot")
    counts = payloads.agg(*[F.count(F.col(f"properties.`{n}`")).alias(n) for n in names])
    filled = counts.unpivot([], names, "property", "filled")
    catalogue = field_catalogue(spark, mapping, "hubspot").select("property", "source")
    return catalogue.join(filled, "property").select("property", "source", "filled")
