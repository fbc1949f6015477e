"""Payloads and upsert plans."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from accountlake.config import Mapping
from accountlake.functions import values as V
from accountlake.functions.usage import summary_line
from accountlake.operators import report
from accountlake.operators.payload import build_payloads
from accountlake.operators.upsert import to_write, upsert_plan
from accountlake.plans.enrich import enrich, in_input_order, plan_writes
from accountlake.sources.sinks import flat_payloads
from suite.pages import KIND_SQL, STATUS_SQL, crawl
from suite.registry import query, table
from suite.scoring import (
    ANALYSED_SQL, AREAS, B2B, B2C, BIG, CART, CATEGORIES, GOOD, NOTES, PATTERNS, PROFILE, SERVICES, SMALL, analysed,
    _score_sql, found,
)
from suite.sqltext import host

ANALYSED_AT = datetime(2024, 5, 6, 7, 8, 9, 250000, tzinfo=timezone.utc)


def results(spark, sf):
    """Analysed pages as results, keyed by page so that every page gives a payload."""
    pages = analysed(spark, sf)
    provenance = F.col("provenance").withField("analyzed_at", F.lit(ANALYSED_AT))
    failed = F.col("final_url").contains("#top")
    return pages.select(
        "page_id", F.concat(F.col("page_id").cast("string"), F.lit("."), F.col("domain")).alias("domain"),
        (~failed).alias("ok"), F.when(~failed, F.col("analysis")).alias("analysis"), F.when(~failed, provenance).alias("provenance"),
        "tech_signals", "page_signals", F.when(failed, F.lit("HTTP 404")).alias("error"), F.lit(False).alias("from_cache"),
    )


_INDUSTRIES = f"nullif(array_to_string({found(AREAS, 'raw')}[1:8], '; '), '')"
_RESULTS_SQL = ANALYSED_SQL + f""",
results AS (SELECT page_id, page_id || '.' || domain AS rdomain, contains(url, '#top') AS failed, url, company,
  CASE WHEN best_category.score >= 2 THEN best_category.name ELSE 'unknown' END AS category, {_INDUSTRIES} AS industries,
  {_score_sql(len(GOOD))} AS score, CASE WHEN length(text) > 1500 THEN 0.4 ELSE 0.2 END AS confidence FROM scored)"""


@query("payloads", _RESULTS_SQL + """
SELECT rdomain AS domain, 'companies' AS object_type, 'domain' AS match_key, CASE WHEN NOT failed THEN rdomain END AS match_value,
  CASE WHEN NOT failed THEN company END AS name, CASE WHEN NOT failed THEN industries END AS industries,
  CASE WHEN NOT failed THEN score::BIGINT END AS score, CASE WHEN NOT failed THEN confidence::DOUBLE END AS confidence,
  CASE WHEN NOT failed THEN '2024-05-06T07:08:09.250000+00:00' END AS enriched_at, CASE WHEN NOT failed THEN url END AS source_url,
  CASE WHEN NOT failed THEN rdomain END AS key_property, CASE WHEN failed THEN 'HTTP 404' END AS error FROM results""")
def payloads(spark, sf):
    p = F.col("properties")
    built = build_payloads(results(spark, sf), Mapping.default(), "hubspot")
    return built.select(
        "domain", "object_type", "match_key", "match_value", p["name"].alias("name"), p["gtm_industries_served"].alias("industries"),
        p["gtm_icp_fit_score"].cast("long").alias("score"), p["gtm_enrichment_confidence"].alias("confidence"),
        p["gtm_enriched_at"].alias("enriched_at"), p["gtm_enriched_from_url"].alias("source_url"), p["domain"].alias("key_property"), "error",
    )


@query("payloads_flat", _RESULTS_SQL + " SELECT rdomain AS domain, company AS name, category, score::BIGINT AS score, 'https://' || rdomain AS website FROM results WHERE NOT failed")
def payloads_flat(spark, sf):
    flat = flat_payloads(build_payloads(results(spark, sf), Mapping.default(), "salesforce"))
    return flat.select(
        "domain", F.col("Name").alias("name"), F.col("GTM_Category__c").alias("category"),
        F.col("GTM_ICP_Fit_Score__c").cast("long").alias("score"), F.col("Website").alias("website"),
    )


@query("summary_lines", _RESULTS_SQL + " SELECT CASE WHEN failed THEN rdomain || ': FAILED (HTTP 404)' ELSE rdomain || ': ' || company || ' — ' || category || ' — ICP ' || score END AS line FROM results")
def summary_lines(spark, sf):
    return results(spark, sf).select(summary_line("domain", "ok", "error", "analysis").alias("line"))


@query("coerce_values", """
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS flag_text, c_acctbal > 0 AS flag,
  nullif(array_to_string(list_filter([c_mktsegment, CASE WHEN c_nationkey > 12 THEN 'far' END], lambda x: x IS NOT NULL), '; '), '') AS list_text,
  c_nationkey::BIGINT AS number, c_acctbal AS amount, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS text FROM customer""")
def coerce_values(spark, sf):
    def value(c, kind, type_name, destination="hubspot"):
        return V.coerce(c, spark.range(1).select(F.lit(None).cast(kind).alias("x")).schema["x"].dataType, type_name, destination)

    positive = F.col("c_acctbal") > 0
    tags = F.array_compact(F.array("c_mktsegment", F.when(F.col("c_nationkey") > 12, "far")))
    return table(spark, sf, "customer").select(
        "c_custkey", value(positive, "boolean", "boolean").alias("flag_text"),
        value(positive, "boolean", "boolean", "salesforce").alias("flag"), value(tags, "array<string>", "list").alias("list_text"),
        value(F.col("c_nationkey"), "int", "number").cast("long").alias("number"), value(F.col("c_acctbal"), "double", "number").alias("amount"),
        value(F.when(F.col("c_mktsegment") == "BUILDING", " \t ").otherwise(F.col("c_name")), "string", "string").alias("text"),
    )


@query("iso_datetimes", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN ts = date_trunc('second', ts) THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS ts,
  strftime(ts, '%Y-%m-%dT%H:00:00+00:00') AS hour FROM events""")
def iso_datetimes(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", V.iso_datetime("ts").alias("ts"), V.iso_datetime(F.date_trunc("hour", "ts")).alias("hour")
    )


_TRIM0 = "regexp_replace(regexp_replace({}, '0+$', ''), '\\.$', '')"


@query("comparable_values", f"""
SELECT c_custkey, {_TRIM0.format("printf('%.2f', c_acctbal)")} AS amount, c_nationkey::VARCHAR AS whole, c_nationkey::VARCHAR AS whole_float,
  CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS flag, c_name AS text, '' AS missing,
  {_TRIM0.format("printf('%.2f', c_acctbal * 1000000)")} AS large FROM customer""")
def comparable_values(spark, sf):
    kinds = {k: spark.range(1).select(F.lit(None).cast(k).alias("x")).schema["x"].dataType for k in ("double", "int", "boolean", "string")}
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit("\n"))
    return table(spark, sf, "customer").select(
        "c_custkey", V.comparable(F.col("c_acctbal"), kinds["double"]).alias("amount"),
        V.comparable(F.col("c_nationkey"), kinds["int"]).alias("whole"), V.comparable(F.col("c_nationkey").cast("double"), kinds["double"]).alias("whole_float"),
        V.comparable(F.col("c_acctbal") > 0, kinds["boolean"]).alias("flag"), V.comparable(padded, kinds["string"]).alias("text"),
        V.comparable(F.lit(None).cast("string"), kinds["string"]).alias("missing"),
        V.comparable(F.round(F.col("c_acctbal") * 100).cast("long") * F.lit(10000.0), kinds["double"]).alias("large"),
    )


# --- upserts: proposals from customers against what is already there -------

SITE_SQL = "lower(replace(c_name, '#', '-')) || '.example'"


def proposals(spark, sf):
    domain = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example"))
    broken = F.col("c_mktsegment") == "FURNITURE"
    properties = F.struct(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"),
        (F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_nationkey") != 5, F.col("c_mktsegment")).alias("segment"), domain.alias("domain"),
    )
    return table(spark, sf, "customer").select(
        domain.alias("domain"), F.lit("companies").alias("object_type"), F.lit("domain").alias("match_key"),
        F.when(~broken, domain).alias("match_value"), F.when(~broken, properties).alias("properties"), F.when(broken, "no page").alias("error"),
    )


def existing(spark, sf):
    """Customers with a positive balance, as text and padded, some values stale; every record also as a later copy."""
    c = table(spark, sf, "customer").where("c_acctbal > -200")
    domain = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example"))
    record = c.select(
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("record_id"), F.concat(F.lit(" "), F.upper(domain)).alias("domain"),
        F.concat(F.col("c_name"), F.lit("  ")).alias("name"), F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_nationkey") == 7, "70").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(F.col("c_acctbal") > 9000, "no").otherwise((F.col("c_acctbal") > 0).cast("string")).alias("active"),
        F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")).alias("segment"),
    )
    copies = record.withColumn("record_id", F.concat(F.lit("B"), "record_id")).withColumn("name", F.lit("stale"))
    return record.unionByName(copies)


UPSERT_SQL = f"""
WITH p AS (SELECT *, {SITE_SQL} AS domain, c_acctbal > -200 AS known, c_mktsegment = 'FURNITURE' AS failed FROM customer),
f AS (SELECT *, CASE WHEN failed THEN [] WHEN NOT known THEN CASE WHEN c_nationkey = 5 THEN ['active', 'balance', 'domain', 'name', 'nation'] ELSE ['active', 'balance', 'domain', 'name', 'nation', 'segment'] END
  ELSE list_filter([CASE WHEN c_acctbal > 9000 THEN 'active' END, 'domain', CASE WHEN c_nationkey = 7 THEN 'nation' END,
                    CASE WHEN c_nationkey = 3 THEN 'segment' END], lambda x: x IS NOT NULL) END AS fields FROM p)"""


def _plan_columns(plan):
    return plan.select("domain", "action", "record_id", F.array_join("changed_fields", "; ").alias("fields"), "error")


@query("upsert_plan", UPSERT_SQL.replace("'domain', CASE WHEN c_nationkey = 7", "CASE WHEN c_nationkey = 7") + """
SELECT domain, CASE WHEN failed THEN 'failed' WHEN NOT known THEN 'created' WHEN len(fields) = 0 THEN 'skipped' ELSE 'updated' END AS action,
  CASE WHEN known AND NOT failed THEN 'A' || c_custkey END AS record_id, array_to_string(fields, '; ') AS fields, CASE WHEN failed THEN 'no page' END AS error FROM f""")
def upsert_plan_query(spark, sf):
    old = existing(spark, sf).withColumn("domain", F.lower(F.trim("domain")))
    return _plan_columns(upsert_plan(proposals(spark, sf), old, destination="hubspot", match_key="domain"))


@query("upsert_changes", f"""
WITH p AS (SELECT *, {SITE_SQL} AS domain FROM customer WHERE c_acctbal > -200 AND c_mktsegment <> 'FURNITURE')
SELECT domain, '{{' || array_to_string(list_filter([CASE WHEN c_acctbal > 9000 THEN '"active":true' END, '"domain":"' || domain || '"',
  CASE WHEN c_nationkey = 7 THEN '"nation":7' END, CASE WHEN c_nationkey = 3 THEN '"segment":"' || c_mktsegment || '"' END], lambda x: x IS NOT NULL), ',') || '}}' AS changes FROM p""")
def upsert_changes(spark, sf):
    """Only the changed values; the upper-case key on file matches and is corrected."""
    plan = upsert_plan(proposals(spark, sf), existing(spark, sf), destination="hubspot", match_key="domain")
    return to_write(plan).where("record_id is not null").select("domain", "changes")


@query("upsert_dry_run", UPSERT_SQL + """
SELECT CASE WHEN failed THEN 'failed' WHEN known THEN 'would_update' ELSE 'would_create' END AS action, count(*) AS n FROM f GROUP BY 1""")
def upsert_dry_run(spark, sf):
    plan = upsert_plan(proposals(spark, sf), existing(spark, sf), destination="hubspot", match_key="domain", dry_run=True)
    return report.writes_by_action(plan)


@query("upsert_without_records", UPSERT_SQL + """ SELECT CASE WHEN failed THEN 'failed' ELSE 'would_create' END AS action, count(*) AS n FROM f GROUP BY 1""")
def upsert_without_records(spark, sf):
    return report.writes_by_action(upsert_plan(proposals(spark, sf), None, destination="hubspot", match_key="domain"))


@query("write_failures", UPSERT_SQL + " SELECT domain, 'no page' AS error FROM f WHERE failed")
def write_failures(spark, sf):
    return report.failures(upsert_plan(proposals(spark, sf), existing(spark, sf), destination="hubspot", match_key="domain"))


def websites(spark, sf):
    """Account websites as people enter them: every page URL, and every nation's shared landing page."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("P"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("record_id"), F.upper("url").alias("website"))
    landing = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("record_id"),
        F.concat(F.lit("https://go.nation"), F.col("c_nationkey").cast("string"), F.lit(".co/x.php?at="), F.col("c_custkey").cast("string")).alias("website"),
    )
    return pages.unionByName(landing)


NEEDLES = f"""needles AS (
  SELECT DISTINCT d FROM (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/]*)', 1)), '^(www|m|blog)\\.', '') AS d FROM pages
  UNION ALL SELECT 'nation' || n_nationkey || '.co' FROM nation UNION ALL SELECT 'go.nation' || n_nationkey || '.co' FROM nation
  UNION ALL SELECT 'ation' || n_nationkey || '.c' FROM nation UNION ALL SELECT 'nation' || n_nationkey || '.com' FROM nation) x)"""


@query("upsert_contains", f"""
WITH {NEEDLES}, sites AS (SELECT 'P' || lpad(page_id::VARCHAR, 9, '0') AS record_id, lower(url) AS website FROM pages
  UNION ALL SELECT 'C' || lpad(c_custkey::VARCHAR, 9, '0'), 'https://go.nation' || c_nationkey || '.co/x.php?at=' || c_custkey FROM customer)
SELECT d AS domain, min(record_id) AS record_id, CASE WHEN min(record_id) IS NULL THEN 'created' ELSE 'updated' END AS action
FROM needles LEFT JOIN sites ON contains(website, d) GROUP BY d""")
def upsert_contains(spark, sf):
    """Records found by a domain anywhere in their website."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^https?://([^/]*)", 1)), r"^(www|m|blog)\.", "")
    nations = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    shapes = F.explode(F.array(
        F.concat(F.lit("nation"), key, F.lit(".co")), F.concat(F.lit("go.nation"), key, F.lit(".co")),
        F.concat(F.lit("ation"), key, F.lit(".c")), F.concat(F.lit("nation"), key, F.lit(".com")),
    ))
    domains = table(spark, sf, "pages").select(host.alias("domain")).union(nations.select(shapes.alias("domain"))).distinct()
    payload = domains.select(
        "domain", F.lit("Website").alias("match_key"), F.concat(F.lit("https://"), F.col("domain")).alias("match_value"),
        F.struct(F.col("domain").alias("website")).alias("properties"), F.lit(None).cast("string").alias("error"),
    )
    plan = upsert_plan(payload, websites(spark, sf), destination="salesforce", match_key="website", match="contains", rows_per_task=500)
    return plan.select("domain", "record_id", "action")


# --- the whole run ---------------------------------------------------------


def run_results(spark, sf):
    accounts = table(spark, sf, "pages").select(
        F.posexplode(F.array("url", F.concat(F.lit("page "), F.col("page_id").cast("string")))).alias("k", "domain"), "page_id"
    ).select("domain", (F.col("page_id") * 2 + F.col("k")).alias("ord"))
    return enrich(
        accounts, crawl(spark, sf), PROFILE, patterns=PATTERNS_ALL, analyzed_at=ANALYSED_AT, categories=CATEGORIES, verticals=AREAS,
        markers={"b2b": B2B, "b2c": B2C, "enterprise": BIG, "smb": SMALL, "cart": CART, "services": SERVICES}, signal_notes=NOTES,
    )


PATTERNS_ALL = {**PATTERNS, **{n: (p,) for n, p in {
    "has_pricing_page": r"/la\n", "has_login": "eau", "has_demo_cta": "/un", "has_free_trial": "/de", "has_contact_sales": "/to", "has_careers_page": "/in",
}.items()}}


STATUS_ERROR = f"""CASE WHEN {STATUS_SQL} >= 400 THEN 'HTTP ' || {STATUS_SQL} WHEN NOT contains(lower({KIND_SQL}), 'html') THEN 'not HTML (' || {KIND_SQL} || ')'
  WHEN length(text) < 200 THEN 'page rendered to ' || length(text) || ' chars (likely JS-only)' END"""
RUN_SQL = ANALYSED_SQL + f""",
tries AS (SELECT *, CASE WHEN starts_with(host, 'www.') THEN 2 ELSE 1 END AS k, {STATUS_ERROR} AS problem FROM scored
  QUALIFY row_number() OVER (PARTITION BY domain, k ORDER BY page_id DESC) = 1),
best AS (SELECT domain, arg_min(page_id, k) AS page_id FROM tries WHERE problem IS NULL GROUP BY domain),
errors AS (SELECT domain, string_agg('https://' || CASE k WHEN 2 THEN 'www.' ELSE '' END || domain || '/: ' || problem, '; ' ORDER BY k) AS error FROM tries WHERE problem IS NOT NULL GROUP BY domain),
run AS (SELECT d.domain, d.ord, b.page_id IS NOT NULL AS ok, CASE WHEN b.page_id IS NULL THEN e.error END AS error, s.company, CASE WHEN b.page_id IS NOT NULL THEN {_score_sql(len(GOOD))}::BIGINT END AS score
  FROM (SELECT domain, min(page_id) * 2 AS ord FROM site GROUP BY domain) d LEFT JOIN best b USING (domain) LEFT JOIN errors e USING (domain) LEFT JOIN scored s ON s.page_id = b.page_id
  UNION ALL SELECT 'page ' || page_id, page_id * 2 + 1, false, 'Not a domain: ' || chr(39) || 'page ' || page_id || chr(39), NULL, NULL FROM pages)"""


@query("enrich_accounts", RUN_SQL + " SELECT domain, ord, ok, error, company, score FROM run")
def enrich_accounts(spark, sf):
    """Accounts and crawl to ordered results, unusable inputs included."""
    return in_input_order(run_results(spark, sf)).select(
        "domain", "ord", "ok", "error", F.col("analysis.company_name").alias("company"), F.col("analysis.icp_fit_score").cast("long").alias("score")
    )


@query("enrich_and_plan", RUN_SQL + f""" SELECT run.domain, CASE WHEN NOT ok THEN 'failed' WHEN r.id IS NULL THEN 'created' ELSE 'updated' END AS action,
  CASE WHEN ok THEN r.id END AS record_id, error FROM run LEFT JOIN (
    SELECT {host('url')} AS h, min('R' || page_id) AS id FROM pages GROUP BY 1) r ON r.h = run.domain""")
def enrich_and_plan(spark, sf):
    existing_sites = table(spark, sf, "pages").select(
        F.concat(F.lit("R"), F.col("page_id").cast("string")).alias("record_id"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("domain"),
        F.lit("x").alias("name"),
    )
    plan = plan_writes(run_results(spark, sf), Mapping.default(), "hubspot", existing_sites)
    return plan.select("domain", "action", "record_id", "error")
