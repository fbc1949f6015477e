"""Filters over an account table: customers, with their newest late order as enrichment time."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from accountlake.config import Condition, FilterSpec
from accountlake.operators.predicates import apply_filter, condition_problem, dnf_filter, modified_since, preflight, preview
from accountlake.sources.accounts import first_targets, read_accounts
from suite.registry import query, table

NOW = datetime(2001, 8, 1, tzinfo=timezone.utc)
LATE = "2001-05-01"


def accounts(spark, sf):
    late = (
        table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.max(F.when(F.col("o_orderdate") >= F.lit(LATE).cast("timestamp_ntz"), F.col("o_orderdate"))).alias("enriched_at"),
            F.max("o_orderdate").alias("modified_at"),
        )
    )
    customers = table(spark, sf, "customer")
    domain = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit(".example"))
    return customers.join(late, "c_custkey", "left").select(
        F.col("c_custkey").cast("string").alias("record_id"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < 1000), "").otherwise(domain).alias("domain"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.lower("c_mktsegment")).alias("lifecycle"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "enriched_at", "modified_at",
    )


ACCOUNTS = f"""WITH late AS (SELECT o_custkey, max(CASE WHEN o_orderdate >= TIMESTAMP '{LATE}' THEN o_orderdate END) AS enriched_at, max(o_orderdate) AS modified_at FROM orders GROUP BY 1),
accounts AS (SELECT c_custkey::VARCHAR AS record_id,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 1000 THEN '' ELSE lower(replace(c_name, '#', '-')) || '.example' END AS domain,
  c_name AS name, CASE WHEN c_mktsegment <> 'FURNITURE' THEN lower(c_mktsegment) END AS lifecycle, c_nationkey AS nation, c_acctbal AS balance,
  enriched_at, modified_at FROM customer LEFT JOIN late ON o_custkey = c_custkey)
"""

CASES = {
    "equals": (Condition("lifecycle", "equals", "building"), "lifecycle = 'building'"),
    "not_equals": (Condition("lifecycle", "not_equals", "building"), "lifecycle <> 'building'"),
    "is_known": (Condition("enriched_at", "is_known"), "enriched_at IS NOT NULL"),
    "is_unknown": (Condition("domain", "is_unknown"), "domain IS NULL"),
    "in": (Condition("lifecycle", "in", ["building", "household"]), "lifecycle IN ('building', 'household')"),
    "in_scalar": (Condition("nation", "in", 7), "nation IN (7)"),
    "not_in": (Condition("lifecycle", "not_in", ["building", "household"]), "lifecycle NOT IN ('building', 'household')"),
    "greater_than": (Condition("balance", "greater_than", 5000), "balance > 5000"),
    "less_than": (Condition("balance", "less_than", 0), "balance < 0"),
    "contains": (Condition("name", "contains", "#0000001"), "contains(name, '#0000001')"),
    "contains_text": (Condition("lifecycle", "contains", "il"), "contains(lifecycle, 'il')"),
    "older_than_days": (Condition("enriched_at", "older_than_days", 40.5), "enriched_at < TIMESTAMP '2001-08-01' - INTERVAL 3499200 SECOND"),
    "newer_than_days": (Condition("enriched_at", "newer_than_days", 40), "enriched_at > TIMESTAMP '2001-08-01' - INTERVAL 40 DAY"),
    "or_unknown": (Condition("enriched_at", "older_than_days", 40, True), "(enriched_at < TIMESTAMP '2001-08-01' - INTERVAL 40 DAY OR enriched_at IS NULL)"),
    "not_in_or_unknown": (Condition("lifecycle", "not_in", ["building", "household"], True), "(lifecycle NOT IN ('building', 'household') OR lifecycle IS NULL)"),
    "known_or_unknown": (Condition("lifecycle", "is_known", None, True), "lifecycle IS NOT NULL"),
}


def _register(name, cond, where):
    @query(f"filter_{name}", f"{ACCOUNTS} SELECT record_id, name, lifecycle, balance FROM accounts WHERE {where}")
    def run(spark, sf):
        found = apply_filter(accounts(spark, sf), FilterSpec(name, (cond,)), now=NOW)
        return found.select("record_id", "name", "lifecycle", "balance")


for _name, (_cond, _where) in CASES.items():
    _register(_name, _cond, _where)

# The filter of a typical prospecting run, in neutral names.
PROSPECTS = FilterSpec.from_dict({
    "name": "prospects",
    "fields": {
        "website": {"table": "domain", "hubspot": "domain"},
        "stage": {"table": "lifecycle", "hubspot": "lifecyclestage"},
        "seen_at": {"table": "enriched_at"},
    },
    "filters": [
        {"field": "website", "op": "is_known"},
        {"field": "stage", "op": "not_in", "value": ["building", "household"], "or_unknown": True},
        {"field": "seen_at", "op": "older_than_days", "value": 30, "or_unknown": True},
    ],
    "limit": 0,
})
PROSPECTS_SQL = (
    "domain IS NOT NULL AND (lifecycle NOT IN ('building', 'household') OR lifecycle IS NULL) "
    "AND (enriched_at < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY OR enriched_at IS NULL)"
)


@query("filter_all_conditions", f"{ACCOUNTS} SELECT record_id, domain FROM accounts WHERE {PROSPECTS_SQL}")
def filter_all_conditions(spark, sf):
    return apply_filter(accounts(spark, sf), PROSPECTS, now=NOW).select("record_id", "domain")


@query("filter_no_conditions", f"{ACCOUNTS} SELECT record_id, domain FROM accounts")
def filter_no_conditions(spark, sf):
    return apply_filter(accounts(spark, sf), FilterSpec("all"), now=NOW).select("record_id", "domain")


@query("filter_as_alternatives", f"{ACCOUNTS} SELECT record_id, domain FROM accounts WHERE {PROSPECTS_SQL}")
def filter_as_alternatives(spark, sf):
    """The same filter expanded to OR-of-ANDs."""
    return apply_filter(accounts(spark, sf), dnf_filter(PROSPECTS), now=NOW).select("record_id", "domain")


RAW_TEXT = FilterSpec("raw", (Condition("name", "equals", "ignored"),), raw={"table": "balance > 1000 AND (nation = 3 OR lifecycle IS NULL)"})


@query("filter_raw_text", f"{ACCOUNTS} SELECT record_id FROM accounts WHERE balance > 1000 AND (nation = 3 OR lifecycle IS NULL)")
def filter_raw_text(spark, sf):
    return apply_filter(accounts(spark, sf), RAW_TEXT, now=NOW).select("record_id")


RAW_GROUPS = FilterSpec.from_dict({"name": "groups", "raw": {"table": {"filterGroups": [
    {"filters": [{"propertyName": "domain", "operator": "HAS_PROPERTY"}, {"propertyName": "nation", "operator": "IN", "values": [1, 2]}]},
    {"filters": [{"propertyName": "balance", "operator": "GT", "value": 9000}]},
]}}})


@query("filter_raw_groups", f"{ACCOUNTS} SELECT record_id FROM accounts WHERE (domain IS NOT NULL AND nation IN (1, 2)) OR balance > 9000")
def filter_raw_groups(spark, sf):
    return apply_filter(accounts(spark, sf), RAW_GROUPS, now=NOW).select("record_id")


@query("filter_modified_since", f"{ACCOUNTS} SELECT record_id FROM accounts WHERE balance > 1000 AND (nation = 3 OR lifecycle IS NULL) AND modified_at > TIMESTAMP '2001-03-01 12:00:00'")
def filter_modified_since(spark, sf):
    """On top of a raw filter, too."""
    found = apply_filter(accounts(spark, sf), RAW_TEXT, now=NOW)
    return modified_since(found, "modified_at", datetime(2001, 3, 1, 12, tzinfo=timezone.utc)).select("record_id")


@query("read_accounts", f"{ACCOUNTS} SELECT record_id, domain, 'table' AS source, name, balance FROM accounts WHERE {PROSPECTS_SQL} AND domain <> ''")
def read_accounts_query(spark, sf):
    return read_accounts(accounts(spark, sf), PROSPECTS, record_id="record_id", properties=("name", "balance"), now=NOW)


@query("read_accounts_limit", f"{ACCOUNTS} SELECT count(*) AS n, count(*) AS with_domain FROM (SELECT * FROM accounts WHERE {PROSPECTS_SQL} AND domain <> '' LIMIT 100)")
def read_accounts_limit(spark, sf):
    """Which 100 is not fixed; that there are 100, each with a domain, is."""
    got = read_accounts(accounts(spark, sf), PROSPECTS, now=NOW, limit=100)
    return got.agg(F.count("*").alias("n"), F.count(F.nullif("domain", F.lit(""))).alias("with_domain"))


@query("first_targets", f"{ACCOUNTS} SELECT record_id, name FROM accounts ORDER BY record_id::BIGINT LIMIT 25")
def first_targets_query(spark, sf):
    ordered = accounts(spark, sf).withColumn("ord", F.col("record_id").cast("long"))
    return first_targets(ordered, 25).select("record_id", "name")


@query("filter_preflight", f"""{ACCOUNTS} SELECT count(*) AS checked, 'owner; region; renewal_at' AS missing FROM accounts""")
def filter_preflight(spark, sf):
    """Names a filter needs and the table lacks, next to how many rows would have been read."""
    df = accounts(spark, sf)
    spec = FilterSpec("bad", (Condition("region", "is_known"), Condition("nation", "equals", 1)))
    raw = FilterSpec("bad", raw={"table": "renewal_at > enriched_at AND owner = 'x' AND nation = 1"})
    missing = sorted({*preflight(df, spec), *preflight(df, raw)})
    return df.agg(F.count("*").alias("checked")).withColumn("missing", F.lit("; ".join(missing)))


@query("filter_preview", f"{ACCOUNTS} SELECT least(count(*), 20) AS shown, true AS ready FROM accounts WHERE {PROSPECTS_SQL}")
def filter_preview(spark, sf):
    missing, rows = preview(accounts(spark, sf), PROSPECTS, 20, now=NOW)
    return rows.agg(F.count("*").alias("shown")).withColumn("ready", F.lit(not missing))


OPS = (
    "equals", "not_equals", "is_known", "is_unknown", "in", "not_in", "greater_than", "less_than", "contains", "older_than_days",
    "newer_than_days", "like", "between",
)
VALUES = ("null", "5", '"5"', "[1,2]", "true", "2.5")
_OP = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN '{op}'" for i, op in enumerate(OPS)) + " END"
_VALUE = "CASE event_id // 13 % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VALUES)) + " END"


@query("condition_problems", f"""WITH c AS (SELECT event_type, {_OP} AS op, {_VALUE} AS value FROM events),
j AS (SELECT *, CASE WHEN op IN ('like', 'between') THEN 'unknown operator ''' || op || '''; use one of {', '.join(OPS[:11])}'
  WHEN op IN ('is_known', 'is_unknown') THEN CASE WHEN value <> 'null' THEN 'operator ''' || op || ''' takes no value' END
  WHEN value = 'null' THEN 'operator ''' || op || ''' needs a value'
  WHEN ends_with(op, '_days') AND value NOT IN ('5', '2.5') THEN 'operator ''' || op || ''' needs a number of days' END AS problem FROM c)
SELECT event_type, op, problem, count(*) AS n FROM j GROUP BY ALL""")
def condition_problems(spark, sf):
    """Every event as a condition of some operator and value, with what is wrong with it."""
    def choose(values, number):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))

    conditions = table(spark, sf, "events").select(
        "event_type", choose(OPS, F.col("event_id")).alias("op"), choose(VALUES, F.floor(F.col("event_id") / len(OPS))).alias("value"))
    judged = conditions.withColumn("problem", condition_problem("op", "value"))
    return judged.groupBy("event_type", "op", "problem").agg(F.count("*").alias("n"))
