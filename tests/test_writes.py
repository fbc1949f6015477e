"""Mapping, upserts, whole runs, reuse, hot keys."""

from __future__ import annotations

import json
import random
import re
from datetime import timedelta

import pytest
from samples import NOW
from pyspark.sql import functions as F, types as T

from accountlake.config import ConfigError, Mapping, Profile
from accountlake.functions import values as V
from accountlake.functions.usage import summary_line
from accountlake.operators import report, reuse
from accountlake.operators.keys import lookup_join, one_per_key, row_per_key
from accountlake.operators.payload import MappingError, build_payloads, field_catalogue, resolve
from accountlake.operators.upsert import find_by_contains, to_write, upsert_plan
from accountlake.plans.enrich import analyses_to_keep, enrich, in_input_order, plan_writes


@pytest.fixture(scope="module")
def crawl_rows(spark):
    from samples import HOMEPAGE

    rows = [
        ("https://acme.example/", "https://acme.example/", 200, HOMEPAGE, NOW),
        ("https://www.beta.example/", "https://www.beta.example/", 200, HOMEPAGE.replace("Ladle", "Beta"), NOW),
        ("https://gone.example/", "https://gone.example/", 404, "x", NOW),
    ]
    return spark.createDataFrame(rows, "url string, final_url string, status_code int, html string, fetched_at timestamp")


@pytest.fixture(scope="module")
def accounts(spark):
    rows = [("Acme.example", 0), ("gone.example", 1), ("not a domain", 2), ("https://beta.example/x", 3), ("acme.example", 4)]
    return spark.createDataFrame(rows, "domain string, ord long")


@pytest.fixture(scope="module")
def results(spark, accounts, crawl_rows):
    return enrich(accounts, crawl_rows, Profile.default(), analyzed_at=NOW).cache()


def test_results_keep_input_order_and_failures(results):
    got = [(r.domain, r.ok) for r in in_input_order(results).collect()]
    assert got == [("acme.example", True), ("gone.example", False), ("not a domain", False), ("beta.example", True)]


def test_summary_lines(results):
    lines = [r[0] for r in in_input_order(results).select(summary_line("domain", "ok", "error", "analysis")).collect()]
    assert lines[0] == "acme.example: Ladle Metrics — analytics — ICP 59"
    assert lines[2] == "not a domain: FAILED (Not a domain: 'not a domain')"


def test_payload_shapes(results):
    hub = build_payloads(results, Mapping.default(), "hubspot").where("domain = 'acme.example'").first()
    assert (hub.object_type, hub.match_key, hub.match_value) == ("companies", "domain", "acme.example")
    assert hub.properties["gtm_icp_fit_score"] == 59 and hub.properties["gtm_has_demo_cta"] == "true"
    assert hub.properties["gtm_enriched_at"] == "2026-01-02T00:00:00+00:00" and hub.properties["domain"] == "acme.example"
    assert hub.properties["gtm_industries_served"] is None and hub.properties["gtm_tech_signals"] == "HubSpot; Segment; WordPress"
    sf = build_payloads(results, Mapping.default(), "salesforce").where("domain = 'acme.example'").first()
    assert (sf.object_type, sf.match_value, sf.properties["Website"]) == ("Account", "https://acme.example", "https://acme.example")
    assert sf.properties["GTM_Has_Demo_CTA__c"] is True
    with pytest.raises(ConfigError, match="no object configured"):
        build_payloads(results, Mapping.default(), "pipedrive")


def test_paths(results):
    schema = results.schema
    assert resolve(schema, "analysis.icp_fit_score")[1] == T.IntegerType()
    assert resolve(schema, "page_signals.has_unicorns") is None
    for bad in ("analysis.nope", "nope", "domain.x"):
        with pytest.raises(MappingError):
            resolve(schema, bad)


def test_match_key_that_is_mapped_keeps_its_value(results):
    mapping = Mapping.from_dict({"objects": {"crm": "X"}, "match_keys": {"crm": "site"}, "fields": [{"source": "error", "crm": "site"}]})
    row = build_payloads(results, mapping, "crm").where("domain = 'acme.example'").first()
    assert row.properties["site"] == "acme.example"


def test_coercion(one):
    arrays, times = T.ArrayType(T.StringType()), T.TimestampType()
    assert one(V.coerce(F.array(F.lit("a"), F.lit("b")), arrays, "list", "hubspot")) == "a; b"
    assert one(V.coerce(F.array().cast(arrays), arrays, "list", "hubspot")) is None
    assert one(V.coerce(F.lit(True), T.BooleanType(), "boolean", "hubspot")) == "true"
    assert one(V.coerce(F.lit(False), T.BooleanType(), "boolean", "salesforce")) is False
    assert one(V.coerce(F.lit("   "), T.StringType(), "string", "hubspot")) is None
    assert one(V.coerce(F.lit("2.5"), T.StringType(), "number", "hubspot")) == 2.5
    assert one(V.coerce(F.lit(NOW + timedelta(microseconds=5)), times, "datetime", "x")) == "2026-01-02T00:00:00.000005+00:00"


@pytest.mark.parametrize(("value", "kind", "text"), [
    (78, T.IntegerType(), "78"), (78.0, T.DoubleType(), "78"), (0.85, T.DoubleType(), "0.85"), (12345678.5, T.DoubleType(), "12345678.5"),
    (0.0001, T.DoubleType(), "0.0001"), (1e17, T.DoubleType(), "100000000000000000"), (-3.25, T.DoubleType(), "-3.25"),
    (True, T.BooleanType(), "true"), ("  x ", T.StringType(), "x"), (None, T.StringType(), ""), (0.0, T.DoubleType(), "0"),
])
def test_comparable(one, value, kind, text):
    assert one(V.comparable(F.lit(value).cast(kind), kind)) == text


def payloads(spark, rows, key="domain"):
    schema = "domain string, properties struct<score:int,name:string,flag:boolean,domain:string>, error string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"match_key": F.lit(key), "match_value": F.col("domain"), "object_type": F.lit("companies")})


def test_upsert_actions(spark):
    rows = [
        ("a.io", (78, "Acme Analytics", True, "a.io"), None), ("b.io", (1, "B", False, "b.io"), None), ("c.io", (5, None, None, "c.io"), None),
        ("d.io", None, "timeout"),
    ]
    old = spark.createDataFrame(
        [("9", "a.io", "stale", "1", "no"), ("42", "A.io ", " Acme ", "78", "true"), ("7", "b.io", "B", "1", "false")],
        "record_id string, domain string, name string, score string, flag string",
    )
    plan = upsert_plan(payloads(spark, rows), old, destination="hubspot", match_key="domain")
    got = {r.domain: r for r in plan.collect()}
    # two records share the key: the smaller id counts
    assert (got["a.io"].action, got["a.io"].record_id) == ("updated", "42")
    assert got["a.io"].changed_fields == ["domain", "name"] and json.loads(got["a.io"].changes)["name"] == "Acme Analytics"
    assert (got["b.io"].action, got["b.io"].changed_fields, got["b.io"].changes) == ("skipped", [], None)
    assert (got["c.io"].action, got["c.io"].changed_fields, got["c.io"].record_id) == ("created", ["domain", "score"], None)
    assert (got["d.io"].action, got["d.io"].error) == ("failed", "timeout")
    assert {r.domain for r in to_write(plan).collect()} == {"a.io", "c.io"}
    assert [(r.action, r.n) for r in report.writes_by_action(plan).collect()] == [("created", 1), ("failed", 1), ("skipped", 1), ("updated", 1)]


def test_second_upsert_writes_nothing(spark, results):
    mapping = Mapping.default()
    written = build_payloads(results, mapping, "hubspot").where("error is null")
    stored = written.select(F.concat(F.lit("R"), "domain").alias("record_id"), "properties.*")
    again = plan_writes(results, mapping, "hubspot", stored)
    assert {r.action for r in again.where("error is null").collect()} == {"skipped"}
    stale = stored.withColumn("gtm_icp_fit_score", F.lit("12"))
    updates = plan_writes(results, mapping, "hubspot", stale).where("error is null").collect()
    assert all(r.changed_fields == ["gtm_icp_fit_score"] and json.loads(r.changes) == {"gtm_icp_fit_score": 59} for r in updates)


def test_upsert_reads_only_compared_columns(spark):
    """A wide table of existing records is pruned at the scan."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    old = orders.withColumnRenamed("o_orderkey", "record_id").withColumnRenamed("o_orderpriority", "domain")
    plan = upsert_plan(payloads(spark, [("a.io", (1, "n", True, "a.io"), None)]), old, destination="x", match_key="domain")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


@pytest.mark.parametrize("rows_per_task", [1, 1_000_000])
def test_contains_match_equals_brute_force(spark, rows_per_task):
    rng = random.Random(7)
    labels = ["a", "b", "ab", "shop", "acme", "xacme", "co", "com", "io", "w" * 70, "y" + "w" * 70, "go-1"]
    name = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    domains = sorted({name(rng.choice([2, 2, 3, 4])) for _ in range(250)})
    sites = [f"https://{name(rng.choice([2, 3, 4]))}{rng.choice(['', '/', '/p.html?q=' + name(2), ':80'])}" for _ in range(300)] + ["https://acme.com/x"] * 200
    sites = [s.upper() if i % 3 else s for i, s in enumerate(sites)]
    old = spark.createDataFrame([(f"{i:05d}", s) for i, s in enumerate(sites)], "record_id string, Website string")
    wanted = spark.createDataFrame([(d,) for d in domains], "domain string").withColumn("match_value", F.concat(F.lit("https://"), "domain"))
    found = find_by_contains(wanted, old, "Website", rows_per_task=rows_per_task)
    got = {r.domain: r.id for r in found.select("domain", F.col("_found.record_id").alias("id")).collect()}
    expected = {d: min((f"{i:05d}" for i, s in enumerate(sites) if d in s.lower()), default=None) for d in domains}
    assert got == expected and sum(v is not None for v in got.values()) > 50


def test_contains_match_of_repeated_records(spark):
    """Records with one id, and equal records: one row per payload."""
    rows = [("1", "https://acme.com/a", "x"), ("1", "https://acme.com/a", "x"), ("1", "https://acme.com/a", "y"), ("1", "https://other.io", "z"),
            ("2", "https://acme.com", "w"), (None, "https://acme.com", "v")]
    old = spark.createDataFrame(rows, "record_id string, Website string, name string")
    wanted = spark.createDataFrame([("acme.com", "https://acme.com"), ("other.io", "other.io"), ("acm", "acm"), ("no", "zz")], "domain string, match_value string")
    found = find_by_contains(wanted, old, "Website").select("domain", "_found.record_id", "_found.name").collect()
    assert sorted((r.domain, r.record_id, r.name) for r in found if r.domain != "no") == [("acm", "1", "x"), ("acme.com", "1", "x"), ("other.io", "1", "z")]
    assert len(found) == 4


def test_contains_match_drops_labels_nobody_searches(spark, tmp_path):
    """Of some sixty labels a text lists, those that are not searched go before the shuffle; no scan more than twice."""
    spark.range(3000).selectExpr("cast(id as string) as record_id", "concat('https://shop', id, '.example.com/path/index.html') as Website").write.parquet(
        str(tmp_path / "old"))
    spark.createDataFrame([("shop7.example.com",)], "domain string").selectExpr("domain", "domain as match_value").write.parquet(str(tmp_path / "new"))
    old, wanted = spark.read.parquet(str(tmp_path / "old")), spark.read.parquet(str(tmp_path / "new"))
    found = find_by_contains(wanted, old, "Website")
    assert [r._found.record_id for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4


def test_row_per_key_picks_like_an_aggregate(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "a", "b", None, f"k{i % 40}"]), rng.choice([1, 2, None]), rng.choice("xyz")) for i in range(600)]
    df = spark.createDataFrame(rows * 2, "k string, at int, wide string").repartition(5)
    for last in (False, True):
        got = row_per_key(df, ["k"], ["at"], last=last)
        have = {(r.k, r.at) for r in got.collect()}
        want = {(r.k, r.at) for r in one_per_key(df.where("k is not null"), ["k"], ["at"], last=last).collect()}
        assert have == want and got.count() == len(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Aggregate.*wide", plan)


# --- hot keys --------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_lookup_join_equals_plain_join(spark, how, rows_per_task):
    rows = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 97).cast("string")).alias("k")
    )
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), ("x", 4)], "k string, v int")
    plain = rows.join(lookup, "k", how)
    spread = lookup_join(rows, lookup, ["k"], how=how, rows_per_task=rows_per_task)
    assert sorted(((r.id, r.k, r.v) for r in spread.collect()), key=repr) == sorted(((r.id, r.k, r.v) for r in plain.collect()), key=repr)


def test_lookup_join_spreads_the_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = rows.select("k").distinct().withColumn("v", F.lit(1))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = lambda df: max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
        assert sizes(rows.join(lookup, "k")) >= 1500
        assert sizes(lookup_join(rows, lookup, ["k"], rows_per_task=100)) < 1000
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_one_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, n int, v string")
    assert sorted(one_per_key(df, ["k"], ["n"]).collect()) == [("a", 1, "y"), ("b", 3, None)]
    assert sorted(one_per_key(df, ["k"], ["n"], last=True).collect()) == [("a", 2, "x"), ("b", 3, None)]
    plan = one_per_key(df, ["k"], ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


# --- reuse -----------------------------------------------------------------


def test_rerun_reuses_everything(spark, accounts, crawl_rows, results):
    profile = Profile.default()
    prior = analyses_to_keep(results, profile).cache()
    again = enrich(accounts, crawl_rows, profile, prior=prior, analyzed_at=NOW + timedelta(days=1))
    first = {r.domain: r for r in results.collect()}
    for r in again.collect():
        assert r.from_cache == r.ok and r.analysis == first[r.domain].analysis and r.provenance == first[r.domain].provenance
    other = Profile("other", "d", good_keywords=("webinar",))
    assert not any(r.from_cache for r in enrich(accounts, crawl_rows, other, prior=prior).collect())


def test_reused_and_rest_are_all_pages(spark):
    pages = spark.createDataFrame([(f"d{i}", f"h{i}") for i in range(10)], "domain string, content_hash string")
    prior = spark.createDataFrame(
        [(f"d{i}", f"h{i}", "a", "p", NOW, (i,), ("x",)) for i in range(4)] + [("d5", "old", "a", "p", NOW, (1,), ("x",)), ("d6", "h6", "b", "p", NOW, (1,), ("x",))],
        "domain string, content_hash string, analyzer string, profile string, analyzed_at timestamp, analysis struct<n:int>, provenance struct<s:string>",
    )
    hits = {r.domain for r in reuse.reuse_analyses(pages, prior, analyzer="a", profile="p").where("from_cache").collect()}
    rest = {r.domain for r in reuse.pages_to_analyse(pages, prior, analyzer="a", profile="p").collect()}
    assert hits == {"d0", "d1", "d2", "d3"} and hits | rest == {f"d{i}" for i in range(10)} and not hits & rest


def test_stale_domains(spark):
    domains = spark.createDataFrame([("a",), ("b",), ("c",)], "domain string")
    pages = spark.createDataFrame([("a", NOW - timedelta(hours=167)), ("b", NOW - timedelta(hours=169)), ("b", NOW - timedelta(hours=300))], "domain string, fetched_at timestamp")
    assert sorted(r.domain for r in reuse.stale_domains(domains, pages, NOW).collect()) == ["b", "c"]


def test_spend(spark):
    rows = [(False, (10, 5, 0.5)), (False, (1, None, None)), (True, (7, 7, None)), (True, None)]
    df = spark.createDataFrame(rows, "from_cache boolean, provenance struct<input_tokens:long,output_tokens:long,cost_usd:double>")
    fresh, reused = sorted(report.spend(df).collect(), key=lambda r: r.from_cache)
    assert (fresh.tokens, fresh.cost_usd, fresh.results) == (16, 0.5, 2)
    assert (reused.tokens, reused.cost_usd, reused.priced, reused.results) == (14, None, False, 1)


def test_field_catalogue(spark):
    rows = field_catalogue(spark, Mapping.default(), "salesforce").collect()
    assert len(rows) == 21 and ("provenance.analyzed_at", "GTM_Enriched_At__c", "datetime", "Account", "Website") in [tuple(r) for r in rows]
