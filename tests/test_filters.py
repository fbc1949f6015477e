"""Filters: validation, predicates, equivalent forms."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from accountlake.config import Condition, ConfigError, FilterError, FilterSpec, Mapping, Profile
from accountlake.operators.predicates import apply_filter, condition_problem, dnf_filter, modified_since, predicate, preflight, preview, to_dnf
from accountlake.sources.accounts import read_accounts

NOW = datetime(2026, 9, 10, 12, tzinfo=timezone.utc)
COLUMNS = "record_id string, domain string, lifecycle string, enriched_at timestamp, score int"


@pytest.fixture(scope="module")
def accounts(spark):
    days = lambda n: NOW - timedelta(days=n)
    rows = [
        ("1", "a.com", "customer", days(100), 10), ("2", "b.com", "lead", days(10), None), ("3", "c.com", None, None, 30),
        ("4", None, "lead", None, 40), ("5", "", "other", days(200), 50), ("6", "100%_off.com", "evangelist", days(91), -1),
    ]
    return spark.createDataFrame(rows, COLUMNS).cache()


def ids(df):
    return sorted(r.record_id for r in df.collect())


def match(accounts, *conditions, **kw):
    return ids(apply_filter(accounts, FilterSpec("t", conditions, **kw), now=NOW))


@pytest.mark.parametrize(("cond", "expected"), [
    (Condition("lifecycle", "equals", "lead"), "24"),
    (Condition("lifecycle", "not_equals", "lead"), "156"),
    (Condition("lifecycle", "is_known"), "12456"),
    (Condition("lifecycle", "is_unknown"), "3"),
    (Condition("lifecycle", "in", ["lead", "other"]), "245"),
    (Condition("lifecycle", "in", "lead"), "24"),
    (Condition("lifecycle", "not_in", ["customer", "evangelist", "other"]), "24"),
    (Condition("lifecycle", "not_in", ["customer", "evangelist", "other"], True), "234"),
    (Condition("score", "greater_than", 10), "345"),
    (Condition("score", "less_than", 10), "6"),
    (Condition("domain", "contains", "%_"), "6"),
    (Condition("domain", "contains", "b.c"), "2"),
    (Condition("enriched_at", "older_than_days", 90), "156"),
    (Condition("enriched_at", "older_than_days", 90, True), "13456"),
    (Condition("enriched_at", "newer_than_days", 90.5), "2"),
    (Condition("lifecycle", "is_known", None, True), "12456"),
])
def test_conditions(accounts, cond, expected):
    assert match(accounts, cond) == list(expected)


def test_all_conditions_and_none(accounts):
    assert match(accounts, Condition("lifecycle", "equals", "lead"), Condition("domain", "is_known")) == ["2"]
    assert len(match(accounts)) == 6


@pytest.mark.parametrize("bad", [
    dict(field="x", op="sort_of_equals", value=1), dict(field="x", op="is_known", value="y"), dict(field="x", op="equals"),
    dict(field="x", op="older_than_days", value="ninety"),
])
def test_bad_conditions(bad):
    with pytest.raises(FilterError):
        Condition(**bad)


@pytest.mark.parametrize("bad", [{}, {"name": "x", "filters": ["y"]}, {"name": "x", "fields": {"a": "b"}}])
def test_bad_specs(bad):
    with pytest.raises(FilterError):
        FilterSpec.from_dict(bad)


def test_aliases():
    spec = FilterSpec("t", fields={"website": {"hubspot": "domain", "salesforce": "Website"}, "x": {"hubspot": "x_hs"}})
    assert spec.column("website", "salesforce") == "Website"
    assert spec.column("num_contacts", "hubspot") == "num_contacts"
    with pytest.raises(FilterError, match="no name for system 'salesforce'"):
        spec.column("x", "salesforce")
    with pytest.raises(FilterError, match="not a column name"):
        spec.column("1=1; drop", "hubspot")


def test_raw_text_and_groups_replace_conditions(accounts):
    never = Condition("lifecycle", "equals", "nobody")
    assert match(accounts, never, raw={"table": "score > 10 and domain is not null"}) == ["3", "5"]
    spec = FilterSpec.from_dict({"name": "g", "raw": {"table": {"filterGroups": [
        {"filters": [{"propertyName": "domain", "operator": "HAS_PROPERTY"}, {"propertyName": "score", "operator": "LT", "value": 0}]},
        {"filters": [{"propertyName": "lifecycle", "operator": "IN", "values": ["lead"]}]},
    ]}}})
    assert ids(apply_filter(accounts, spec, now=NOW)) == ["2", "4", "6"]


def test_modified_since_narrows_raw_filters_too(accounts):
    raw = apply_filter(accounts, FilterSpec("t", raw={"table": "score > 0"}), now=NOW)
    assert ids(modified_since(raw, "enriched_at", NOW - timedelta(days=150))) == ["1"]
    assert ids(modified_since(raw, "enriched_at", None)) == ids(raw)


def test_too_many_alternatives():
    five = tuple(Condition("website", "equals", str(i), True) for i in range(5))
    with pytest.raises(FilterError, match="32 groups"):
        to_dnf(FilterSpec("t", five))
    assert len(to_dnf(FilterSpec("t", five[:4]))) == 16


conditions = st.one_of(
    st.builds(Condition, st.just("lifecycle"), st.sampled_from(["equals", "not_equals", "in", "not_in"]), st.sampled_from(["lead", "customer", "zzz"]), st.booleans()),
    st.builds(Condition, st.just("score"), st.sampled_from(["greater_than", "less_than", "equals"]), st.integers(-1, 50), st.booleans()),
    st.builds(Condition, st.sampled_from(["domain", "enriched_at"]), st.sampled_from(["is_known", "is_unknown"]), st.none(), st.booleans()),
    st.builds(Condition, st.just("enriched_at"), st.sampled_from(["older_than_days", "newer_than_days"]), st.integers(1, 250), st.booleans()),
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(conditions, max_size=4))
def test_alternatives_select_the_same_rows(accounts, conds):
    spec = FilterSpec("t", tuple(conds))
    assert ids(apply_filter(accounts, dnf_filter(spec), now=NOW)) == ids(apply_filter(accounts, spec, now=NOW))


def test_preflight_and_preview(accounts):
    spec = FilterSpec("t", (Condition("region", "is_known"), Condition("score", "equals", 1)))
    assert preflight(accounts, spec, domain_col="website") == ["region", "website"]
    assert preflight(accounts, FilterSpec("t", raw={"table": "owner = 'x' and score > 1"})) == ["owner"]
    assert preview(accounts, spec)[1] is None
    missing, rows = preview(accounts, FilterSpec("t"), 2)
    assert missing == [] and rows.count() == 2


def test_read_accounts_limits_after_dropping_empty_domains(accounts):
    spec = FilterSpec("t", limit=3)
    got = read_accounts(accounts, spec, record_id="record_id", properties=("score",), now=NOW)
    assert got.columns == ["record_id", "domain", "source", "score"]
    assert got.count() == 3 and got.where("domain is null or domain = ''").count() == 0
    assert read_accounts(accounts, spec, limit=0).count() == 4


def test_filters_reach_the_scan(spark):
    customers = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spec = FilterSpec("t", (Condition("o_orderpriority", "not_in", ["5-LOW", "1-URGENT"]), Condition("o_orderdate", "older_than_days", 90, True)))
    plan = apply_filter(customers, spec, now=NOW).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "Not(In(o_orderpriority" in pushed and "Or(LessThan(o_orderdate" in pushed


def test_predicate_is_a_plain_column(spark, accounts):
    assert accounts.where(predicate(FilterSpec("t", (Condition("score", "greater_than", 35),)))).count() == 2


# --- configuration files ---------------------------------------------------


def test_yaml_files(tmp_path):
    (tmp_path / "f.yaml").write_text("name: n\nfilters:\n  - {field: a, op: in, value: [1, 2], or_unknown: true}\nlimit: 7\n")
    spec = FilterSpec.load(tmp_path / "f.yaml")
    assert spec.conditions == (Condition("a", "in", [1, 2], True),) and spec.limit == 7
    (tmp_path / "p.yaml").write_text("name: n\ndescription: d\nheuristic_keywords: {good: [Webinar]}\n")
    assert Profile.load(tmp_path / "p.yaml").good_keywords == ("webinar",)
    (tmp_path / "m.yaml").write_text("objects: {crm: X}\nmatch_keys: {crm: domain}\nfields:\n  - {source: domain, crm: d}\n")
    assert Mapping.load(tmp_path / "m.yaml").property_names("crm") == ["d"]
    for name, text in (("a", "- 1"), ("b", "x: [")):
        (tmp_path / f"{name}.yaml").write_text(text)
        with pytest.raises(ConfigError):
            Profile.load(tmp_path / f"{name}.yaml")
    with pytest.raises(ConfigError):
        Mapping.load(tmp_path / "absent.yaml")
    with pytest.raises(ConfigError):
        Profile.from_dict({"name": "x"})


def test_profile_fingerprint_follows_prose_and_keywords():
    a = Profile("n", "d", good_keywords=("x",))
    b = Profile("n", "d", good_keywords=("y",))
    assert a.fingerprint() == b.fingerprint()
    assert a.fingerprint(with_keywords=True) != b.fingerprint(with_keywords=True)
    assert a.fingerprint() != Profile("n", "e").fingerprint()


def test_no_limit_unless_written(accounts):
    assert FilterSpec.from_dict({"name": "n"}).limit == 0


def test_all_missing_columns_are_named(spark):
    names = [f"c{i}" for i in range(120)]
    spec = FilterSpec("t", raw={"table": " AND ".join(f"{n} = 1" for n in names)})
    assert preflight(spark.range(1).withColumnRenamed("id", "domain"), spec) == sorted(names)


def test_problems_of_a_section_are_told_at_once():
    with pytest.raises(ConfigError, match="name.*description"):
        Profile.from_dict({"good_fit": ["a"]})
    with pytest.raises(ConfigError, match="a list is needed"):
        Mapping.from_dict({"objects": {}, "match_keys": {}, "fields": "x"})


@pytest.mark.parametrize("value", [None, 5, 2.5, "5", True, [1, 2], [], ""])
@pytest.mark.parametrize("op", ["equals", "is_known", "is_unknown", "in", "older_than_days", "newer_than_days", "like"])
def test_table_of_conditions_is_judged_like_conditions(one, op, value):
    try:
        Condition("a", op, value)
        want = None
    except FilterError as exc:
        want = str(exc)
    assert one(condition_problem("op", "value"), op=op, value=json.dumps(value)) == want
