"""Keyword analysis, probes, answers."""

from __future__ import annotations

import json
from dataclasses import replace

import pytest
from samples import NOW
from pyspark.sql import functions as F

from accountlake import vocab
from accountlake.config import Profile
from accountlake.functions import scoring as S
from accountlake.functions import text as T
from accountlake.functions import usage
from accountlake.operators import answers as A
from accountlake.operators.analysis import analyse
from accountlake.operators.pages import build_pages, with_signals
from accountlake.operators.verdicts import calibrate, path_verdicts
from accountlake.plans.probe import probe_paths


@pytest.fixture(scope="module")
def page(spark):
    from samples import HOMEPAGE

    df = spark.createDataFrame(
        [("acme.example", "https://acme.example/", HOMEPAGE, 200, NOW)],
        "domain string, final_url string, html string, status_code int, fetched_at timestamp",
    )
    return with_signals(build_pages(df)).cache()


def test_analysis_of_the_sample_page(page):
    r = analyse(page, Profile.default(), analyzed_at=NOW).first()
    a = r.analysis
    assert a.company_name == "Ladle Metrics" and a.category == "analytics" and a.sells_to == "B2B"
    assert a.business_model == "SaaS" and a.primary_cta == "Book a demo" and a.segment == "Enterprise"
    assert a.one_liner.startswith("Ladle Metrics tells") and a.confidence <= 0.4
    assert a.buying_signals == ["Careers page is live (hiring)"]
    assert [e.claim for e in a.evidence] == ["one_liner", "category"]
    assert r.provenance.analyzer == "heuristic:v1" and r.provenance.content_hash == r.content_hash


def test_poor_fit_terms_cost_points(page):
    neutral = Profile("t", "d", good_keywords=("webinar",))
    rival = replace(neutral, poor_keywords=("kitchen analytics",))
    base, docked = (analyse(page, p).first().analysis for p in (neutral, rival))
    assert (base.icp_fit_score, docked.icp_fit_score) == (85, 70)
    assert docked.disqualifiers[0] == "Poor-fit ICP terms present: kitchen analytics"


def test_thin_page(page):
    a = analyse(page.withColumn("markdown", F.lit("# Coming soon")), Profile.default()).first().analysis
    assert a.confidence == 0.2 and any("thin" in d for d in a.disqualifiers)


def test_bigrams_of_prose(spark, one):
    bullets = ["consumer social or entertainment streaming", "a video platform, of video-hosting for teams; x:y z"]
    keys = S.profile_bigrams(bullets)
    assert keys[0] == ["consumer social", "social entertainment", "entertainment streaming"]
    assert keys[1] == ["video hosting", "y z"]
    assert [one(S.bullet_bigrams("b"), b=b) for b in bullets] == keys


def test_prose_profile_scores_per_bullet(page):
    profile = Profile("t", "d", good_fit=("ladle metrics tells", "nothing here fits"), poor_fit=("went back there",))
    a = analyse(page, profile).first().analysis
    assert a.icp_fit_score == 50 + 28 - 15 and "1 good-fit and 1 poor-fit" in a.icp_fit_rationale


def test_no_keywords_scores_fifty(page):
    assert analyse(page, Profile("t", "d")).first().analysis.icp_fit_score == 50


@pytest.mark.parametrize(("hits", "total"), [(1, 7), (3, 8), (5, 16), (2, 3), (7, 13)])
def test_score_rounds_like_python(one, hits, total):
    good = T.strings(["x"] * hits)
    assert one(S.fit_score(good, T.strings(()), total)) == 50 + round(35 * min(hits / total * 1.6, 1.0))


def test_category_ties_and_minimum(one):
    table = {"first": ("aa",), "second": ("bb",)}
    assert one(S.category("t", table), t="aa bb aa bb") == "first"
    assert one(S.category("t", table), t="aa bb bb") == "second"
    assert one(S.category("t", table), t="aa bb") == "unknown"


@pytest.mark.parametrize(("title", "expected"), [
    ("Delta | The Signal Marketing Platform", "Delta"), ("Long name here – Gong", "Gong"), ("Just one title", "Just one title"),
    ("ab - cd", "ab"), (" | x", "Acme"), (None, "Acme"), ("y" * 61, "Acme"),
])
def test_company_name(one, title, expected):
    assert one(T.company_name(F.lit(title).cast("string"), "d"), d="acme.example") == expected


def test_first_paragraph(one):
    text = "# Head\n\nhttp://" + "x" * 50 + "\n\n**" + "word " * 10 + "**\n\n" + "z" * 60
    assert one(T.first_paragraph("t"), t=text) == ("word " * 10).strip()
    assert one(T.first_paragraph("t"), t="short") == ""


def test_bands(one):
    assert [one(usage.score_band(F.lit(n))) for n in (70, 69, 45, 44)] == ["green", "yellow", "yellow", "red"]


# --- probes ----------------------------------------------------------------

NOT_FOUND = (
    "Acme\n\nWe couldn't find that page. Try the homepage, or browse our product, pricing, and customers sections. "
    "Contact support if you think this is a mistake. Popular links: docs, changelog, status."
)
SOFT = (
    "Acme\n\nProduct Platform Solutions Customers Docs Company\n\nBuild faster with Acme. The platform teams trust to ship software. "
    "Join thousands of teams already building with Acme.\n\nGet started Contact sales\n\nCompany About Careers Blog Press Legal Privacy Terms Security Status"
)
PRICING = (
    "Acme Pricing\n\nSimple plans that scale with your team.\n\nStarter $19 per month per user, billed annually. Includes unlimited projects, "
    "integrations, and email support.\n\nGrowth $49 per month per user. Adds SSO, audit logs, advanced analytics, and a dedicated success manager.\n\n"
    "Enterprise: contact sales for custom billing, procurement, and SLAs. Every plan starts with a 14 day free trial, no card required."
)
WALL = "Acme\n\nYou're almost there! Sign in to see this page in your workspace. Continue with Google, Apple, or SSO. New user? Sign up free today."
TALK = "Acme blog: ten ways to run a better standup meeting. " * 6

CASES = [
    # control (status, error, text), candidate (path, final_url, status, error, text), verdict, confidence, part of the reason
    ((200, None, SOFT), ("/x", "u/x", 200, None, SOFT), "missing", 0.95, "soft 404: 1.00"),
    ((200, None, SOFT), ("/pricing", "u/pricing", 200, None, PRICING), "exists", 0.95, "on-topic"),
    ((404, None, None), ("/pricing", "u/pricing", None, "HTTP 404", None), "missing", 0.9, "fetch failed: HTTP 404"),
    ((None, "refused", None), ("/pricing", "u/pricing", 410, None, PRICING), "missing", 0.98, "HTTP 410"),
    ((200, None, SOFT), ("/pricing", "u/pricing", 200, None, WALL), "gated", 0.85, "login wall ('sign in to')"),
    ((200, None, SOFT), ("/pricing", "u/", 200, None, PRICING), "missing", 0.95, "homepage"),
    ((200, None, "Acme"), ("/pricing", "u/pricing", 200, None, NOT_FOUND), "missing", 0.9, "not-found copy (\"couldn't find\")"),
    ((200, None, SOFT), ("/pricing", "u/pricing", 200, None, "Pricing"), "missing", 0.8, "only 7 chars"),
    ((200, None, "Acme"), ("/x", "u/x", 200, None, PRICING), "exists", 0.5, "cannot be ruled out"),
    ((200, None, SOFT), ("/pricing", "u/pricing", 200, None, TALK), "exists", 0.6, "off-topic"),
    ((200, None, SOFT), ("/other", "u/other", 200, None, TALK), "exists", 0.8, "real page"),
]


@pytest.mark.parametrize("rows_per_task", [1, 1_000_000])
def test_path_verdicts(spark, rows_per_task):
    controls = spark.createDataFrame(
        [(f"s{i}", c[0], c[1], c[2]) for i, (c, *_) in enumerate(CASES)], "domain string, status_code int, fetch_error string, text string"
    )
    candidates = spark.createDataFrame(
        [(f"s{i}", p, u.replace("u/", f"https://s{i}/"), s, e, t) for i, (_, (p, u, s, e, t), *_) in enumerate(CASES)],
        "domain string, path string, final_url string, status_code int, fetch_error string, text string",
    )
    got = {r.domain: r for r in path_verdicts(candidates, controls, rows_per_task=rows_per_task).collect()}
    assert len(got) == len(CASES)
    for i, (_, _, verdict, confidence, reason) in enumerate(CASES):
        r = got[f"s{i}"]
        assert (r.verdict, r.confidence) == (verdict, confidence) and reason in r.reason, r


def test_calibration(spark):
    rows = [("a", 404, None, SOFT), ("b", 200, None, SOFT), ("c", 200, None, "Acme"), ("d", None, "timeout", None)]
    got = {r.domain: r for r in calibrate(spark.createDataFrame(rows, "domain string, status_code int, fetch_error string, text string")).collect()}
    assert [got[d].mode for d in "abcd"] == ["honest_404", "soft_404", "soft_404_blind", "honest_404"]
    assert got["b"].control_tokens and got["c"].control_tokens is None


def test_probe_paths_asks_every_path_of_every_site(spark):
    controls = spark.createDataFrame([("a.io", 200, None, SOFT), ("b.io", 404, None, None)], "domain string, status_code int, fetch_error string, text string")
    crawl = spark.createDataFrame(
        [("https://a.io/pricing", "https://a.io/pricing", 200, None, NOW, PRICING, None), ("https://b.io/careers", "https://b.io/careers", 200, None, NOW, "", "<p>x</p>")],
        "url string, final_url string, status_code int, fetch_error string, fetched_at timestamp, markdown string, html string",
    )
    got = {(r.domain, r.path): r for r in probe_paths(controls, crawl).collect()}
    assert len(got) == 2 * len(vocab.PATH_TOPICS)
    assert got["a.io", "/pricing"].verdict == "exists"
    assert got["b.io", "/careers"].reason == "only 8 chars of content"
    assert "no answer" in got["b.io", "/plans"].reason


# --- answers ---------------------------------------------------------------

GOOD = {
    "company_name": "Acme", "one_liner": "x", "category": "analytics", "sells_to": "B2B", "segment": "Mid-Market", "business_model": "SaaS",
    "industries_served": ["software"], "icp_fit_score": 78, "icp_fit_rationale": "r", "buying_signals": [], "disqualifiers": [],
    "primary_cta": "Book a demo", "confidence": 0.82, "evidence": [{"claim": "category", "quote": "q"}],
}


@pytest.mark.parametrize(("change", "problem"), [
    ({}, None),
    ({"icp_fit_score": 101}, "icp_fit_score: out of range"),
    ({"confidence": -0.1}, "confidence: out of range"),
    ({"segment": "Huge"}, "segment: not an allowed value"),
    ({"industries_served": list("abcdefghi")}, "industries_served: too many entries"),
    ({"mood": 1}, "mood: unknown field"),
    ({"category": None}, "category: missing or wrong type"),
    ({"icp_fit_score": "high"}, "icp_fit_score: missing or wrong type"),
    ({"icp_fit_score": 78.5}, "icp_fit_score: missing or wrong type"),
    ({"icp_fit_score": 78.0}, None),
    ({"icp_fit_score": "78"}, None),
    ({"confidence": "0.5"}, None),
    ({"company_name": 5}, "company_name: missing or wrong type"),
    ({"industries_served": [None]}, "industries_served: missing or wrong type"),
    ({"industries_served": "x"}, "industries_served: missing or wrong type"),
    ({"buying_signals": [1, 2]}, "buying_signals: missing or wrong type"),
    ({"evidence": [{"claim": "c"}]}, "evidence: missing or wrong type"),
    ({"evidence": [{"claim": "c", "quote": 1}]}, "evidence: missing or wrong type"),
    ({"evidence": [{"claim": "c", "quote": "q", "more": 1}]}, None),
    ({"evidence": []}, None),
])
def test_answer_validation(spark, change, problem):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "answer string")
    r = A.validate_answers(df).first()
    assert r.valid is (problem is None) and r.violations == ([problem] if problem else [])
    assert (r.analysis is None) is (problem is not None)


@pytest.mark.parametrize("text", ["", "not json", "[1]", '{"company_name":', None])
def test_answers_that_are_no_object(spark, text):
    r = A.validate_answers(spark.createDataFrame([(text,)], "answer string")).first()
    assert not r.valid and r.violations == ["answer: not a JSON object"]


def test_usage_and_cost(spark):
    rows = [
        ("openai", "gpt-5-mini", 5000, 1000, 600), ("anthropic", "claude-opus-5", 4000, 500, 500), ("openai", "gpt-6-experimental", 5000, 0, 1),
        ("openai", "gpt-5", 10, 50, 0),
    ]
    df = spark.createDataFrame(rows, "provider string, model string, input_tokens long, cached_tokens long, output_tokens long")
    a, b, c, d = A.price(df).collect()
    assert a.billed_input_tokens == 5000 and a.cost_usd == pytest.approx(0.00245)
    assert b.billed_input_tokens == 4500 and b.cost_usd == pytest.approx(0.0225 + 0.0125)
    assert c.billed_input_tokens == 5000 and c.cost_usd is None
    assert d.billed_input_tokens == 50


def test_fallback_to_keywords(spark, page):
    analysed = analyse(page, Profile.default(), analyzed_at=NOW)
    key = analysed.select("domain", "content_hash").first()
    columns = "domain string, content_hash string, answer string, provider string, model string, input_tokens long, cached_tokens long, output_tokens long"

    def run(hash_, answer):
        answers = spark.createDataFrame([(key.domain, hash_, answer, "openai", "gpt-5", 100, 0, 10)], columns)
        return A.with_fallback(analysed, answers, analyzed_at=NOW).first()

    good = run(key.content_hash, json.dumps(GOOD))
    assert good.analysis.icp_fit_score == 78 and good.provenance.analyzer == "openai:gpt-5" and good.provenance.input_tokens == 100
    for r in (run(key.content_hash, "{}"), run("other", json.dumps(GOOD))):
        assert r.analysis.company_name == "Ladle Metrics" and r.provenance.analyzer == "heuristic:v1" and r.provenance.cost_usd is None


def test_prompts(page):
    r = A.prompts(page, Profile.default()).first()
    assert "ICP: B2B video platform ICP" in r.system and "Strong fit signals:\n- B2B SaaS" in r.system
    assert r.user.startswith("Analyze the homepage of acme.example.\n") and "detected_vendors: HubSpot, Segment, WordPress\n" in r.user
    assert "has_blog: false\nhas_careers_page: true\n" in r.user and "{" not in r.user.split("<homepage_markdown>")[0]


def test_lists_are_whole_unless_a_limit_is_asked_for(spark):
    names = [f"area{c}" for c in "abcdefghijkl"]
    row = spark.range(1).select(F.lit(" ".join(names)).alias("raw"), F.array(*map(F.lit, names)).alias("poor"),
                                F.struct(F.lit(False).alias("has_careers_page")).alias("signals"))
    got = row.select(
        S.industries("raw", names).alias("all"), S.industries("raw", names, 8).alias("some"),
        S.buying_signals("raw", "signals", {n: f"note {n}" for n in names}).alias("notes"),
        S.disqualifiers("poor", "raw").alias("why")).first()
    assert got["all"] == names and got["some"] == names[:8]
    assert len(got["notes"]) == 12 and all(n in got["why"][0] for n in names)
