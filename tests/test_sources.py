"""Account files, envelopes, sinks."""

from __future__ import annotations

import csv
import json
from datetime import timedelta

import duckdb
import pytest
from samples import NOW

from accountlake.config import Mapping
from accountlake.operators.payload import field_catalogue
from accountlake.operators.reuse import last_run, latest_pages, watermarks
from accountlake.sources import sinks
from accountlake.sources.accounts import read_account_file
from accountlake.sources.envelopes import normalise_envelopes


@pytest.mark.parametrize(("name", "text", "expected"), [
    ("a.csv", "company,domain,owner\nAcme,acme.com,me\nBeta, beta.io ,you\nGamma,,x\n", ["acme.com", "beta.io"]),
    ("a.csv", "name,Website\nAcme,https://acme.com/x\n", ["https://acme.com/x"]),
    ("a.csv", "acme.com\nbeta.io\n", ["acme.com", "beta.io"]),
    ("a.csv", "sites,x\nacme.com,1\n", ["acme.com"]),
    ("a.csv", 'name,url,domain\n"A, Inc.",u.com,d.com\n', ["d.com"]),
    ("a.csv", 'company,domain\n"Acme ""Big"", Inc",acme.com\n', ["acme.com"]),
    ("a.txt", "# comment\n\nacme.com\n  beta.io \n", ["acme.com", "beta.io"]),
])
def test_account_files(spark, tmp_path, name, text, expected):
    path = tmp_path / name
    path.write_text(text)
    rows = read_account_file(spark, str(path)).orderBy("ord").collect()
    assert [r.domain for r in rows] == expected and {r.source for r in rows} == {"file"}
    assert read_account_file(spark, str(path), limit=1).count() == 1


MD = "# Acme\n\n[Pricing](/pricing)"
NESTED = {"success": True, "data": {
    "markdown": MD, "html": "<h1>clean</h1>", "rawHtml": "<h1>raw</h1>",
    "metadata": {"title": "Acme", "description": "D", "statusCode": 200, "sourceURL": "https://acme.example/", "url": "https://www.acme.example/"},
}}
RESULT = {"success": True, "status_code": 200, "url": "https://acme.example/", "markdown": MD, "raw_html": "<h1>Acme</h1>", "metadata": {"title": "Acme"}}
ITEM = {"url": "https://acme.example/", "loadedUrl": "https://www.acme.example/", "markdown": MD, "html": "<p>x</p>", "metadata": {"title": "Acme"}}


def read(spark, envelope, body):
    text = body if isinstance(body, str) else json.dumps(body)
    df = spark.createDataFrame([("https://asked.example/", text)], "url string, body string")
    return normalise_envelopes(df, envelope).first()


def test_nested_envelope(spark):
    r = read(spark, "firecrawl", NESTED)
    assert (r.final_url, r.html, r.markdown, r.title, r.description) == ("https://www.acme.example/", "<h1>raw</h1>", MD, "Acme", "D")
    listed = {"data": {**NESTED["data"], "rawHtml": None, "metadata": {"title": ["A", "B"], "sourceURL": "https://s/"}}}
    r = read(spark, "firecrawl", listed)
    assert (r.title, r.html, r.final_url, r.status_code) == ("A", "<h1>clean</h1>", "https://s/", 200)


@pytest.mark.parametrize("wrap", [lambda r: {"success": True, "results": [r]}, lambda r: r, lambda r: [r]])
def test_result_envelopes(spark, wrap):
    r = read(spark, "crawl4ai", wrap(RESULT))
    assert (r.markdown, r.title, r.html, r.fetch_error) == (MD, "Acme", "<h1>Acme</h1>", None)
    r = read(spark, "crawl4ai", wrap({**RESULT, "markdown": {"raw_markdown": MD, "fit_markdown": "short"}}))
    assert r.markdown == MD


def test_item_envelope(spark):
    r = read(spark, "apify", [ITEM])
    assert (r.final_url, r.title, r.html, r.status_code) == ("https://www.acme.example/", "Acme", "<p>x</p>", 200)
    assert read(spark, "apify", [{"url": "https://a/", "text": "t"}]).markdown == "t"


@pytest.mark.parametrize(("envelope", "body", "problem"), [
    ("firecrawl", {"success": False}, "reported failure"), ("firecrawl", {"data": {}}, "no content"), ("firecrawl", "nope", "not JSON"),
    ("crawl4ai", {"results": []}, "no content"), ("crawl4ai", [{"success": False}], "reported failure"), ("apify", [], "no content"),
])
def test_bad_envelopes(spark, envelope, body, problem):
    r = read(spark, envelope, body)
    assert problem in r.fetch_error and r.final_url == "https://asked.example/"


def test_payload_files(spark, tmp_path):
    df = spark.createDataFrame(
        [("a.io", "companies", "domain", "a.io", ("A, \"Inc\"", None, "a.io"), None), ("b.io", "companies", "domain", None, None, "failed")],
        "domain string, object_type string, match_key string, match_value string, properties struct<name:string,score:int,domain:string>, error string",
    )
    sinks.write_payloads_json(df, str(tmp_path / "json"))
    lines = [json.loads(x) for f in (tmp_path / "json").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"domain": "a.io", "object_type": "companies", "match_key": "domain", "match_value": "a.io", "properties": {"name": 'A, "Inc"', "domain": "a.io"}}]
    sinks.write_payloads_flat(df, str(tmp_path / "csv"))
    rows = [r for f in (tmp_path / "csv").glob("*.csv") for r in csv.DictReader(f.open())]
    assert rows == [{"domain": "a.io", "name": 'A, "Inc"', "score": ""}]


def test_results_file(spark, tmp_path):
    results = spark.createDataFrame([("a.io", (1, ["x"]))], "domain string, analysis struct<n:int,xs:array<string>>")
    sinks.write_results_json(results, spark.createDataFrame([("a.io", "created")], "domain string, action string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/results")).first().analysis.xs == ["x"]
    assert spark.read.json(str(tmp_path / "r/writes")).first().action == "created"


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    schema = "domain string, markdown string, fetched_at timestamp"
    for days, text in ((0, "new"), (3, "old"), (30, "ancient")):
        sinks.write_snapshot(spark.createDataFrame([("a.io", text, NOW - timedelta(days=days))], schema), path)
    assert latest_pages(sinks.read_snapshot(spark, path)).first().markdown == "new"
    recent = sinks.read_snapshot(spark, path, NOW - timedelta(days=7))
    assert sorted(r.markdown for r in recent.collect()) == ["new", "old"]
    assert "PartitionFilters: [isnotnull(fetch_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_run_log_keeps_the_last_recorded_start(spark, tmp_path):
    path = str(tmp_path / "runs")
    day = timedelta(days=1)
    sinks.append_run_log(spark, path, "k", NOW + 5 * day, 10, NOW)
    sinks.append_run_log(spark, path, "k", NOW + 2 * day, 20, NOW + day)
    sinks.append_run_log(spark, path, "other", NOW, 1, NOW)
    log = sinks.read_run_log(spark, path)
    got = {r.key: r.records for r in watermarks(log).collect()}
    assert got == {"k": 20, "other": 1}
    assert last_run(log, "k") == (NOW + 2 * day).replace(tzinfo=None)
    assert last_run(log, "never") is None


def test_scratch_goes_to_the_shared_folder(spark):
    from accountlake.spark import shared_dir

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    first, second = shared_dir(spark, "a"), shared_dir(spark, "a")
    root = root or spark.sparkContext.getCheckpointDir()
    assert first.startswith(root) and first != second


def test_a_folder_of_files_is_read_in_order(spark, tmp_path):
    folder = tmp_path / "list.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("domain\nfirst.com\n")
    (folder / "2.csv").write_text("domain\n" + "".join(f"d{i}.com\n" for i in range(50)))
    rows = sorted((r.ord, r.domain) for r in read_account_file(spark, str(folder)).collect())
    assert rows == list(enumerate(["first.com", *[f"d{i}.com" for i in range(50)]]))
    assert [r.domain for r in read_account_file(spark, str(folder), limit=2).collect()] == ["first.com", "d0.com"]


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('name,domain\n"two\nlines",acme.com\nx,beta.io\n')
    assert [r.domain for r in read_account_file(spark, str(path), multiline=True).orderBy("ord").collect()] == ["acme.com", "beta.io"]


def test_every_file_of_a_folder_has_its_own_header(spark, tmp_path):
    """Another column in each file, quoted names, no header at all, an empty file."""
    folder = tmp_path / "lists.csv"
    folder.mkdir()
    for name, text in {
        "a.csv": "Name,Domain\nAcme,acme.com\nBeta,beta.io\n", "b.csv": 'url,"name, full"\nhttps://c.org/x,"C, Inc."\n',
        "c.csv": "d.net,first\ne.net,second\n", "d.csv": "company\nplain\n", "e.csv": "", "f.csv": 'id,"website"\n7,"f.com"\n8,\n',
    }.items():
        (folder / name).write_text(text)
    got = [r.domain for r in read_account_file(spark, str(folder)).orderBy("ord").collect()]
    assert got == ["acme.com", "beta.io", "https://c.org/x", "d.net", "e.net", "plain", "f.com"]


def test_every_field_of_the_catalogue_is_counted(spark, tmp_path):
    """A row per field, filled or not: vendors in assets, notes on thin pages, pages without markup, failed pages, ids that repeat."""
    from suite import ORACLE, QUERIES

    page = "<html><head><title>Co</title>{}</head><body><article>" + "<p>words of a page that goes on</p>" * 40 + "{}</article></body></html>"
    rows = [
        (1, "https://a.example.com/1", page.format("", "")),
        (2, "https://b.example.com/2", page.format('<script async src="//cdn.segment.com/v2/k.js"></script><link rel="x" href=/wp-content/a.css>', "eaux der Ein")),
        (2, "https://b.example.com/2", page.format("", '<a href="/in/us">We</a>')),
        (3, "https://c.example.com/3", "<html><body><p>Thin nicht</p></body></html>"),
        (4, "https://d.example.com/4", None), (5, "https://e.example.com/5#top", page.format('<img src="https://js.stripe.com/x">', "")), (6, None, page.format("", "")),
    ]
    pages = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(pages)
    got = {(r.source, r.property): r.filled for r in QUERIES["field_fill"](spark, str(tmp_path)).collect()}
    catalogue = field_catalogue(spark, Mapping.default(), "hubspot").collect()
    some = {"gtm_industries_served": 4, "gtm_buying_signals": 2, "gtm_disqualifiers": 2, "gtm_tech_signals": 1}
    assert got == {(f.source, f.property): some.get(f.property, 5) for f in catalogue} and len(got) == 21
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{pages}/*.parquet')")
    assert {(source, name): n for name, source, n in con.execute(ORACLE["field_fill"]).fetchall()} == got
