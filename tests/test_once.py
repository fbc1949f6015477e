"""What is costly is done once: pages behind a probe, analysed pages with answers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from accountlake.plans.probe import probe_paths

LONG = "words of a page that is really there, and many more of them " * 5


def counted(spark):
    """A costly step, and how many rows it was run for."""
    runs = spark.sparkContext.accumulator(0)

    def step(text):
        runs.add(1)
        return text

    return F.udf(step, "string").asNondeterministic(), runs


def test_a_probe_makes_the_text_of_every_page_once(spark):
    step, runs = counted(spark)
    sites = [f"s{i}.example" for i in range(6)]
    controls = spark.createDataFrame(
        [(s, 200, None, "nothing to be found under this address " * 4) for s in sites], "domain string, status_code int, fetch_error string, text string")
    crawl = spark.createDataFrame(
        [(f"https://{s}/pricing", f"https://{s}/pricing", 200, None, datetime(2024, 1, day), LONG, None) for s in sites for day in (1, 2)],
        "url string, final_url string, status_code int, fetch_error string, fetched_at timestamp, markdown string, html string")
    judged = probe_paths(controls, crawl.withColumn("markdown", step("markdown")), {"/pricing": ("words",)}).collect()
    assert {(r.domain, r.verdict) for r in judged} == {(s, "exists") for s in sites}
    assert runs.value == 12


def test_pages_with_answers_are_analysed_once(spark, tmp_path):
    from suite import QUERIES

    page = "<html><head><title>Co {0}</title></head><body><article>" + "<p>und die eau the tion {0}</p>" * 30 + "</article></body></html>"
    pages = [(i, f"https://h{i}.example.com/en/{i}", page.format(i)) for i in range(4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    merged = QUERIES["with_fallback"](spark, str(tmp_path))
    assert not [f for f in merged.inputFiles() if "pages.parquet" in f]
    got = {r.page_id: r for r in merged.collect()}
    assert {i: r.analyzer for i, r in got.items()} == {0: "openai:gpt-5", 1: "openai:gpt-5", 2: "heuristic:v1", 3: "heuristic:v1"}
    assert got[1].score == 1 and got[2].cost is None
