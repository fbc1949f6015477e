"""Soft-404 checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountlake.functions import probing as P
from accountlake.functions import urls as U
from accountlake.functions.text import content_hash, first_marker, token_overlap, tokens
from accountlake.operators.keys import lookup_join, one_per_key
from accountlake.operators.verdicts import calibrate, path_verdicts
from accountlake.plans.probe import probe_paths
from suite.pages import rendered
from suite.registry import query, table
from suite.sqltext import TEXT, TITLE

TOKENS_SQL = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9'']{{3,}}'))"
OVERLAP_SQL = (
    "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / "
    "(len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
)


@query("tokens", f"""
SELECT doc_id, len(t)::BIGINT AS n, substr(sha256(array_to_string(list_sort(t), ' ')), 1, 16) AS digest
FROM (SELECT doc_id, {TOKENS_SQL.format('text')} AS t FROM documents)""")
def tokens_query(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", tokens("text").alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), content_hash(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("token_overlap", f"""
WITH t AS (SELECT doc_id, lang, {TOKENS_SQL.format('text')} AS a FROM documents),
     f AS (SELECT lang, arg_min(a, doc_id) AS b FROM t GROUP BY lang)
SELECT doc_id, round({OVERLAP_SQL.format(a='a', b='b')}, 9) AS overlap FROM t JOIN f USING (lang)""")
def token_overlap_query(spark, sf):
    """Every document against the first one of its language; languages are few and hot."""
    docs = table(spark, sf, "documents").select("lang", "doc_id", tokens("text").alias("a"))
    firsts = one_per_key(docs, ["lang"], ["doc_id"]).select("lang", F.col("a").alias("b"))
    joined = lookup_join(docs, firsts, ["lang"], rows_per_task=200)
    return joined.select("doc_id", F.round(token_overlap("a", "b"), 9).alias("overlap"))


MARKERS = ("das und", "the the", "eau", "ist", "the", "une ")


@query("first_marker", """
WITH w AS (SELECT doc_id, lower(left(text, 400)) AS w FROM documents)
SELECT doc_id, CASE """ + " ".join(f"WHEN contains(w, '{m}') THEN '{m}'" for m in MARKERS) + " END AS marker FROM w")
def first_marker_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", first_marker("text", MARKERS).alias("marker"))


TOPICS = {"/fr": ("tionouau", "eauxque", "ouanou"), "/en": ("hatthe", "ouonor"), "/de": ("dieich",), "/es": ("losque", "elde")}
GATED = ("anmeld", "eau le la", "erst the")
MISSING = ("nicht", "tion tion", "stand er")


def _answers(pages):
    """Rendered pages as answers: failures, redirects and statuses told from the URL."""
    url = F.col("final_url")
    return pages.select(
        "page_id", "domain", "fetched_at",
        F.regexp_extract(U.url_path(url), "^/[a-z]+", 0).alias("path"),
        F.when(url.contains("utm"), F.concat(F.regexp_extract(url, "^https?://[^/]*", 0), F.lit("/")))
        .otherwise(url).alias("final_url"),
        F.when(url.contains("#top"), 404).otherwise(200).alias("status_code"),
        F.when(url.endswith("/"), F.lit("timed out")).alias("fetch_error"),
        # pages of a short text: their title stands for it
        F.when(url.contains("ref=x"), F.coalesce("title", F.lit(""))).otherwise(F.col("markdown")).alias("text"),
    )


def _controls(spark, sf):
    """The first page of every site stands in for its control page; some sites are made honest or blind."""
    raw = table(spark, sf, "pages")
    firsts = raw.groupBy(U.domain_of("url").alias("d")).agg(F.min("page_id").alias("page_id")).select("page_id")
    first = _answers(rendered(spark, sf, raw.join(firsts, "page_id", "left_semi")))
    blank = F.when(F.col("domain").startswith("blog."), "Loading").otherwise(F.col("text"))
    status = F.when(F.col("domain").endswith(".net"), 404).otherwise(200)
    return first.select("domain", status.alias("status_code"), F.lit(None).cast("string").alias("fetch_error"), blank.alias("text"))


ANSWERS_SQL = TEXT + """, answers AS (
  SELECT page_id, domain, regexp_extract(url, '^https?://[^/]*(/[a-z]+)', 1) AS path,
    CASE WHEN contains(url, 'utm') THEN root || '/' ELSE url END AS final_url,
    CASE WHEN contains(url, '#top') THEN 404 ELSE 200 END AS status, ends_with(url, '/') AS failed,
    CASE WHEN contains(url, 'ref=x') THEN """ + TITLE + """ ELSE text END AS text FROM page_text),
controls AS (SELECT domain, CASE WHEN ends_with(domain, '.net') THEN 404 ELSE 200 END AS status,
    CASE WHEN starts_with(domain, 'blog.') THEN 'Loading' ELSE arg_min(text, page_id) END AS ctext FROM answers GROUP BY domain),
modes AS (SELECT *, CASE WHEN status >= 400 THEN 'honest_404' WHEN length(ctext) < 60 THEN 'soft_404_blind' ELSE 'soft_404' END AS mode FROM controls)"""


@query("control_mode", ANSWERS_SQL + f""" SELECT domain, mode, CASE WHEN mode = 'soft_404' THEN len({TOKENS_SQL.format('ctext')})::BIGINT END AS control_tokens FROM modes""")
def control_mode(spark, sf):
    modes = calibrate(_controls(spark, sf))
    return modes.select("domain", "mode", F.when(F.col("control_tokens").isNotNull(), F.size("control_tokens")).cast("long").alias("control_tokens"))


def _has(words, text="lower(text)"):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TOPIC_SQL = "CASE path " + " ".join(f"WHEN '{p}' THEN {_has(ws)}" for p, ws in TOPICS.items()) + " END"


@query("on_topic", ANSWERS_SQL + f" SELECT page_id, {_TOPIC_SQL} AS on_topic FROM answers")
def on_topic(spark, sf):
    return _answers(rendered(spark, sf)).select("page_id", P.on_topic("path", "text", TOPICS).alias("on_topic"))


def _marker_sql(words):
    return "CASE " + " ".join(f"WHEN contains(lower(left(text, 400)), '{w}') THEN '{w}'" for w in words) + " END"


@query("path_verdicts", ANSWERS_SQL + f""",
j AS (SELECT a.*, mode, {TOKENS_SQL.format('a.text')} AS ta, {TOKENS_SQL.format('ctext')} AS tb, length(a.text) AS n,
        {_marker_sql(GATED)} AS gated, {_marker_sql(MISSING)} AS missing, {_TOPIC_SQL} AS topic
      FROM answers a JOIN modes USING (domain)),
s AS (SELECT *, CASE WHEN mode = 'soft_404' THEN {OVERLAP_SQL.format(a='ta', b='tb')} END AS sim FROM j),
k AS (SELECT *, CASE WHEN failed THEN 1 WHEN status >= 400 THEN 2 WHEN regexp_matches(final_url, '^https?://[^/]*/?$') AND path <> '/' THEN 3
        WHEN gated IS NOT NULL THEN 4 WHEN missing IS NOT NULL THEN 5 WHEN sim > 0.85 THEN 6 WHEN n < 200 THEN 7
        WHEN topic THEN 8 WHEN mode = 'soft_404_blind' THEN 9 WHEN NOT topic THEN 10 ELSE 11 END AS r FROM s)
SELECT page_id, mode, round(sim, 9) AS similarity,
  CASE WHEN r IN (1, 2, 3, 5, 6, 7) THEN 'missing' WHEN r = 4 THEN 'gated' ELSE 'exists' END AS verdict,
  CASE r WHEN 1 THEN 'fetch failed: timed out' WHEN 2 THEN 'HTTP ' || status WHEN 3 THEN 'redirected to the homepage'
    WHEN 4 THEN 'login wall (''' || gated || ''')' WHEN 5 THEN 'not-found copy (''' || missing || ''')'
    WHEN 6 THEN printf('soft 404: %.2f similar to the control page', sim) WHEN 7 THEN 'only ' || n || ' chars of content'
    WHEN 8 THEN 'on-topic content found' WHEN 9 THEN 'looks real, but the control page rendered nothing so soft 404s cannot be ruled out'
    WHEN 10 THEN 'real page, but off-topic content' ELSE 'real page' END AS reason,
  CASE r WHEN 1 THEN 0.9 WHEN 2 THEN 0.98 WHEN 3 THEN 0.95 WHEN 4 THEN 0.85 WHEN 5 THEN 0.9 WHEN 6 THEN 0.95 WHEN 7 THEN 0.8
    WHEN 8 THEN 0.95 WHEN 9 THEN 0.5 WHEN 10 THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence
FROM k""")
def path_verdicts_query(spark, sf):
    answers = _answers(rendered(spark, sf))
    judged = path_verdicts(
        answers.drop("fetched_at"), _controls(spark, sf), gated_markers=GATED, missing_markers=MISSING, topics=TOPICS,
        rows_per_task=10_000,
    )
    return judged.select("page_id", "mode", F.round("similarity", 9).alias("similarity"), "verdict", "reason", "confidence")


@query("probe_paths", ANSWERS_SQL + f""",
asked AS (SELECT domain, mode, ctext, unnest(['/fr', '/en', '/de', '/es']) AS path FROM modes),
got AS (SELECT domain, path, arg_max(text, page_id) AS text, arg_max(status, page_id) AS status, arg_max(failed, page_id) AS failed,
          max(page_id) AS page_id FROM answers GROUP BY domain, path),
j AS (SELECT asked.domain, asked.path, mode, got.page_id IS NULL AS absent, got.status, got.failed, got.text, length(got.text) AS n,
        {TOKENS_SQL.format('got.text')} AS ta, {TOKENS_SQL.format('ctext')} AS tb, {_TOPIC_SQL.replace('path', 'asked.path').replace('lower(text)', 'lower(got.text)')} AS topic
      FROM asked LEFT JOIN got ON got.domain = asked.domain AND got.path = asked.path),
s AS (SELECT *, CASE WHEN mode = 'soft_404' THEN {OVERLAP_SQL.format(a='ta', b='tb')} END AS sim FROM j)
SELECT domain, path, CASE WHEN absent OR failed OR status >= 400 OR sim > 0.85 OR n < 200 THEN 'missing' ELSE 'exists' END AS verdict,
  CASE WHEN absent OR failed THEN 0.9 WHEN status >= 400 THEN 0.98 WHEN sim > 0.85 THEN 0.95 WHEN n < 200 THEN 0.8
       WHEN topic THEN 0.95 WHEN mode = 'soft_404_blind' THEN 0.5 ELSE 0.6 END::DOUBLE AS confidence FROM s""")
def probe_paths_query(spark, sf):
    """Four paths on every site; the newest page under a path is its answer."""
    answers = _answers(rendered(spark, sf))
    crawl = answers.select(
        F.concat(F.lit("https://"), "domain", "path").alias("url"), F.concat(F.lit("https://"), "domain", "path").alias("final_url"),
        "status_code", "fetch_error", "fetched_at", F.col("text").alias("markdown"), F.lit(None).cast("string").alias("html"),
    )
    judged = probe_paths(_controls(spark, sf), crawl, TOPICS, gated_markers=("~none~",), missing_markers=("~none~",))
    return judged.select("domain", "path", "verdict", "confidence")
