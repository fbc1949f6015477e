"""Page facts: titles, links, vendors, text, signals, homepages, robots."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountlake import vocab
from accountlake.functions import html as H
from accountlake.functions import urls as U
from accountlake.functions.text import content_hash, truncate
from accountlake.operators.pages import (
    build_pages, resolve_homepages, response_error, targets, thin_error, with_signals,
)
from accountlake.operators.robots import robots_gate
from suite.registry import query, table
from suite.sqltext import SITE, TEXT, TITLE, decode, host, links, strip, truncate as truncate_sql


def marked(spark, sf):
    return table(spark, sf, "pages").withColumn("m", H.markup("html"))


def rendered(spark, sf, pages=None):
    """Pages as ``build_pages`` gives them, with the id."""
    raw = (table(spark, sf, "pages") if pages is None else pages).select(
        "page_id", U.domain_of("url").alias("domain"), F.col("url").alias("final_url"), F.lit(200).alias("status_code"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")).alias("fetched_at"), "html",
    )
    return build_pages(raw)


@query("page_title", f"WITH {SITE} SELECT page_id, nullif({TITLE}, '') AS title FROM site")
def page_title(spark, sf):
    return marked(spark, sf).select("page_id", H.page_title("m").alias("title"))


@query("meta_description", """
SELECT page_id, replace(trim(regexp_replace(split_part(replace(html, '<meta charset="utf-8">', ''), '<title>', 2), '<.*$', '', 's')), '&amp', '&') AS description
FROM (SELECT page_id, replace(replace(html, '&amp;', 'and'), '&quot;', '') AS html FROM pages)""")
def meta_description(spark, sf):
    """Descriptions made from the pages' own titles, in both spellings of the tag."""
    clean = F.replace(F.replace("html", F.lit("&amp;"), F.lit("and")), F.lit("&quot;"), F.lit(""))
    tagged = F.regexp_replace(
        clean, "<title>([^<]*)</title>", "<meta content='' name=\"description\"><META property='og:description' content=\"$1\">"
    )
    plain = F.regexp_replace(clean, "<title>([^<]*)</title>", "<meta name=description content=\"$1\">")
    page = F.when(F.col("url").contains("www."), tagged).otherwise(plain)
    return table(spark, sf, "pages").select("page_id", H.markup(page).alias("m")).select(
        "page_id", F.coalesce(H.meta_description("m"), F.lit("")).alias("description")
    )


@query("page_links", f"WITH {SITE}, {links()} SELECT page_id, pos, text, url FROM (SELECT page_id, text, url, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS pos FROM links)")
def page_links(spark, sf):
    found = marked(spark, sf).select("page_id", H.extract_links("m", "url").alias("l"))
    return found.select("page_id", F.posexplode("l").alias("i", "x")).select(
        "page_id", (F.col("i") + 1).cast("long").alias("pos"), "x.text", "x.url"
    )


@query("markdown_links", f"WITH {SITE}, {links('html')} SELECT page_id, count(*) AS n, string_agg(text || ' ' || url, chr(10) ORDER BY pos) AS found FROM links GROUP BY page_id")
def markdown_links(spark, sf):
    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    found = table(spark, sf, "pages").select("page_id", H.extract_links_markdown(md, "url").alias("l"))
    lines = F.array_join(F.transform("l", lambda x: F.concat(x["text"], F.lit(" "), x["url"])), "\n")
    return found.where(F.size("l") > 0).select("page_id", F.size("l").cast("long").alias("n"), lines.alias("found"))


def _as_images(spark, sf):
    """Nav links turned into images, so that the synthetic pages have assets."""
    images = F.replace("html", F.lit("<a href="), F.lit("<img src="))
    return table(spark, sf, "pages").select("page_id", "url", H.markup(images).alias("m"))


@query("asset_urls", f"""
WITH {SITE}, a AS (SELECT page_id, list_transform(regexp_extract_all(m, '<a href="([^"]*)"', 1), lambda h: lower(root || h)) AS urls FROM site)
SELECT page_id, len(urls)::BIGINT AS n, array_to_string(urls, chr(10)) AS urls FROM a""")
def asset_urls(spark, sf):
    found = _as_images(spark, sf).select("page_id", H.asset_urls("m", "url").alias("u"))
    return found.select("page_id", F.size("u").cast("long").alias("n"), F.array_join("u", "\n").alias("urls"))


SIGNATURES = {"/the": "Thex", "/to": "Tovy", "example.com/": "Comly", "/la": "Lapp", "/les": "Lapp", "/und": "Undo", "/ein": "Einly"}


@query("detect_vendors", f"""
WITH {SITE}, a AS (SELECT page_id, lower(array_to_string(list_transform(regexp_extract_all(m, '<a href="([^"]*)"', 1), lambda h: root || h), chr(10))) AS t FROM site)
SELECT page_id, array_to_string(list_filter([
  CASE WHEN contains(t, 'example.com/') THEN 'Comly' END, CASE WHEN contains(t, '/ein') THEN 'Einly' END,
  CASE WHEN contains(t, '/la') OR contains(t, '/les') THEN 'Lapp' END, CASE WHEN contains(t, '/the') THEN 'Thex' END,
  CASE WHEN contains(t, '/to') THEN 'Tovy' END, CASE WHEN contains(t, '/und') THEN 'Undo' END], lambda x: x IS NOT NULL), '; ') AS vendors FROM a""")
def detect_vendors(spark, sf):
    found = _as_images(spark, sf).select("page_id", H.asset_urls("m", "url").alias("u"))
    return found.select("page_id", F.array_join(H.detect_vendors("u", SIGNATURES), "; ").alias("vendors"))


@query("main_fragment", TEXT + " SELECT page_id, length(frag) AS fragment_chars, substr(sha256(frag), 1, 16) AS fragment_hash FROM page_text")
def main_fragment(spark, sf):
    chosen = marked(spark, sf).select("page_id", H.main_fragment("m").alias("f"))
    return chosen.select("page_id", F.length("f").cast("long").alias("fragment_chars"), content_hash("f").alias("fragment_hash"))


@query("longest_article", f"""
WITH {SITE}, cut AS (SELECT page_id, replace(m, '<p>', '</article><article>') AS m FROM site),
parts AS (SELECT page_id, m, unnest(regexp_extract_all(m, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1)) AS part,
  generate_subscripts(regexp_extract_all(m, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), 1) AS pos FROM cut),
sized AS (SELECT *, list_sum(list_transform(string_split_regex(part, '<[^>]*>'), lambda s: length({strip(decode('s'))})))::BIGINT AS n FROM parts),
best AS (SELECT page_id, arg_max(part, n * 100000 - pos) AS part, max(n) AS n FROM sized GROUP BY page_id)
SELECT c.page_id, CASE WHEN b.n > 400 THEN substr(sha256(b.part), 1, 16) END AS longest FROM cut c LEFT JOIN best b USING (page_id)""")
def longest_article(spark, sf):
    """Every paragraph as an article of its own: the fragment is the longest one, where it is long enough."""
    several = marked(spark, sf).select("page_id", F.replace("m", F.lit("<p>"), F.lit("</article><article>")).alias("m"))
    chosen = several.select("page_id", H.main_fragment("m").alias("f"))
    return chosen.select("page_id", F.when(~F.col("f").contains("article>"), content_hash("f")).alias("longest"))


@query("page_text", TEXT + " SELECT page_id, text FROM page_text")
def page_text(spark, sf):
    return rendered(spark, sf).select("page_id", F.col("markdown").alias("text"))


@query("truncate_text", TEXT + f" SELECT page_id, {truncate_sql('full_text', 700)} AS text FROM page_text")
def truncate_text(spark, sf):
    full = marked(spark, sf).select("page_id", H.render(H.main_fragment("m")).alias("t"))
    return full.select("page_id", truncate("t", 700).alias("text"))


@query("content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash_query(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_hash("text").alias("content_hash"))


PATTERNS = {
    "has_the": (r"/the[.,]", r"/that"), "has_la": (r"/la\n", r"/des "), "has_und": (r"und [a-z]+ die", r"/und"),
    "has_host": (r"https?://(?:www|m)\.",), "has_tion": (r"tions?[.,] ",),
}


def _corpus_sql(tail: str) -> str:
    return TEXT + f""", {links()},
corpus AS (SELECT t.page_id, lower(coalesce(l.lines, '') || chr(10) || t.text) AS c FROM page_text t
  LEFT JOIN (SELECT page_id, string_agg(url || ' ' || text, chr(10) ORDER BY pos) AS lines FROM links GROUP BY page_id) l USING (page_id))
{tail}"""


@query("page_signals", _corpus_sql("SELECT page_id, " + ", ".join(
    "(" + " OR ".join(f"regexp_matches(c, '{p}')" for p in ps) + f") AS {name}" for name, ps in vocab.SIGNAL_PATTERNS.items()
) + " FROM corpus"))
def page_signals(spark, sf):
    return with_signals(rendered(spark, sf)).select("page_id", "page_signals.*")


@query("custom_signals", _corpus_sql("SELECT page_id, " + ", ".join(
    "(" + " OR ".join(f"regexp_matches(c, '{p}')" for p in ps) + f") AS {name}" for name, ps in PATTERNS.items()
) + " FROM corpus"))
def custom_signals(spark, sf):
    return with_signals(rendered(spark, sf), PATTERNS).select("page_id", "page_signals.*")


# Answers as a crawler would report them, told from the URL.
def status():
    return F.when(F.col("url").contains("#top"), 404).when(F.col("url").contains("?page"), 503).otherwise(200)


def kind():
    return F.when(F.col("url").endswith(".html"), "text/html").when(F.col("url").endswith("/"), "application/pdf").otherwise("TEXT/HTML; charset=utf-8")


STATUS_SQL = "CASE WHEN contains(url, '#top') THEN 404 WHEN contains(url, '?page') THEN 503 ELSE 200 END"
KIND_SQL = "CASE WHEN ends_with(url, '.html') THEN 'text/html' WHEN ends_with(url, '/') THEN 'application/pdf' ELSE 'TEXT/HTML; charset=utf-8' END"


@query("response_gate", f"""
SELECT page_id, CASE WHEN status >= 400 THEN url || ': HTTP ' || status
  WHEN NOT contains(lower(kind), 'html') THEN url || ': not HTML (' || kind || ')' END AS error
FROM (SELECT page_id, url, {STATUS_SQL} AS status, {KIND_SQL} AS kind FROM pages)""")
def response_gate(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", response_error(F.col("url"), status(), kind()).alias("error")
    )


@query("usable_gate", TEXT + """ SELECT page_id, CASE WHEN length(text) < 200 THEN
  url || ': page rendered to ' || length(text) || ' chars (likely JS-only)' END AS error FROM page_text""")
def usable_gate(spark, sf):
    return rendered(spark, sf).select("page_id", thin_error(F.col("final_url"), F.col("markdown")).alias("error"))


def crawl(spark, sf):
    """Every page as an answer of its site's homepage, at the www address when it was found there."""
    d = U.domain_of("url")
    home = F.when(U.url_host("url").startswith("www."), U.candidate_urls(d)[1]).otherwise(U.candidate_urls(d)[0])
    return table(spark, sf, "pages").select(
        home.alias("url"), F.col("url").alias("final_url"), status().alias("status_code"), kind().alias("content_type"),
        "html", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")).alias("fetched_at"),
    )


@query("resolve_homepages", TEXT + f""", tries AS (
  SELECT *, CASE WHEN starts_with(host, 'www.') THEN 2 ELSE 1 END AS k, {STATUS_SQL} AS status, {KIND_SQL} AS kind FROM page_text
  QUALIFY row_number() OVER (PARTITION BY domain, k ORDER BY page_id DESC) = 1),
judged AS (SELECT *, 'https://' || CASE k WHEN 2 THEN 'www.' ELSE '' END || domain || '/' AS asked,
  CASE WHEN status >= 400 THEN 'HTTP ' || status WHEN NOT contains(lower(kind), 'html') THEN 'not HTML (' || kind || ')'
       WHEN length(text) < 200 THEN 'page rendered to ' || length(text) || ' chars (likely JS-only)' END AS problem FROM tries),
best AS (SELECT domain, arg_min(url, k) AS final_url, arg_min(text, k) AS markdown FROM judged WHERE problem IS NULL GROUP BY domain),
errors AS (SELECT domain, string_agg(asked || ': ' || problem, '; ' ORDER BY k) AS error FROM judged WHERE problem IS NOT NULL GROUP BY domain)
SELECT d.domain, d.ord, b.final_url, length(b.markdown) AS chars, CASE WHEN b.domain IS NULL THEN e.error END AS error
FROM (SELECT domain, min(page_id) AS ord FROM site GROUP BY domain) d LEFT JOIN best b USING (domain) LEFT JOIN errors e USING (domain)""")
def resolve_homepages_query(spark, sf):
    accounts = table(spark, sf, "pages").select(F.col("url").alias("domain"), F.col("page_id").alias("ord"))
    found = resolve_homepages(targets(accounts)[0], crawl(spark, sf))
    return found.select("domain", "ord", "final_url", F.length("markdown").cast("long").alias("chars"), "error")


ROBOTS_COM = "User-agent: *\nDisallow: /fr/\nAllow: /en/\n\nUser-agent: PageBot # ours\nUser-agent: other\nAllow: /de/1\nDisallow: /de/\nDisallow: /en/4 # some\n"
ROBOTS_ORG = "# all\nUser-Agent: *\nDisallow: /es/\nDisallow:\nDisallow: /\n"


@query("robots_gate", f"""
SELECT page_id, CASE WHEN ends_with(h, '.com') THEN NOT (
    (starts_with(path, '/de/') AND NOT starts_with(path, '/de/1')) OR starts_with(path, '/en/4'))
  WHEN ends_with(h, '.org') THEN NOT starts_with(path, '/es/') ELSE true END AS allowed
FROM (SELECT page_id, {host('url')} AS h, regexp_extract(url, '^https?://[^/]*([^#]*)', 1) AS path FROM pages)""")
def robots_gate_query(spark, sf):
    """Each host's robots file told from its top-level domain; .net hosts have none."""
    pages = table(spark, sf, "pages")
    hosts = pages.select(U.url_host("url").alias("host")).distinct()
    body = F.when(F.col("host").endswith(".com"), F.lit(ROBOTS_COM)).otherwise(F.lit(ROBOTS_ORG))
    robots = hosts.select(
        "host", F.when(F.col("host").endswith(".net"), 404).otherwise(200).alias("status"), body.alias("body")
    )
    return robots_gate(pages.select("page_id", "url"), robots, "PageBot/1.0").select("page_id", "allowed")
