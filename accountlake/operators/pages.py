"""From account domains and a crawl table to pages with their facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from accountlake import vocab
from accountlake.functions import html as H
from accountlake.functions.text import blank_to_null, content_hash, let, strip, truncate
from accountlake.functions.urls import candidate_urls, domain_error, domain_of
from accountlake.operators.robots import robots_gate
from accountlake.schemas import RAW_PAGE


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Input position, increasing in file order."""
    return df.withColumn(name, F.monotonically_increasing_id())


def targets(accounts: DataFrame, raw: str = "domain", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """``(domains, rejects)``: every good domain once, at its first position; every bad input as it came."""
    parsed = accounts.select(
        F.col(order).alias("ord"), F.col(raw).alias("raw"), domain_of(raw).alias("domain")
    )
    domains = parsed.where("domain is not null").groupBy("domain").agg(F.min("ord").alias("ord"))
    rejects = parsed.where("domain is null").select(
        F.col("raw").alias("domain"), "ord", domain_error("raw").alias("error")
    )
    return domains, rejects


# --- gates -----------------------------------------------------------------


def response_error(url: Column, status: Column, content_type: Column | None = None) -> Column:
    """Why an answer is not a page; null when it is one."""
    error = F.when(status >= 400, F.concat(url, F.lit(": HTTP "), status.cast("string")))
    if content_type is not None:
        kind = F.lower(F.coalesce(content_type, F.lit("")))
        not_html = (kind != "") & ~kind.contains("html")
        error = error.when(not_html, F.concat(url, F.lit(": not HTML ("), content_type, F.lit(")")))
    return error


def thin_error(url: Column, markdown: Column) -> Column:
    """Why a rendered page is unusable; null when it has enough text."""
    n = F.length(markdown)
    return F.when(
        n < vocab.MIN_USEFUL_MARKDOWN,
        F.concat(url, F.lit(": page rendered to "), n.cast("string"), F.lit(" chars (likely JS-only)")),
    )


# --- page assembly ---------------------------------------------------------


def build_pages(
    raw_pages: DataFrame,
    *,
    signatures: Mapping[str, str] | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Add title, description, markdown, links, vendors and content hash to raw pages.

    Needs ``final_url`` and ``html``; a backend's own ``markdown``, ``title`` and
    ``description`` win where present. The cleaned markup is computed once, in its
    own projection, and dropped. Whole texts are kept and hashed; ``max_chars`` cuts them.
    """
    for name in ("markdown", "title", "description"):
        if name not in raw_pages.columns:
            raw_pages = raw_pages.withColumn(name, F.lit(None).cast("string"))
    from_html, base = F.col("_markup").isNotNull(), F.col("final_url")
    # One step each: the analyzer goes over a projection again and again until all of it is resolved.
    steps = {
        "_markup": H.markup(blank_to_null("html")),
        "_copy": H.main_fragment("_markup"),
        "_text": H.render("_copy"),
        "_markdown": truncate(strip(F.coalesce(blank_to_null("markdown"), truncate("_text", max_chars), F.lit(""))), max_chars),
        "_title": F.coalesce(blank_to_null("title"), H.page_title("_markup")),
        "_description": F.coalesce(blank_to_null("description"), H.meta_description("_markup")),
        "_links": F.when(from_html, H.extract_links("_markup", base)).otherwise(H.extract_links_markdown("markdown", base)),
        "_vendors": F.when(from_html, H.detect_vendors(H.asset_urls("_markup", base), signatures)).otherwise(
            F.array().cast("array<string>")),
    }
    facts = raw_pages
    for name, column in steps.items():
        facts = facts.withColumn(name, column)
    facts = facts.select(
        *[c for c in raw_pages.columns if c not in ("html", "markdown", "title", "description")],
        F.col("_title").alias("title"), F.col("_description").alias("meta_description"), F.col("_markdown").alias("markdown"),
        F.col("_links").alias("links"), F.col("_vendors").alias("tech_signals"),
    )
    return facts.withColumn("content_hash", content_hash("markdown"))


def with_signals(pages: DataFrame, patterns: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
    corpus = pages.withColumn("_corpus", H.signal_corpus("links", "markdown"))
    return corpus.withColumn("page_signals", H.page_signals("_corpus", patterns)).drop("_corpus")


# --- homepages -------------------------------------------------------------


def resolve_homepages(
    domains: DataFrame, crawl: DataFrame, *, robots: DataFrame | None = None, agent: str = "*", **build
) -> DataFrame:
    """One row per domain: its first usable homepage, or the reasons there is none.

    ``crawl`` holds answers by requested ``url`` (several crawls of one URL: the
    newest counts). Only rows whose URL is a candidate homepage of their own domain
    are looked at. The newest per candidate is found on narrow rows, then joined to the
    crawl by domain; what follows needs no other layout, so page text is shuffled once and no aggregate holds it. Where ``crawl``
    says in ``domain`` whose pages they are (``lay_out_crawl``) and is bucketed by it, page text is not shuffled at all.
    One more lookup when ``robots`` rules (``host, status, body``) are to be kept.
    """
    tried = let(candidate_urls("domain"), lambda urls: F.array_position(urls, F.col("url")))
    if "domain" not in crawl.columns:
        crawl = crawl.withColumn("domain", domain_of("url"))
    c = crawl.withColumn("_try", tried.cast("int")).where("_try > 0")
    columns = [x for x in crawl.columns if x in RAW_PAGE.names]
    # The newest answer is chosen on a few bytes a row; page texts travel once.
    stamp = F.xxhash64("html", "final_url")
    newest = c.select("domain", "_try", "fetched_at", stamp.alias("_stamp")).groupBy("domain", "_try").agg(
        F.max(F.struct("fetched_at", "_stamp")).alias("_m")
    ).select("domain", "_try", F.col("_m.fetched_at").alias("_when"), F.col("_m._stamp").alias("_stamp"))
    wanted = domains.join(newest, "domain", "left")
    answers = c.withColumn("_stamp", stamp).select(
        "domain", F.struct("_try", *columns).alias("_r"), F.struct("_try", F.col("fetched_at").alias("_when"), "_stamp").alias("_at"))
    # Keys beside the domain are written as no equality, so that rows stay together by domain.
    same = (wanted["domain"] == answers["domain"]) & ~(
        F.struct(wanted["_try"], wanted["_when"], wanted["_stamp"]) < answers["_at"]
    ) & ~(answers["_at"] < F.struct(wanted["_try"], wanted["_when"], wanted["_stamp"]))
    tries = wanted.join(answers, same, "left").select(*[wanted[x] for x in domains.columns], answers["_r"])
    asked = tries.select(*domains.columns, "_r.*").withColumn("allowed", F.lit(True))
    if robots is not None:
        asked = robots_gate(asked.drop("allowed"), robots, agent)
    content = [blank_to_null(c) for c in ("html", "markdown") if c in columns]
    asked = asked.withColumn("_empty", F.coalesce(*content).isNull())
    pages = build_pages(asked, **build)
    url = F.col("url")
    forbidden = F.when(~F.col("allowed"), F.concat(url, F.lit(": disallowed by robots.txt")))
    kind = F.col("content_type") if "content_type" in columns else None
    fetch_error = F.col("fetch_error") if "fetch_error" in columns else F.lit(None).cast("string")
    empty = F.when(F.col("_empty"), F.concat(url, F.lit(": returned no content")))
    pages = pages.withColumn(
        "_error",
        F.coalesce(
            forbidden, fetch_error, response_error(url, F.col("status_code"), kind),
            empty, thin_error(url, F.col("markdown")),
        ),
    )
    page_columns = (
        "final_url", "status_code", "fetched_at", "title", "meta_description", "markdown",
        "links", "tech_signals", "content_hash",
    )
    # At most the two candidate URLs per domain; an answer that was stored twice counts once.
    usable = F.col("_try").isNotNull() & F.col("_error").isNull()
    of_domain = Window.partitionBy("domain")
    failed = F.collect_set(F.when(F.col("_error").isNotNull(), F.struct("_try", "_error"))).over(of_domain)
    first = F.row_number().over(of_domain.orderBy((~usable).cast("int"), "_try"))
    best = pages.withColumns({"_usable": usable, "_errors": F.array_sort(failed), "_first": first}).where("_first = 1")
    error = F.array_join(F.transform("_errors", lambda e: e["_error"]), "; ")
    nothing = F.concat(F.col("domain"), F.lit(": no candidate URL succeeded"))
    return best.select(
        *domains.columns, *[F.when(F.col("_usable"), F.col(c)).alias(c) for c in page_columns],
        F.when(~F.col("_usable"), F.coalesce(blank_to_null(error), nothing)).alias("error"),
    )


def lay_out_crawl(crawl: DataFrame, table: str, buckets: int) -> None:
    """Write a crawl as a table bucketed and sorted by ``domain``: lookups by domain then read pages where they lie."""
    laid = crawl.withColumn("domain", domain_of("url")).where("domain is not null")
    laid.repartition(buckets, "domain").write.mode("overwrite").bucketBy(buckets, "domain").sortBy("domain").saveAsTable(table)
