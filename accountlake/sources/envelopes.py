"""Dumps of scraping backends: several JSON shapes, one raw-page schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from accountlake.functions.text import blank_to_null


def _text(v: Column, path: str) -> Column:
    """Non-empty text at a path; null for anything that is not text."""
    found = F.try_variant_get(v, path, "variant")
    is_text = F.schema_of_variant(found) == "STRING"
    return F.when(is_text, blank_to_null(F.try_variant_get(v, path, "string")))


def _first_text(v: Column, path: str) -> Column:
    """Text, or the first entry of a list of texts."""
    return F.coalesce(_text(v, path), _text(v, f"{path}[0]"))


def _number(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "int"), F.lit(0))


def _nested(v: Column) -> dict[str, Column]:
    """``{success, data: {markdown, rawHtml, html, metadata}}``."""
    return {
        "final_url": F.coalesce(_text(v, "$.data.metadata.url"), _text(v, "$.data.metadata.sourceURL")),
        "status_code": _number(v, "$.data.metadata.statusCode"),
        "html": F.coalesce(_text(v, "$.data.rawHtml"), _text(v, "$.data.html")),
        "markdown": _text(v, "$.data.markdown"),
        "title": _first_text(v, "$.data.metadata.title"),
        "description": _first_text(v, "$.data.metadata.description"),
    }


def _result(v: Column) -> dict[str, Column]:
    """``{results: [r]}``, ``[r]`` or ``r``; markdown is text or an object of variants."""
    def pick(read, path: str) -> Column:
        return F.coalesce(read(v, f"$.results[0].{path}"), read(v, f"$[0].{path}"), read(v, f"$.{path}"))

    return {
        "final_url": pick(_text, "url"),
        "status_code": pick(_number, "status_code"),
        "html": F.coalesce(pick(_text, "raw_html"), pick(_text, "cleaned_html")),
        "markdown": F.coalesce(
            pick(_text, "markdown.raw_markdown"), pick(_text, "markdown.fit_markdown"), pick(_text, "markdown")
        ),
        "title": pick(_text, "metadata.title"),
        "description": pick(_text, "metadata.description"),
    }


def _items(v: Column) -> dict[str, Column]:
    """``[{url, loadedUrl, markdown|text, html|rawHtml|body, metadata}]``."""
    def first(*names: str) -> Column:
        return F.coalesce(*[_text(v, f"$[0].{n}") for n in names])

    return {
        "final_url": first("loadedUrl", "url"),
        "status_code": _number(v, "$[0].statusCode"),
        "html": first("html", "rawHtml", "body"),
        "markdown": first("markdown", "text"),
        "title": first("title", "metadata.title"),
        "description": first("description", "metadata.description"),
    }


# Envelope name -> reader. The names are those of the public scraping backends.
ENVELOPES = {"firecrawl": _nested, "crawl4ai": _result, "apify": _items}


def normalise_envelopes(dump: DataFrame, envelope: str, body: str = "body", url: str = "url") -> DataFrame:
    """Add the raw-page columns to a dump of ``url`` and JSON ``body``; the JSON is parsed once.

    ``fetch_error`` tells of a body that is not JSON, reports failure or has no content.
    """
    parsed = dump.withColumn("_v", F.try_parse_json(body))
    v = F.col("_v")
    failed = F.coalesce(
        F.try_variant_get(v, "$.results[0].success", "boolean"),
        F.try_variant_get(v, "$[0].success", "boolean"),
        F.try_variant_get(v, "$.success", "boolean"),
    ) == F.lit(False)
    fields = ENVELOPES[envelope](v)
    rest = [c for c in dump.columns if c not in (body, *fields, "fetch_error")]
    read = parsed.select(
        *rest, *[c.alias(name) for name, c in fields.items()],
        F.when(v.isNull(), "not JSON").when(failed, "reported failure").alias("_failed"),
    )
    no_content = F.col("html").isNull() & F.col("markdown").isNull()
    problem = F.coalesce(F.col("_failed"), F.when(no_content, "returned no content"))
    return read.select(
        *rest,
        F.coalesce("final_url", url).alias("final_url"),
        F.coalesce("status_code", F.lit(200)).alias("status_code"),
        "html", "markdown", "title", "description",
        F.when(problem.isNotNull(), F.concat(F.col(url), F.lit(f": {envelope} "), problem)).alias("fetch_error"),
    )
