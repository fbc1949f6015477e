"""Facts and readable text out of HTML, by Catalyst string expressions.

``markup`` is the first step of everything: it empties scripts and styles and
drops comments, so that later patterns only see real tags. Store its result in a
column (``operators.pages`` does) rather than calling it once per fact.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from accountlake import vocab
from accountlake.functions import tree
from accountlake.functions.text import (
    WHITESPACE, any_contained, any_matches, blank_to_null, col, decode_entities, let, shortened, squash, strip,
)
from accountlake.functions.urls import absolute_url

_TAG = "<[^>]*>"
_BLANKS = WHITESPACE.replace("\n", "")
_SCRIPTS = "|".join((
    "<!--.*?-->",
    r"(<(?:script|style)\b[^>]*/>)",
    r"(<script\b[^>]*>).*?(?:</script\s*>|\z)",
    r"(<style\b[^>]*>).*?(?:</style\s*>|\z)",
))


def markup(html: Column | str) -> Column:
    """The page without comments and without the insides of scripts and styles."""
    return F.regexp_replace(col(html), f"(?is){_SCRIPTS}", "$1$2$3")


def _raw_attribute(tag: Column, name: str) -> Column:
    """Attribute value as written, quotes included; empty when absent."""
    return F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)


def _unquote(raw: Column) -> Column:
    return strip(decode_entities(F.regexp_replace(raw, r"""(?s)^(["'])(.*)\1$""", "$2")))


def attribute(tag: Column, name: str) -> Column:
    """Decoded, trimmed attribute value of a start tag; empty when absent."""
    return _unquote(_raw_attribute(tag, name))


def page_title(marked: Column | str, limit: int | None = None) -> Column:
    """The title; its first ``limit`` characters where that is asked for."""
    text = F.regexp_extract(col(marked), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return blank_to_null(shortened(squash(decode_entities(text)), limit))


def meta_description(marked: Column | str, limit: int | None = None) -> Column:
    """``name=description``, else ``property=og:description``; cut only where ``limit`` is given."""
    metas = F.regexp_extract_all(col(marked), F.lit(r"(?is)(<meta\b[^>]*>)"), 1)

    def first(tags: Column, key: str, value: str) -> Column:
        named = F.filter(tags, lambda t: F.btrim(_raw_attribute(t, key), F.lit("\"'")) == value)
        return blank_to_null(_raw_attribute(F.try_element_at(named, F.lit(1)), "content"))

    raw = let(
        metas,
        lambda tags: F.coalesce(*[
            F.nullif(F.nullif(first(tags, key, value), F.lit('""')), F.lit("''"))
            for key, value in (("name", "description"), ("property", "og:description"))
        ]),
    )
    return blank_to_null(shortened(squash(_unquote(raw)), limit))


def inner_text(fragment: Column) -> Column:
    """Text of a fragment, pieces joined by single spaces."""
    return squash(decode_entities(F.regexp_replace(fragment, _TAG, " ")))


def _first_per_url(links: Column) -> Column:
    """Keep the first link of every URL, in page order (sort, compare neighbours, sort back)."""
    by_url = F.array_sort(
        F.transform(links, lambda x, i: F.struct(x["url"].alias("url"), i.alias("i"), x["text"].alias("text")))
    )
    firsts = let(
        by_url,
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["url"] != x["url"])),
    )
    in_order = F.array_sort(
        F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["text"].alias("text"), x["url"].alias("url")))
    )
    return F.transform(in_order, lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url")))


def _is_web(url: Column) -> Column:
    return url.rlike("(?i)^https?:")


def extract_links(marked: Column | str, base: Column | str, limit: int | None = None) -> Column:
    """``array<struct<text,url>>`` of the page's web links, one per URL; link texts cut where ``limit`` is given."""
    base = col(base)
    anchors = F.split(col(marked), r"(?i)<a\s", -1)

    def link(anchor: Column) -> Column:
        return let(
            F.regexp_extract(anchor, r"""^(?:[^>"']++|"[^"]*+"|'[^']*+')*+""", 0),
            lambda tag: let(
                attribute(F.concat(F.lit(" "), tag), "href"),
                lambda href: with_target(anchor, tag, href),
            ),
        )

    def with_target(anchor: Column, tag: Column, href: Column) -> Column:
        body = F.substring(anchor, F.length(tag) + 2, F.length(anchor))
        text = inner_text(F.regexp_extract(body, r"(?is)^(.*?)(?:</a\b|\z)", 1))
        skip = href == ""
        for prefix in vocab.SKIPPED_HREF_PREFIXES:
            skip = skip | href.startswith(prefix)
        return F.when(
            ~skip,
            F.struct(
                shortened(text, limit).alias("text"),
                absolute_url(base, href).alias("url"),
            ),
        )

    links = F.transform(F.slice(anchors, 2, F.greatest(F.size(anchors) - 1, F.lit(0))), link)
    return _first_per_url(F.filter(links, lambda x: x.isNotNull() & _is_web(x["url"])))


_MD_LINK = r"\[([^\]]*)\]\((https?://[^\s)]+|/[^\s)]*)\)"


def extract_links_markdown(markdown: Column | str, base: Column | str, limit: int | None = None) -> Column:
    """Links of a page that came as markdown only; link texts cut where ``limit`` is given."""
    base = col(base)
    found = F.regexp_extract_all(F.coalesce(col(markdown), F.lit("")), F.lit(f"({_MD_LINK})"), 1)
    links = F.transform(
        found,
        lambda m: F.struct(
            shortened(squash(F.regexp_extract(m, _MD_LINK, 1)), limit).alias("text"),
            absolute_url(base, F.regexp_extract(m, _MD_LINK, 2)).alias("url"),
        ),
    )
    return _first_per_url(F.filter(links, lambda x: _is_web(x["url"])))


def asset_urls(marked: Column | str, base: Column | str) -> Column:
    """Absolute lower-case URLs of scripts, link targets, images and frames."""
    marked, base = col(marked), col(base)

    def values(tag: str, attr: str) -> Column:
        tags = F.regexp_extract_all(marked, F.lit(rf"(?is)(<{tag}\s[^>]*>)"), 1)
        return F.transform(tags, lambda t: _raw_attribute(t, attr))

    raw = F.concat(
        values("script", "src"), values("link", "href"), values("img", "src"), values("iframe", "src")
    )
    found = F.filter(F.transform(raw, _unquote), lambda v: v != "")
    return F.transform(found, lambda v: F.lower(absolute_url(base, v)))


def detect_vendors(assets: Column | str, signatures: dict[str, str] | None = None) -> Column:
    """Sorted vendor labels whose URL fragment occurs in an asset URL."""
    signatures = vocab.VENDOR_SIGNATURES if signatures is None else signatures
    by_label: dict[str, list[str]] = {}
    for fragment, label in signatures.items():
        by_label.setdefault(label, []).append(fragment)
    if not by_label:
        return F.array().cast("array<string>")
    return let(
        F.array_join(col(assets), "\n"),
        lambda text: F.array_compact(F.array(*[
            F.when(any_contained(text, fragments), F.lit(label))
            for label, fragments in sorted(by_label.items())
        ])),
    )


def signal_corpus(links: Column | str, text: Column | str, limit: int | None = None) -> Column:
    """Lower-case link targets and texts, then the copy; its first ``limit`` characters where that is asked for."""
    lines = F.transform(col(links), lambda x: F.concat(x["url"], F.lit(" "), x["text"]))
    opening = shortened(F.coalesce(col(text), F.lit("")), limit)
    return F.lower(F.concat(F.array_join(lines, "\n"), F.lit("\n"), opening))


def page_signals(corpus: Column | str, patterns: dict[str, tuple[str, ...]] | None = None) -> Column:
    """One boolean per signal, as a struct."""
    patterns = vocab.SIGNAL_PATTERNS if patterns is None else patterns
    return F.struct(*[any_matches(col(corpus), ps).alias(name) for name, ps in patterns.items()])


# --- readable text ---------------------------------------------------------

def text_length(fragment: Column) -> Column:
    """Characters of visible text, every text piece trimmed."""
    pieces = F.transform(F.split(fragment, _TAG), lambda p: F.length(strip(decode_entities(p))))
    return F.aggregate(pieces, F.lit(0), lambda total, n: total + n)


def main_fragment(marked: Column | str) -> Column:
    """Where the copy is: ``<main>``, else the longest ``<article>``, else the body. Noise elements are left out."""
    def choose(page: Column) -> Column:
        articles = F.transform(
            page["articles"], lambda a, i: F.struct(text_length(a).alias("n"), (-i).alias("i"), a.alias("html"))
        )
        article = let(
            F.array_max(articles), lambda a: F.when(a["n"] > vocab.MIN_ARTICLE_CHARS, a["html"])
        )
        whole = page["whole"]
        body = F.regexp_extract(whole, r"(?is)<body\b[^>]*>(.*)", 1)
        inside = F.when(whole.rlike(r"(?i)<body\b"), F.regexp_replace(body, r"(?is)</body\s*>.*$", "")).otherwise(whole)
        main = F.when(text_length(page["main"]) > vocab.MIN_MAIN_CHARS, page["main"])
        return F.coalesce(main, article, inside)

    return let(tree.parts(col(marked)), choose)


_LINE_BREAKS = r"\r\n\x0b\x0c\x1c\x1d\x1e\x85  "


def _collapse_spaces(fragment: Column) -> Column:
    """One space, or one line break, per run of whitespace."""
    untidy = fragment.contains("  ") | fragment.rlike(rf"[{_LINE_BREAKS}\t]")
    spaces = F.regexp_replace(fragment, r"[ \t]+", " ")
    return F.when(
        untidy, F.regexp_replace(spaces, rf" ?[{_LINE_BREAKS}][{_LINE_BREAKS} ]*", "\n")
    ).otherwise(fragment)


_SEPARATORS = ("|", "•", "·", ">", "-")


def _tidy_lines(text: Column) -> Column:
    """Lines trimmed, none of separators only, at most one blank line in a row; list items keep their indentation."""
    def trimmed(line: Column) -> Column:
        bare = F.btrim(line, F.lit(_BLANKS + tree.INDENT))
        width = F.length(F.regexp_extract(line, f"^{tree.INDENT}+", 0))
        return F.when(line.startswith(tree.INDENT) & (bare != ""), F.concat(F.repeat(F.lit(" "), width), bare)).otherwise(bare)

    lines = F.transform(F.split(text, "\n", -1), trimmed)
    kept = F.filter(
        lines,
        lambda line: ~(F.left(F.ltrim(line), F.lit(1)).isin(*_SEPARATORS) & line.rlike(r"^[\p{Zs}\t|•·>-]+$")),
    )
    return let(
        kept,
        lambda ls: strip(F.array_join(
            F.filter(ls, lambda line, i: (i == 0) | (line != "") | (F.get(ls, i - 1) != "")), "\n"
        )),
    )


def render(fragment: Column | str) -> Column:
    """Markdown of an HTML fragment: headings, links, nested lists, emphasis, blank-line blocks.

    Elements that are left open end with the one around them. Images leave nothing.
    """
    return _tidy_lines(decode_entities(tree.markdown(let(col(fragment), _collapse_spaces))))


def html_to_text(html: Column | str) -> Column:
    """Whole page to markdown in one expression; untruncated."""
    return render(main_fragment(markup(html)))
