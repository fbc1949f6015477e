"""Domains and URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from accountlake.functions.text import col, let_sql, strip

_SPLIT_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)"


def domain_of(c: Column | str) -> Column:
    """Bare host of a URL or a typed-in domain; null when there is none."""
    c = F.lower(strip(c))
    has_scheme = c.rlike("^https?://")
    rest = F.regexp_replace(c, "^https?://", "")
    host = F.when(has_scheme, F.regexp_extract(rest, "^[^/?#]*", 0)).otherwise(
        F.substring_index(rest, "/", 1)
    )
    host = F.substring_index(host, "@", -1)
    host = F.regexp_replace(host, r"^www\.", "")
    host = F.substring_index(host, ":", 1)
    return F.when(host.contains("."), host)


def domain_error(c: Column | str) -> Column:
    """Why ``domain_of`` gives null; null when it does not."""
    c = col(c)
    return (
        F.when(F.coalesce(strip(c), F.lit("")) == "", F.lit("Empty domain."))
        .when(domain_of(c).isNull(), F.concat(F.lit("Not a domain: '"), c, F.lit("'")))
    )


def candidate_urls(domain: Column | str) -> Column:
    """Where a homepage may live, in the order to try."""
    domain = col(domain)
    return F.array(
        F.concat(F.lit("https://"), domain, F.lit("/")),
        F.concat(F.lit("https://www."), domain, F.lit("/")),
    )


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), _SPLIT_URL, 1))


def url_host(c: Column | str) -> Column:
    """Authority part of an absolute URL, lower case."""
    return F.lower(F.regexp_extract(col(c), _SPLIT_URL, 2))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), _SPLIT_URL, 3)


def is_root(url: Column | str) -> Column:
    return F.btrim(url_path(url), F.lit("/")) == ""


_FOLD_DOTS = """aggregate(split(p, '/'), cast(array() AS array<string>), (done, s) ->
    CASE WHEN s = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) WHEN s = '.' THEN done
         ELSE concat(done, array(s)) END)"""
_RESOLVE = f"""v -> CASE
    WHEN v.href RLIKE r'^[A-Za-z][A-Za-z0-9+.-]*:' THEN v.href
    WHEN startswith(v.href, '//') THEN concat(regexp_extract(v.base, r'{_SPLIT_URL}', 1), ':', v.href)
    WHEN startswith(v.href, '#') THEN concat(regexp_replace(v.base, '#.*$', ''), v.href)
    WHEN startswith(v.href, '?') THEN concat(regexp_extract(v.base, r'{_SPLIT_URL}', 0), v.href)
    ELSE concat(
        regexp_extract(v.base, r'{_SPLIT_URL}', 1), '://', regexp_extract(v.base, r'{_SPLIT_URL}', 2),
        transform(
            array(CASE WHEN startswith(v.href, '/') THEN regexp_extract(v.href, '^[^?#]*', 0)
                  ELSE regexp_replace(concat('/', regexp_replace(regexp_extract(v.base, r'{_SPLIT_URL}', 3), '[^/]*$', ''),
                                             regexp_extract(v.href, '^[^?#]*', 0)), '/{{2,}}', '/') END),
            p -> CASE WHEN p RLIKE r'/\\.\\.?(/|$)'
                      THEN concat('/', ltrim('/', array_join(
                          concat({_FOLD_DOTS}, CASE WHEN p RLIKE r'/\\.\\.?$' THEN array('') ELSE array() END), '/')))
                      ELSE p END)[0],
        regexp_extract(v.href, r'[?#].*$', 0)) END"""


def absolute_url(base: Column | str, href: Column) -> Column:
    """Resolve a link against the page it was found on; ``.`` and ``..`` segments are folded."""
    return let_sql(F.struct(col(base).alias("base"), href.alias("href")), _RESOLVE)
