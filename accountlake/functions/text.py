"""Text primitives shared by the page, probe and scoring functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, functions as F

from accountlake import vocab

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a computed value several times while evaluating it once."""
    return F.transform(F.array(value), body)[0]


def let_sql(value: Column, body: str) -> Column:
    """``let`` with the body as a SQL lambda, for long bodies that are used in many places."""
    return F.call_function("transform", F.array(value), F.expr(body))[0]


def strings(values: Sequence[str]) -> Column:
    """Literal string array; typed also when empty."""
    return F.split(F.lit("\x1e".join(values)), "\x1e") if values else F.array().cast("array<string>")


def sql_table(table: Mapping[str, str]) -> str:
    """A fixed table as a SQL map literal."""
    text = "\x1e".join(f"{k}\x1f{v}" for k, v in table.items()).replace("\\", "\\\\").replace("'", "\\'")
    return f"str_to_map('{text}', '\x1e', '\x1f')"


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a key in a fixed table, else null. The table is one literal, folded into the plan once."""
    return F.try_element_at(F.expr(sql_table(table)), key)


def strip(c: Column | str) -> Column:
    """Drop whitespace at both ends, no-break and other Unicode spaces included."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def squash(c: Column | str) -> Column:
    """Every run of whitespace becomes one space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


# Names with their semicolon, and the old ones that also count without it (the longest that fits).
_NAMED = {name: text for name, text in html5.items() if name.endswith(";")}
_BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
_BARE_NAME = "|".join(sorted(_BARE, key=lambda name: (-len(name), name)))
# Numbers 128 to 159 mean characters of this code page.
_WESTERN = {str(128 + i): text for i, text in enumerate(bytes(range(128, 160)).decode("cp1252", "replace")) if text != "\ufffd"}
_NUMBER = r"^#(?:[xX][0-9a-fA-F]+|[0-9]+)"
_DIGITS = "regexp_replace(substring(n, 2), '^[xX]?0*', '')"
# More than eight digits are out of range whatever they are.
_CODE = f"""CASE WHEN length({_DIGITS}) > 8 THEN 1114112 WHEN lower(substring(n, 2, 1)) = 'x'
    THEN cast(conv(concat('0', {_DIGITS}), 16, 10) AS bigint) ELSE cast(concat('0', {_DIGITS}) AS bigint) END"""
_CHARACTER = f"""coalesce(try_element_at({sql_table(_WESTERN)}, cast(k AS string)), decode(unhex(lpad(hex(
    CASE WHEN k BETWEEN 1 AND 1114111 AND k NOT BETWEEN 55296 AND 57343 THEN k ELSE 65533 END), 8, '0')), 'UTF-32'))"""
# One reference: p is the text after an ampersand, n the reference's name or number.
_DECODE_NUMBER = f"""transform(array(regexp_extract(p, r'{_NUMBER}', 0)), n -> concat(
    transform(array({_CODE}), k -> {_CHARACTER})[0], regexp_replace(substring(p, length(n) + 1), '^;', '')))[0]"""
_DECODE_NAME = f"""coalesce(
    transform(array(regexp_extract(p, r'^[A-Za-z][A-Za-z0-9]*;', 0)), n -> concat(
        try_element_at({sql_table(_NAMED)}, n), substring(p, length(n) + 1)))[0],
    transform(array(regexp_extract(p, r'^(?:{_BARE_NAME})', 0)), n -> concat(
        try_element_at({sql_table(_BARE)}, n), substring(p, length(n) + 1)))[0],
    concat('&', p))"""
_DECODE_PIECE = f"""CASE WHEN p RLIKE r'{_NUMBER}' THEN {_DECODE_NUMBER} ELSE {_DECODE_NAME} END"""
_DECODE = f"""v -> CASE WHEN contains(v, '&') THEN
    array_join(transform(split(v, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {_DECODE_PIECE} END), '')
    ELSE v END"""


def decode_entities(c: Column | str) -> Column:
    """Replace HTML character references, each exactly once."""
    return let_sql(col(c), _DECODE)


def content_hash(c: Column | str) -> Column:
    return F.left(F.sha2(col(c).cast("binary"), 256), F.lit(16))


def tokens(c: Column | str) -> Column:
    """Distinct lower-case word tokens of at least three characters."""
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({vocab.TOKEN_PATTERN})"), 1))


def token_hashes(text: Column | str) -> Column:
    """The tokens of a text as 64-bit hashes: sets that are small to shuffle and quick to compare."""
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def token_overlap(a: Column | str, b: Column | str) -> Column:
    """Shared share of two token sets; 0 when either is empty."""
    a, b = col(a), col(b)
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)),
    ).otherwise(F.lit(0.0))


def contained(haystack: Column, needles: Sequence[str]) -> Column:
    """The needles found in the text, in list order."""
    hits = F.array(*[F.when(haystack.contains(n), F.lit(n)) for n in needles]) if needles else strings(())
    return F.array_compact(hits)


def count_contained(haystack: Column, needles: Sequence[str]) -> Column:
    return sum((haystack.contains(n).cast("int") for n in needles), F.lit(0))


def any_contained(haystack: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | haystack.contains(n)
    return hit


_SPECIAL = frozenset(".^$*+?{}[]\\|()")


# What a pattern holds besides plain text: escapes, classes, the dot, and characters that may be missing or repeat.
_NOT_PLAIN = re.compile(r"\\(?:[bBsSdDwW]|[^A-Za-z0-9\s])[?+]*|\[[^\[\]\\&]+\][?+]*|\.[?+]*|[^\\\[\]?+][?+]+")


def needles(pattern: str) -> list[str]:
    """Texts one of which is in everything the pattern finds; none where that cannot be told at a glance.

    Looked at are plain sequences, and ``\\b(one|other)\\b``.
    """
    group = re.fullmatch(r"\\b\(([^()]*)\)\\b", pattern)
    found = []
    for branch in (group[1] if group else pattern).split("|") if group or "|" not in pattern else [""]:
        runs = _NOT_PLAIN.sub("\0", branch).split("\0")
        longest = max(runs, key=len)
        if not longest or not all(_SPECIAL.isdisjoint(run) for run in runs):
            return []
        found.append(longest)
    return found


def any_matches(haystack: Column, patterns: Sequence[str]) -> Column:
    """True when one of the patterns is found; ``\\b`` and ``\\s`` know all of Unicode.

    A pattern without special characters is a plain substring test. Such a test also goes before a pattern whose words are known:
    most texts have none of them.
    """
    hit = F.lit(False)
    for p in patterns:
        if _SPECIAL.isdisjoint(p):
            hit = hit | haystack.contains(p)
            continue
        found = haystack.rlike(f"(?U){p}" if "\\" in p else p)
        words = needles(p)
        hit = hit | (reduce(lambda a, b: a | b, map(haystack.contains, words)) & found if words else found)
    return hit


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    # In bytes: a text knows how many it has, its characters would be counted anew for every needle.
    removed = F.octet_length(haystack) - F.octet_length(F.replace(haystack, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle.encode()))).cast("int")


def first_marker(c: Column | str, markers: Sequence[str], window: int = vocab.MARKER_WINDOW) -> Column:
    """First marker, in list order, that occurs in the first ``window`` characters of the text; else null.

    Not-found and sign-in copy stands at the top of a page; further down the words are ordinary prose.
    """
    opening = F.lower(F.left(F.coalesce(col(c), F.lit("")), F.lit(window)))
    return let(
        opening,
        lambda o: F.coalesce(*[F.when(o.contains(m), F.lit(m)) for m in markers], F.lit(None).cast("string")),
    )


def shortened(c: Column | str, limit: int | None) -> Column:
    """The first ``limit`` characters; the whole text where none is asked for."""
    return col(c) if limit is None else F.left(col(c), F.lit(limit))


def truncate(c: Column | str, limit: int | None = None) -> Column:
    """Cut text longer than ``limit`` back to its last line break and say so; None keeps the whole text."""
    if limit is None:
        return col(c)

    def shorten(text: Column) -> Column:
        cut = F.left(text, F.lit(limit))
        last_line = F.length(F.substring_index(cut, "\n", -1))
        kept = F.when(cut.contains("\n"), F.left(cut, F.length(cut) - last_line - 1)).otherwise(cut)
        return F.when(F.length(text) > limit, F.concat(kept, F.lit(vocab.TRUNCATION_MARK))).otherwise(text)

    return let(col(c), shorten)


def normalise_text(c: Column | str) -> Column:
    """Lower case, punctuation to spaces, runs of whitespace to one space."""
    return F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def first_paragraph(c: Column | str) -> Column:
    """First block of running text between 40 and 300 characters, markup characters removed."""
    blocks = F.transform(
        F.split(col(c), "\n\n"), lambda b: strip(F.regexp_replace(b, r"[#*_>\[\]()]", ""))
    )
    usable = F.filter(
        blocks, lambda b: F.length(b).between(40, 300) & ~F.lower(b).startswith("http")
    )
    return F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit(""))


def company_name(title: Column | str, domain: Column | str) -> Column:
    """Shortest part of the title between separators, else the capitalised host label."""
    title, domain = col(title), col(domain)
    parts = F.transform(
        F.split(title, r"(?U)\s*[|–—-]\s*", -1),
        lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("part")),
    )
    label = F.substring_index(domain, ".", 1)
    fallback = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substring(label, 2, F.length(label))))
    return let(
        strip(F.array_min(parts)["part"]),
        lambda best: F.when(F.length(best).between(2, 60), best).otherwise(fallback),
    )
