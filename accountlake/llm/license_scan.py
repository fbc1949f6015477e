"""Short licence notices in texts, with a bounded number of errors.

Texts are read as lower-cased words with one space between them. A notice that may have k errors is cut
into k + 1 parts: wherever it stands with at most k edits, at least one part stands unchanged, so all parts of all notices,
searched in one pass by one automaton, give every place a notice can be at. Each such place is then verified in a window of
the notice's length: by the ``regex`` library's matching with bounded errors, from word end to word end.

Every word counts by its number from 0. Work grows with the text and its seeds; nothing is looked at twice for one notice.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import pick, shipped

CHARACTERS_PER_ERROR = 10
MOST_ERRORS = 4  # of a long notice

# Notices and the label of what they announce. The first four are the base: unchanged, they count as places.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = BASE + (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("artistic", "artistic license 2 0"),
    ("boost", "boost software license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0 universal"),
    ("cc0", "no rights reserved"),
    ("epl", "eclipse public license"),
    ("eupl", "european union public licence"),
    ("gfdl", "gnu free documentation license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mpl", "mozilla public license"),
    ("odbl", "open database license"),
    ("ofl", "sil open font license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "free and unencumbered software released into the public domain"),
)

# Lower-cased, with a space for every byte that is no part of a word: digits, a-z and all bytes beyond ASCII are.
_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_RUN = re.compile(rb"[^ ]+")


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    errors: int
    base: bool

    @cached_property
    def parts(self) -> list[tuple[int, str]]:
        """``errors + 1`` parts of nearly equal length and where they begin."""
        n, k = len(self.phrase), self.errors + 1
        ends = [n * i // k for i in range(k + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    @cached_property
    def pattern(self) -> regex.Pattern:
        return regex.compile(rf"(?b)(?<= )(?:{regex.escape(self.phrase)}){{e<={self.errors}}}(?= )")


def notices(
    pairs=NOTICES, base=BASE, per_error: int = CHARACTERS_PER_ERROR, most: int = MOST_ERRORS,
) -> list[Notice]:
    """Notices of ``(label, phrase)`` pairs, with one error per so many characters. Phrases are lower-cased words, one space between them."""
    return [Notice(label, p, min(len(p) // per_error, most), (label, p) in base) for label, p in dict.fromkeys([*base, *pairs])]


class Scanner:
    """Finds notices: an automaton over their parts, and the pattern of each."""

    def __init__(self, searched: list[Notice]):
        self.searched = searched
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(searched):
            for at, part in n.parts:
                seeds.setdefault(part, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for part, owners in seeds.items():
            self.automaton.add_word(part, (len(part), owners))
        self.automaton.make_automaton()

    def find(self, joined: str) -> list[tuple[int, int, int, int]]:
        """``(start, end, notice, edits)`` in a text of words with a space around each, by start.

        Spans of one notice do not overlap, but unchanged base notices: those are all found.
        """
        out = []
        behind = [0] * len(self.searched)  # where the last span of each notice ends
        looked: set[tuple[int, int]] = set()  # notices and places that parts have led to
        for last, (length, owners) in self.automaton.iter(joined):
            seed = last + 1 - length
            for i, at in owners:
                n = self.searched[i]
                start, size = seed - at, len(n.phrase)
                if start > 0 and joined[start - 1] == " " and joined.startswith(n.phrase, start) and joined[start + size] == " ":
                    if at == 0 and (n.base or start >= behind[i]):  # once: at its first part
                        out.append((start, start + size, i, 0))
                        behind[i] = max(behind[i], start + size)
                    continue
                if not n.errors or seed < behind[i] or (i, start) in looked:
                    continue
                left, right = max(start - n.errors, behind[i], 1), start + size + n.errors
                looked.add((i, start))
                found = n.pattern.search(joined, left - 1, min(right + 1, len(joined)))
                if found and sum(found.fuzzy_counts):
                    out.append((found.start(), found.end(), i, sum(found.fuzzy_counts)))
                    behind[i] = found.end()
        return self._settled(sorted(out))

    def _settled(self, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Without changed spans that overlap an unchanged one of their notice, which came to light only behind them."""
        exact: dict[int, list[tuple[int, int]]] = {}
        for start, end, i, edits in spans:
            if not edits:
                exact.setdefault(i, []).append((start, end))
        places = dict.fromkeys(exact, 0)
        out = []
        for start, end, i, edits in spans:
            if edits and i in exact:
                of = exact[i]
                while places[i] < len(of) and of[places[i]][1] <= start:
                    places[i] += 1
                if places[i] < len(of) and of[places[i]][0] < end:
                    continue
            out.append((start, end, i, edits))
        return out


def _offsets(raw: bytes, data: bytes, wanted: list[int]) -> dict[int, tuple[int, int]]:
    """Where words (by number, ascending) begin and end in a text, in code points."""
    out: dict[int, tuple[int, int]] = {}
    at = here = chars = 0
    for number, run in enumerate(_RUN.finditer(data)):
        if at == len(wanted):
            break
        if number == wanted[at]:
            chars += len(raw[here : run.start()].decode("utf-8", "surrogatepass"))
            end = chars + len(run.group().decode("utf-8", "surrogatepass"))
            out[number] = (chars, end)
            here, chars, at = run.end(), end, at + 1
    return out


SPAN = "struct<label string, phrase string, base boolean, first_word long, last_word long, start long, end long, edits int, likeness double>"


def license_spans(docs: DataFrame, searched: list[Notice] | None = None) -> DataFrame:
    """``doc_id, n_words, spans`` of every row: notices by first word, with their words, code points and edits.

    Null and empty texts have no words. Whole texts are read, whatever their length, in linear time. Rows that repeat or lack an id
    give a row each; an empty table gives none; other columns, also ones that differ in case only, are not read.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = shipped(docs.sparkSession, searched if searched is not None else notices())
    fields = [pa.field(*f) for f in (
        ("label", pa.string()), ("phrase", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64()))]
    kind = pa.list_(pa.struct(fields))

    def run(batches):
        scanner = Scanner(sent())

        def spans(text):
            raw = (text or "").encode("utf-8", "surrogatepass")
            data = raw.translate(_WORDS)
            words = data.split()
            # One character per byte: places in the automaton's text are those of the bytes.
            joined = b" ".join([b"", *words, b""]).decode("latin-1")
            out, at, number = [], 0, -1
            for start, end, i, edits in scanner.find(joined):
                number += joined.count(" ", at, start)  # spaces before a word: its number and one
                at = start
                n = scanner.searched[i]
                out.append([n, number, number + joined.count(" ", start, end), edits])
            if out:
                wanted = sorted({w for s in out for w in s[1:3]})
                places = _offsets(raw, data, wanted)
            return len(words), [
                (n.label, n.phrase, n.base and not edits, first, last, places[first][0], places[last][1], edits, 1 - edits / len(n.phrase))
                for n, first, last, edits in out]

        names = [f.name for f in fields]
        for batch in batches:
            found = [spans(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in found], pa.int64()),
                pa.array([[dict(zip(names, s, strict=True)) for s in ss] for _, ss in found], kind),
            ], names=["doc_id", "n_words", "spans"])

    return rows.mapInArrow(run, f"doc_id long, n_words long, spans array<{SPAN}>")


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts, places and labels per row of :func:`license_spans`; ``score`` is the likeness of the best notice, 0 without one."""
    base = F.filter("spans", lambda s: s["base"])
    first = F.transform(base, lambda s: s["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"), _labels(base).alias("base_labels"), _labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["likeness"])), F.lit(0.0)).alias("score"))
