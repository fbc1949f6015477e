"""Secrets in texts: three fixed patterns, and windows of high entropy in candidate strings.

Candidates are maximal runs of a character class. A window slides over each; its Shannon entropy
follows from counts that change by one character in and one out. Windows at or above the class's
threshold are merged into spans, unless allow-list patterns cover the span or a pattern
already reported the place.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import pick

# Fixed patterns.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _table(chars: bytes) -> bytes:
    return bytes(120 if c in chars else 46 for c in range(256))


_DIGITS = b"0123456789"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_HEX_TABLE, _HEX_RUN = _table(b"0123456789abcdef"), b"x" * 16


@dataclass(frozen=True)
class CharClass:
    """A class of characters, how wide its window is and when a window counts as random.

    ``parts`` are patterns that must all occur in a window: a random key mixes them, a word does not.
    """

    name: str
    chars: bytes
    window: int
    bits: float
    parts: tuple[str, ...]


CLASSES = (
    CharClass("entropy_base64", _LOWER + _UPPER + _DIGITS + b"+/_-", 24, 3.9, ("[0-9]", "[A-Z]", "[a-z]")),
    CharClass("entropy_hex", _DIGITS + b"ABCDEF", 24, 3.0, ("[0-9]", "[A-F]")),
    CharClass("entropy_base32", _UPPER + b"234567", 24, 3.7, ("[2-7]", "[A-Z]")),
    # Keys of 16 characters on. Digits stand between letters; capitals come more often than words begin.
    CharClass("entropy_lower", _LOWER + _DIGITS, 16, 3.25, ("[0-9][a-z]+[0-9]", "[a-z][0-9]+[a-z]")),
    CharClass("entropy_upper", _UPPER + _DIGITS, 16, 3.25, ("[0-9][A-Z]+[0-9]", "[A-Z][0-9]+[A-Z]")),
    CharClass("entropy_letters", _LOWER + _UPPER, 16, 3.4, ("[A-Z]{2}", "(?:[a-z]{0,3}[A-Z]){5}", "(?:[a-z]{1,3}[A-Z]{1,3}){2}")),
    CharClass("entropy_short", _LOWER + _UPPER + _DIGITS, 16, 3.45, ("[0-9]", "[A-Z]", "[a-z]")),
    CharClass("entropy_short", _LOWER + _UPPER + _DIGITS + b"+/_-", 16, 3.45,
              ("[A-Za-z][0-9]+[A-Za-z]", "[A-Z]", "[a-z]", "[a-z0-9+/_-][A-Z]+[a-z0-9+/_-]+[A-Z]")),
)

# Words as names and addresses have them: a key has single letters between its digits and capitals. None of these patterns starts
# inside a run of its own characters or goes back over one, so texts without spaces cost no more than others.
_WORDS = r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++|[A-Za-z](?![A-Za-z0-9])|[._~%+-]++)"

# Strings that look random but are not secret. They end at quotes, commas, brackets, ``&`` and ``=``.
ALLOWED = (
    # Addresses: scheme, host and the parts that are words. Names and passwords before a host are not allowed, nor keys in a path.
    rf"""https?://[\w.-]++(?::[0-9]++)?+(?![\w.:@-])(?:[/?\#;]++{_WORDS}++(?=[/?\#;]|$|[\s"'`<>,()\[\]{{}}&=]))*+""",
    r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUIDs
    rf"(?<![\w.+:/-]){_WORDS}++@[\w-]+\.[\w.]+",  # mail addresses of names that are words
    r"(?:sha(?:1|256|384|512)|md5)[-:=][A-Za-z0-9+/_-]+",  # checksums of public files
)
# A candidate with such a word is a sample from a manual, unless as much as a window is left beside the word.
SAMPLE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]*(?:EXAMPLE|[Ee]xample)[A-Za-z0-9]*")
LEAST = 16  # characters beside allowed strings that make a span of their own
SAMPLE_LEAST = 24


def left_over(span: tuple[int, int], ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a span lies outside ``ranges``, which are sorted and apart."""
    out, at = [], span[0]
    for i in range(bisect_right(ranges, span[0], key=itemgetter(1)), len(ranges)):
        s, e = ranges[i]
        if s >= span[1]:
            break
        if at < s:
            out.append((at, s))
        at = max(at, e)
    if at < span[1]:
        out.append((at, span[1]))
    return out


class Taken:
    """Places in a text that are reported already: sorted, apart, looked up by halving."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        """A span that touches none."""
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def entropy_windows(text: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of all windows of ``width`` characters with at least ``bits`` of entropy.

    The sum of ``c * log2(c)`` over the counts is kept as the window moves.
    """
    if len(text) < width:
        return []
    plogp = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    limit = (math.log2(width) - bits) * width + 1e-9  # entropy = log2(width) - total / width
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        if i >= width:
            old = text[i - width]
            d = counts[old]
            counts[old] = d - 1
            total += plogp[d - 1] - plogp[d]
            c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += plogp[c + 1] - plogp[c]
        if i >= width - 1 and total <= limit:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


class Scanner:
    """Finds secrets in one text at a time."""

    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [
            (c, re.compile("[%s]{%d,}" % (re.escape(c.chars.decode()), c.window)), _table(c.chars), b"x" * c.window,
             [re.compile(p) for p in c.parts])
            for c in classes
        ]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None

    @staticmethod
    def base(text: str, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` of the fixed patterns, sorted. Bytes decide whether a pattern is tried."""
        found = []
        low = data.lower()
        if any(k in low for k in _KEYS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        if b"AKIA" in data:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
        if _HEX_RUN in data.translate(_HEX_TABLE):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def random(self, text: str, data: bytes, known: list[tuple[int, int, int]]) -> list[tuple[int, str, int]]:
        """Spans of high entropy that touch neither a known span nor one of a class before."""
        found: list[tuple[int, str, int]] = []
        taken = Taken([(a, b) for a, _, b in known])
        allowed = None
        for c, pattern, table, run, parts in self.classes:
            if run not in data.translate(table):
                continue
            for m in pattern.finditer(text):
                word = m.group()
                if not all(p.search(word) for p in parts):
                    continue
                if allowed is None:
                    allowed = [x.span() for x in self.allowed.finditer(text)] if self.allowed else []
                for a, b in entropy_windows(word, c.window, c.bits):
                    span = m.start() + a, m.start() + b
                    mixed = all(p.search(word, a, b) for p in parts)
                    if not mixed or taken.touches(*span):
                        continue
                    if self.secret(text, span, m.span(), allowed, parts):
                        found.append((span[0], c.name, span[1]))
                        taken.add(*span)
        return found

    def secret(self, text: str, span: tuple[int, int], run: tuple[int, int], allowed: list[tuple[int, int]],
               parts: list[re.Pattern]) -> bool:
        """Whether enough of a span lies outside what is allowed, and enough of its run beside words of samples."""
        def enough(whole, ranges, least):
            rest = left_over(whole, ranges)
            return rest == [whole] or any(
                b - a >= least and a < span[1] and span[0] < b and all(p.search(text, a, b) for p in parts) for a, b in rest)

        if not self.allowed:
            return True
        samples = [(run[0] + m.start(), run[0] + m.end()) for m in SAMPLE.finditer(text[slice(*run)])]
        return enough(span, allowed, LEAST) and enough(run, samples, SAMPLE_LEAST)

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
        data = text.encode("utf-8", "surrogatepass")
        known = self.base(text, data)
        return known, self.random(text, data, known)


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ("added", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
])
SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (code points, end exclusive) of every whole text.

    One pass, no shuffle, in proportion to the text, spaces or not. Null and empty texts have no spans; repeated rows give repeated rows,
    null ids stay null, an empty table gives no rows; other columns, also ones that differ in case only, are not read.
    ``base`` is in order of start, then kind as listed; ``added`` in order of start.
    """
    def run(batches):
        scanner = Scanner(classes, allowed)
        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                known, more = scanner.scan(text)
                base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in known])
                added.append([{"kind": k, "start": a, "end": b} for a, k, b in sorted(more)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, _SCHEMA.field(1).type), pa.array(added, _SCHEMA.field(2).type)],
                schema=_SCHEMA,
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"))
        .mapInArrow(run, f"doc_id long, base {SPANS}, added {SPANS}")
    )


def digests(spans: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and the list of all, as text."""
    def written(column):
        return F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = F.array(*[F.lit(k) for k in (*KINDS, *[c.name for c in CLASSES])])

    def keyed(s):
        return F.struct(s["start"], F.array_position(kinds, s["kind"]).alias("order"), s["kind"], s["end"])

    everything = F.array_sort(F.transform(F.concat("base", "added"), keyed))
    return spans.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(F.array_join(written("base"), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(written(everything), ",").alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
