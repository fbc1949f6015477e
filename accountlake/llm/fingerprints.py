"""Context-triggered piecewise hashing of whole texts.

A hash rolls over the last seven bytes. A byte whose rolling hash ends in ``level`` zero bits
ends a chunk; every chunk gives one of 64 characters. The level is chosen so that a text has
some 32 to 64 chunks, and the signatures of the levels below and above stand beside it, so
fingerprints of texts up to four times as long as each other can be compared:
``block:signature:signature of twice the block:signature of four times the block``.
Likeness is one less the edit distance over the longer length, for signatures of the same
block size that share a run of seven characters; otherwise 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountlake.llm.common import pick, saved

WINDOW = 7
LONGEST = 128  # characters of a signature
FEWEST = 32  # chunks a text should have at its own level
RUN = 7  # characters two signatures must share in a row
BLOCK = 1 << 16  # bytes hashed at a time
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_MOD = 1 << 64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, _MOD)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = np.random.default_rng(20240101).integers(1, _MOD, 256, dtype=np.uint64)
_UP = _powers(_BASE, BLOCK + WINDOW)
_DOWN = _powers(_INVERSE, BLOCK + WINDOW)
_LETTERS = np.frombuffer(ALPHABET, dtype=np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _triggers(data: bytes, level: int):
    """Ends of chunks at ``level`` or above, their zero bits, and the prefix hash there; the whole's hash.

    The prefix hash of ``p`` is the sum of ``byte[i] * base**i`` below ``p``.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    mask = np.uint64((1 << level) - 1)
    ends, bits, sums = [], [], []
    carry = np.uint64(0)
    for start in range(0, len(raw), BLOCK):
        lead = min(start, WINDOW)  # bytes before this block that its first windows cover
        part = _BYTE[raw[start - lead : start + BLOCK]]
        n = len(part)
        total = np.cumsum(part * _UP[:n], dtype=np.uint64)
        window = total.copy()
        if n > WINDOW:
            window[WINDOW:] -= total[:-WINDOW]
        rolled = _mixed(window * _DOWN[:n])[lead:]
        at = np.flatnonzero((rolled & mask) == 0)
        scale = np.uint64(pow(_BASE, start - lead, _MOD))
        base = total[lead - 1] if lead else np.uint64(0)
        ends.append(at + start + 1)
        bits.append(rolled[at])
        sums.append(carry + (total[at + lead] - base) * scale)
        carry = carry + (total[-1] - base) * scale
    return np.concatenate(ends), np.concatenate(bits), np.concatenate(sums), carry


def _signature(ends: np.ndarray, sums: np.ndarray, length: int, whole: np.uint64) -> str:
    if len(ends) and ends[-1] == length:
        ends, sums = ends[:-1], sums[:-1]
    # Of too many chunks, two, four, ... neighbours give one character: a signature spans the whole text.
    each = 1
    while len(ends) // each >= LONGEST:
        each *= 2
    ends, sums = ends[each - 1 :: each], sums[each - 1 :: each]
    starts = np.concatenate(([0], ends))
    high = np.concatenate((sums, [whole]))
    low = np.concatenate((np.zeros(1, np.uint64), sums))
    down = _DOWN[starts] if starts[-1] < len(_DOWN) else np.array(
        [pow(_INVERSE, int(s), _MOD) for s in starts], dtype=np.uint64
    )
    chunk = _mixed((high - low) * down)
    return _LETTERS[(chunk >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """The fingerprint of a text's bytes; ``1:::`` for the empty text."""
    n = len(data)
    if not n:
        return "1:::"
    with np.errstate(over="ignore"):
        most = max(0, n.bit_length() - 5)  # at this level some 16 to 32 chunks are expected
        least = max(0, most - 4)
        while True:
            ends, bits, sums, whole = _triggers(data, least)
            level = most
            while level > least + (least > 0) and np.count_nonzero((bits & np.uint64((1 << level) - 1)) == 0) + 1 < FEWEST:
                level -= 1
            if level > least + 1 or least == 0:
                break
            most, least = least, max(0, least - 4)
        signs = []
        first = max(0, level - 1)
        # Where chunks are dense, the first level at which they fit; but where hardly any are left there (one passage
        # again and again), the level before, by groups of chunks.
        inner = bits[ends < n]
        while np.count_nonzero((inner & np.uint64((1 << first) - 1)) == 0) >= LONGEST:
            after = np.count_nonzero((inner & np.uint64((1 << (first + 1)) - 1)) == 0)
            if after + 1 < FEWEST:
                break
            first += 1
        for x in (first, first + 1, first + 2):
            on = (bits & np.uint64((1 << x) - 1)) == 0
            signs.append(_signature(ends[on], sums[on], n, whole))
    return ":".join([str(1 << first), *signs])


def _share_run(a: str, b: str) -> bool:
    runs = {a[i : i + RUN] for i in range(len(a) - RUN + 1)}
    return any(b[i : i + RUN] in runs for i in range(len(b) - RUN + 1))


def _pairs(a: str, b: str):
    """Signatures of the same block size."""
    block_a, *signs_a = a.split(":")
    block_b, *signs_b = b.split(":")
    of_b = {int(block_b) << i: x for i, x in enumerate(signs_b)}
    return [(x, of_b[int(block_a) << i]) for i, x in enumerate(signs_a) if int(block_a) << i in of_b]


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of many pairs of signatures at once, row by row of the table."""
    n = len(left)
    a = np.zeros((n, LONGEST), np.uint8)
    b = np.zeros((n, LONGEST), np.uint8)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[i, : len(y)] = np.frombuffer(y.encode(), np.uint8)
    len_a = np.array([len(x) for x in left])
    len_b = np.array([len(x) for x in right])
    step = np.arange(LONGEST + 1, dtype=np.int16)
    row = np.repeat(step[None, :], n, axis=0)
    out = len_b.astype(np.int16)
    for i in range(int(len_a.max(initial=0))):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(new - step, axis=1) + step
        done = len_a == i + 1
        out[done] = row[done, len_b[done]]
    return out


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints; equal fingerprints give 1."""
    out = [0.0] * len(pairs)
    owner, left, right = [], [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = 1.0
            continue
        for x, y in _pairs(a, b):
            if _share_run(x, y):
                owner.append(i)
                left.append(x)
                right.append(y)
    for s in range(0, len(owner), 512):
        x, y = left[s : s + 512], right[s : s + 512]
        for i, d, p, q in zip(owner[s : s + 512], distances(x, y).tolist(), x, y, strict=True):
            out[i] = max(out[i], 1.0 - d / max(len(p), len(q)))
    return out


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by the first as many code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
    "near_edited double, near_next double"
KINDS = f"kind int, part int, {RESULT}, text string"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string()),
])


def _digests(ids: list, texts: list[str], prints: list[str], after: list[str], prints_after: list[str]) -> list[tuple]:
    changed = [edited(a, b).encode() for a, b in zip(texts, after, strict=True)]
    marks = [fingerprint(x) for x in changed]
    near = likeness(list(zip(prints, marks, strict=True)) + list(zip(prints, prints_after, strict=True)))
    n = len(texts)
    return [
        (ids[i], len(texts[i]), hashlib.sha256(changed[i]).hexdigest(), prints[i], marks[i], near[i], near[n + i])
        for i in range(n)
    ]


def _walk(batches):
    """Each row with the row after it; the first and the last text of the range go on for the seams."""
    part = TaskContext.get().partitionId()
    held = None  # the row that waits for the next one
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not ids:
            continue
        prints = [fingerprint(x.encode()) for x in texts]
        rows = []
        if held is None:
            rows.append((0, part, ids[0], None, None, prints[0], None, None, None, texts[0]))
        else:
            ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
        done = _digests(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
        rows += [(1, part, *r, None) for r in done]
        held = ids[-1], texts[-1], prints[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW
        ) if rows else pa.RecordBatch.from_pylist([], schema=_ARROW)
    if held is not None:
        row = (2, part, held[0], None, None, held[2], None, None, None, held[1])
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def _seams(batches):
    schema = pa.schema(list(_ARROW)[2:9])
    for batch in batches:
        rows = batch.to_pylist()
        if not rows:
            continue
        done = _digests(
            [r["doc_id"] for r in rows], [r["text"] for r in rows], [r["fingerprint"] for r in rows],
            [r["after"] for r in rows], [r["after_print"] for r in rows],
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint of every whole text, one pass and no shuffle.

    Null texts count as empty (``1:::``); repeated rows give repeated rows, an empty table an empty one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            marks = [fingerprint(x.encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _texts(docs: DataFrame) -> DataFrame:
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint beside those of its edited form and of the next document.

    The next document is the one with the next larger ``doc_id`` (nulls last, rows of equal id by
    text); after the last one comes the first. Texts are shuffled once, by ranges of ``doc_id``;
    inside a range each task walks its sorted rows and holds one of them at a time. What joins the
    last row of a range to the first of the next are one text per range.
    A table of one row is its own next document; an empty table gives no rows.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    walked = saved(
        _texts(docs).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, KINDS), "fingerprints"
    )
    heads = walked.where("kind = 0").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    parts = heads.select("part")
    by_part = Window.orderBy("part")
    links = parts.select(
        "part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    tails = walked.where("kind = 2").select("part", "doc_id", "fingerprint", "text")
    seams = tails.join(links, "part").join(heads.withColumnRenamed("part", "next_part"), "next_part")
    names = [x.split()[0] for x in RESULT.split(", ")]
    return walked.where("kind = 1").select(*names).unionByName(seams.mapInArrow(_seams, RESULT).select(*names))
