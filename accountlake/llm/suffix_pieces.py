"""Encoding and decoding with a public SentencePiece vocabulary by suffix-array matching.

The distinct words of a batch are written one after the other and their suffixes sorted. Every piece
of the vocabulary is looked up by binary search; the range it is found in lists where it occurs. These
occurrences are edges between places in words. Sorted by where they end, they are relaxed: a place
is reached by the one piece that can follow the piece its start was reached by.

The vocabulary is one of byte-pair merges. For those, a row of pieces is the encoding of its text
exactly if every two neighbours are the encoding of theirs; so each place of a word has one last piece,
and an edge is good if its piece and the last piece of its start stay apart when merged. That is
told by undoing merges, the latest first, and looking for an earlier merge across the seam.
Results are those of the library: same ids, and the text again by decoding.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import pick, shipped

SPACE = "▁"
LONG = 1_000  # bytes of a word that is walked on its own
STRETCH = 1 << 16  # bytes of a long word looked at together
INDEX_BYTES = 1 << 19  # words indexed together
KNOWN_BYTES = 1 << 27  # memory of words a task remembers before it starts anew, by estimate
ENTRY_BYTES = 250  # of that for each word beside its characters
_END = 0xFF  # between words of the index; no UTF-8 text holds it
_FREE, _START = -1, -2


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model, as arrays."""

    pieces: list[bytes]  # by id; spaces as spaces, byte pieces as their byte
    matched: np.ndarray  # ids of the pieces that occur in texts, sorted by their bytes
    heads: np.ndarray  # their first and next eight bytes as numbers, and the sizes
    tails: np.ndarray
    sizes: np.ndarray  # by id
    order: np.ndarray  # by id: when the merge that makes the piece happens; characters first
    left: np.ndarray  # by id: the two pieces merged into it last, itself for characters
    right: np.ndarray
    pair_keys: np.ndarray  # open hash table of pairs that merge
    pair_order: np.ndarray
    probes: int
    letters: frozenset[str]
    byte_ids: np.ndarray
    runs: dict[int, int]  # spaces in a row -> piece


def _merge_last(word: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last two pieces that merging makes of a word; None if it does not end as one piece."""
    parts = list(word)
    while len(parts) > 2:
        best = min(
            ((rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank),
            default=None,
        )
        if best is None:
            return None
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and parts[0] + parts[1] in rank else None


def _number(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big")


_HASH = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> Vocabulary:
    """Read a model file; merges and splits follow from the order of its scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = {names[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    pieces = [b""] * n
    byte_ids = np.zeros(256, np.int32)
    for i, name in enumerate(names):
        if model.is_byte(i):
            value = int(name[3:5], 16)
            pieces[i], byte_ids[value] = bytes([value]), i
        elif name in plain:
            pieces[i] = name.replace(SPACE, " ").encode()
    runs = {len(x): i for x, i in plain.items() if not x.strip(SPACE)}
    words = {x: i for x, i in plain.items() if SPACE * 2 not in x}
    letters = sorted(x for x in words if len(x) == 1)
    merged = sorted((x for x in words if len(x) > 1), key=lambda x: (-model.get_score(words[x]), words[x]))
    rank = {x: i for i, x in enumerate(merged)}
    order = np.full(n, 1 << 30, np.int32)
    left, right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
    for i, x in enumerate(letters):
        order[words[x]] = i
    pairs: dict[int, int] = {}
    used = [words[x] for x in letters]
    for x in merged:
        last = _merge_last(x, rank)
        if last is None or any(p not in words for p in last):
            continue  # no text is ever merged to this piece
        i = words[x]
        order[i] = len(letters) + rank[x]
        left[i], right[i] = words[last[0]], words[last[1]]
        used.append(i)
        for cut in range(1, len(x)):
            a, b = words.get(x[:cut]), words.get(x[cut:])
            if a is not None and b is not None:
                pairs[a * n + b] = order[i]
    size = 1 << max(4, (len(pairs) * 8).bit_length())
    keys, values, probes = np.full(size, -1, np.int64), np.zeros(size, np.int32), 1
    shift = 64 - size.bit_length() + 1
    for k, v in pairs.items():
        at, step = ((k * int(_HASH)) & ((1 << 64) - 1)) >> shift, 1
        while keys[at] >= 0:
            at, step = (at + 1) % size, step + 1
        keys[at], values[at], probes = k, v, max(probes, step)
    used.sort(key=lambda i: pieces[i])
    return Vocabulary(
        pieces, np.array(used, np.int32), np.array([_number(pieces[i], 0) for i in used], np.uint64),
        np.array([_number(pieces[i], 8) for i in used], np.uint64), np.array([len(p) for p in pieces], np.int32), order, left,
        right, keys, values, probes, frozenset(x.replace(SPACE, " ") for x in letters), byte_ids, runs,
    )


def _pair_order(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """When two pieces merge; a large number if they never do."""
    key = a.astype(np.int64) * len(v.pieces) + b
    size = len(v.pair_keys)
    at = ((key.astype(np.uint64) * _HASH) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    out = np.full(len(a), 1 << 30, np.int32)
    open_ = np.arange(len(a))
    for _ in range(v.probes):
        there = v.pair_keys[at]
        hit = there == key
        out[open_[hit]] = v.pair_order[at[hit]]
        more = ~hit & (there >= 0)
        if not more.any():
            break
        open_, at, key = open_[more], (at[more] + 1) % size, key[more]
    return out


def stay_apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each two pieces, merged as one text, come out as these two again."""
    out = np.zeros(len(a), bool)
    at = np.arange(len(a))
    limit = np.full(len(a), 1 << 29, np.int64)  # merges across the seam before this would have happened
    a, b = a.copy(), b.copy()
    while len(at):
        go = _pair_order(v, a, b) >= limit
        at, a, b, limit = at[go], a[go], b[go], limit[go]
        whole_a, whole_b = v.left[a] == a, v.left[b] == b
        done = whole_a & whole_b
        out[at[done]] = True
        go = ~done
        at, a, b, limit, whole_a, whole_b = at[go], a[go], b[go], limit[go], whole_a[go], whole_b[go]
        # Undo the later of the two merges. Of equal ones the right one comes later.
        undo_a = ~whole_a & (whole_b | (v.order[a] > v.order[b]))
        limit = np.where(undo_a, v.order[a], v.order[b].astype(np.int64) + 1)
        a, b = np.where(undo_a, v.right[a], a), np.where(undo_a, b, v.left[b])
    return out


def _occurrences(v: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the text and ids of all pieces that occur there, by a suffix array of its first 16 bytes."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(16, np.uint8)]).astype(np.uint64)
    head = np.zeros(n + 8, np.uint64)
    for i in range(8):
        head |= wide[i : i + n + 8] << np.uint64(56 - 8 * i)
    head, tail = head[:n], head[8 : n + 8]
    starts = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _END))  # places inside a character start no piece
    suffixes = starts[np.lexsort((tail[starts], head[starts]))]
    head, tail = head[suffixes], tail[suffixes]
    size = v.sizes[v.matched]
    # A piece of up to eight bytes ends its range at the next number of its length.
    short = size <= 8
    span = np.uint64(1) << (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
    low = np.searchsorted(head, v.heads, side="left")
    high = np.where(short, np.searchsorted(head, v.heads + (span - np.uint64(1)), side="right"), low)
    high[~short] = np.searchsorted(head, v.heads[~short], side="right")
    for i in np.flatnonzero(~short & (high > low)):
        a, b = low[i], high[i]
        k = min(int(size[i]), 16) - 8
        last = int(v.tails[i]) + (1 << (8 * (8 - k))) - 1
        low[i] = a + np.searchsorted(tail[a:b], v.tails[i], side="left")
        high[i] = a + np.searchsorted(tail[a:b], np.uint64(last), side="right")
    count = high - low
    ids = np.repeat(v.matched, count)
    first = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    places = suffixes[first + np.arange(len(ids))]
    long = np.flatnonzero(v.sizes[ids] > 16)
    if len(long):  # the rest of the few pieces beyond 16 bytes
        good = [bytes(text[p : p + len(v.pieces[i])]) == v.pieces[i]
                for p, i in zip(places[long].tolist(), ids[long].tolist(), strict=True)]
        drop = long[~np.array(good)]
        places, ids = np.delete(places, drop), np.delete(ids, drop)
    return places, ids


def _stretch(v: Vocabulary, text: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (by place) and ids of the pieces that begin within ``width`` bytes from ``first``."""
    places, ids = _occurrences(v, text[first : first + width + int(v.sizes.max())])
    here = places < width
    places, ids = places[here] + first, ids[here]
    by_place = np.argsort(places, kind="stable")
    return places[by_place], ids[by_place]


def _relaxed_long(v: Vocabulary, word: bytes) -> bytes:
    """Ids of one long word, place by place, in stretches of bounded size.

    Which pieces stay apart is found for all neighbours of a stretch at once; the walk over them looks it up.
    """
    text = np.frombuffer(word, np.uint8)
    n = len(v.pieces)
    last = [_FREE] * (len(word) + 1)
    last[0] = _START
    apart: dict[int, bool] = {}
    old_ends, old_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for first in range(0, len(word), STRETCH):
        places, ids = _stretch(v, text, first, STRETCH)
        ends = places + v.sizes[ids]
        all_ends, all_ids = np.concatenate([old_ends, ends]), np.concatenate([old_ids, ids])
        order = np.argsort(all_ends, kind="stable")
        all_ends, all_ids = all_ends[order], all_ids[order]
        low, high = np.searchsorted(all_ends, places, "left"), np.searchsorted(all_ends, places, "right")
        count = high - low
        before = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pairs = np.unique(all_ids[before].astype(np.int64) * n + np.repeat(ids, count))
        apart = dict(zip(pairs.tolist(), stay_apart(v, (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)).tolist(), strict=True))
        for place, piece, end in zip(places.tolist(), ids.tolist(), ends.tolist(), strict=True):
            prev = last[place]
            if prev == _START or prev >= 0 and apart[prev * n + piece]:
                last[end] = piece
        over = ends > first + STRETCH - 1
        old_ends, old_ids = ends[over], ids[over]
    out, at = [], len(word)
    while at:
        out.append(last[at])
        at -= int(v.sizes[last[at]])
    return np.array(out[::-1], "<i4").tobytes()


def _relaxed(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Ids (four bytes each) of words that hold known characters only: short words all at once, by depth, long ones each."""
    short = [w for w in words if len(w) <= LONG]
    done = iter(_relaxed_short(v, short) if short else [])
    return [next(done) if len(w) <= LONG else _relaxed_long(v, w) for w in words]


def _relaxed_short(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """One step per depth for all words."""
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.frombuffer(b"\xff".join(words) + b"\xff", np.uint8)
    word_of = np.repeat(np.arange(len(words)), sizes + 1)
    places, ids = _occurrences(v, text)
    # Places are also the nodes: a word's nodes are its bytes and the byte that ends it.
    ends = places + v.sizes[ids]
    depth = ends - starts[word_of[places]]
    by_depth = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth, kind="stable")
    places, ids, ends, depth = places[by_depth], ids[by_depth], ends[by_depth], depth[by_depth]
    last = np.full(len(text), _FREE, np.int32)
    last[starts] = _START
    cuts = np.concatenate(([0], np.flatnonzero(depth[1:] != depth[:-1]) + 1, [len(depth)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        before = last[places[a:b]]
        good = before == _START
        check = np.flatnonzero(before >= 0)
        good[check] = stay_apart(v, before[check], ids[a:b][check])
        last[ends[a:b][good]] = ids[a:b][good]
    at, owner = starts + sizes, np.arange(len(words))
    found_ids, found_words = [], []
    live = sizes > 0
    at, owner = at[live], owner[live]
    while len(at):
        piece = last[at]
        found_ids.append(piece)
        found_words.append(owner)
        at = at - v.sizes[piece]
        go = last[at] != _START
        at, owner = at[go], owner[go]
    if not found_ids:
        return [b""] * len(words)
    # Walked from the end: the last found comes first.
    all_ids = np.concatenate(found_ids[::-1]).astype("<i4")
    all_words = np.concatenate(found_words[::-1])
    all_ids = all_ids[np.argsort(all_words, kind="stable")]
    edges = np.concatenate(([0], np.cumsum(np.bincount(all_words, minlength=len(words)))))
    raw = all_ids.tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts; remembers words, up to a bound on their characters."""

    def __init__(self, v: Vocabulary, index_bytes: int = INDEX_BYTES, known_bytes: int = KNOWN_BYTES):
        self.v, self.index_bytes, self.known_bytes = v, index_bytes, known_bytes
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.foreign = re.compile("([^%s])" % re.escape("".join(sorted(v.letters))))
        self.longest = max(v.runs, default=1)

    def words(self, text: str) -> list[str]:
        """The text after its leading space, cut before every run of spaces and around line breaks."""
        out = []
        for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
            if k:
                out.append("\n")
            first, *rest = line.split(" ")
            if "" in rest or not first:
                out += re.findall(r" *[^ ]+| +", line if k else " " + line)
            else:
                out.append(first if k else " " + first)
                out += [" " + x for x in rest]
        return out

    def _run(self, n: int) -> bytes:
        """A run of spaces: the longest pieces first."""
        out = []
        while n:
            k = min(n, self.longest)
            out.append(self.v.runs[k])
            n -= k
        return np.array(out, "<i4").tobytes()

    def learn(self, new: list[str]) -> None:
        batch: list[str] = []
        size = 0
        for word in new:
            batch.append(word)
            size += len(word)
            if size >= self.index_bytes:
                self._index(batch)
                batch, size = [], 0
        if batch:
            self._index(batch)

    def _index(self, batch: list[str]) -> None:
        """Encode words: stretches of known characters by the index, others by their bytes, runs of spaces by rule."""
        stretches: dict[str, bytes] = {}
        plans = []
        for word in batch:
            bare = word.lstrip(" ")
            spaces = len(word) - len(bare)
            parts = self.foreign.split(bare) if self.foreign.search(bare) else [bare]
            if spaces:
                parts[0] = " " + parts[0]
            plans.append((spaces, parts))
            stretches.update((p, b"") for p in parts[::2] if p)
        names = list(stretches)
        for name, ids in zip(names, _relaxed(self.v, [x.encode() for x in names]), strict=True):
            stretches[name] = ids
        space = np.array([self.v.runs.get(1, -1)], "<i4").tobytes()
        for word, (spaces, parts) in zip(batch, plans, strict=True):
            out = []
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(self.v.byte_ids[np.frombuffer(part.encode(), np.uint8)].astype("<i4").tobytes())
                elif part:
                    ids = stretches[part]
                    if not i and spaces > 1:
                        # The last space goes with the word if it merges with it, else with the run.
                        alone = ids[:4] == space
                        ids = self._run(spaces - (not alone)) + (ids[4:] if alone else ids)
                    out.append(ids)
            self.known[word] = b"".join(out)
            self.held += ENTRY_BYTES + len(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each, as the library gives them."""
        out: list[bytes] = []
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= 8 * self.index_bytes:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if self.held > self.known_bytes:
            self.known, self.held = {}, 0
        cut = [self.words(x) if x else [] for x in texts]
        self.learn([w for w in set().union(*cut) if w not in self.known])
        known = self.known.__getitem__
        return [b"".join(map(known, x)) for x in cut]


def decode(v: Vocabulary, ids) -> str:
    """The text of a row of ids, without the space put before it."""
    data = b"".join(map(v.pieces.__getitem__, ids))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text; null and empty texts have none. One pass, no shuffle.

    Repeated rows and null ids give a row each, an empty table none; other columns are not read.
    """
    sent = shipped(docs.sparkSession, vocabulary(path or model_path()))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encoder = Encoder(sent())
        for batch in batches:
            rows = encoder.encode(batch.column(1).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in rows]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``ids``; null ids give the empty text."""
    sent = shipped(rows.sparkSession, vocabulary(path or model_path()))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        v = sent()
        for batch in batches:
            texts = [decode(v, x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every whole text encoded and decoded again: pieces, the hash of their ids, and the hash of the decoded text.

    One row per row of ``docs``, repeated ones too; null and empty texts have no pieces, null ids stay null, an empty table gives no
    rows, and other columns, also ones that differ in case only, are not read. Words of any length take time in proportion.
    ``ids_sha256`` is over the ids as 32-bit little-endian numbers. ``same`` tells
    whether decoding gave the text, its U+2581 counted as spaces, as the vocabulary has them.
    """
    sent = shipped(docs.sparkSession, vocabulary(path or model_path()))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()), ("same", pa.bool_()),
    ])

    def run(batches):
        encoder = Encoder(sent())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = []
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                back = decode(encoder.v, np.frombuffer(ids, "<i4").tolist())
                out.append((
                    len(text), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(),
                    back == text.replace(SPACE, " "),
                ))
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, decoded_sha256 string, same boolean")
