"""Repair of conversation structure by dynamic programming over a grammar.

A row of a conversation is a symbol: its role (system, user, assistant, other) and whether it must go or is cut short.
Kept roles have to read ``(s?(ua)+)?``, an automaton of four states, so a row is a min-plus matrix over
states: the cheapest edits that lead from one state to another, inserted rows before it included. Tasks read rows in
order, by ranges of conversation and turn, and cut them into pieces of bounded length. The pieces of many conversations
are compressed together: Re-Pair names the most frequent pair of symbols until none is frequent, every rule gets one
transfer matrix from its two parts, bottom-up, and all conversations share it. The audit of an
entry is a rope: which state lies between the two parts; letters are written out only for entries that are asked for.

Of equally cheap edits the ASCII-least string counts. All strings of a matrix row cover the same rows of the
conversation and end with the last one's letter, so none is a prefix of another: a rank per entry decides like the strings.

A conversation longer than a piece, or over the seam of two ranges, is put together from its pieces' matrices, whatever its
length: one narrow row per ``PIECE`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlake.llm.common import pick, saved

SPACE = " \t\n\x0b\x0c\r"
PIECE = 512  # rows of a conversation that one matrix stands for, at most
BATCH = 200_000  # symbols of pieces compressed together
RULES = 512  # rules of a grammar, at most; frequent pairs come first
FREQUENT = 4  # a rarer pair gets no rule
STATES = 4  # nothing yet, after the system's row, after the user's, after the assistant's
NEVER = 1 << 40  # the cost of what cannot be
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

ROLES = "sua?"  # symbols: must go, then every role whole, then every role cut short
GONE = 0
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
TAILS = ("", "II", "I", "")  # inserted rows that complete the last pair

FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTED = ("blank", "duplicate", "truncated", "illegal")
PIECES = (
    "part int, k long, {counted}, opening string, closing string, first_turn long, last_turn long, low long, high long, turns long,"
    " costs array<long>, ranks array<int>, audits array<string>"
).format(counted=", ".join(f"{c} long" for c in COUNTED))


# Matrices ------------------------------------------------------------------------------------------------------------

def _terminals() -> tuple[np.ndarray, np.ndarray, list[list[list[str | None]]]]:
    """Costs, ranks in their row, and strings of every symbol's matrix."""
    inserted = [[(NEVER, "")] * STATES for _ in range(STATES)]
    for i in range(STATES):
        for j in range(STATES):
            if i == j:
                inserted[i][j] = (0, "")
        at, cost, letters = i, 0, ""
        for _ in range(3):  # only a user's row or an assistant's fits, never both
            at = next(NEXT[r][at] for r in "ua" if NEXT[r][at] is not None)
            cost, letters = cost + INSERT, letters + "I"
            if inserted[i][at][0] > cost:
                inserted[i][at] = (cost, letters)
    count = 1 + 2 * len(ROLES)
    costs = np.full((count, STATES, STATES), NEVER, np.int64)
    strings: list = [[[None] * STATES for _ in range(STATES)] for _ in range(count)]
    for symbol in range(count):
        role, cut = (None, 0) if symbol == GONE else (ROLES[(symbol - 1) % len(ROLES)], CUT * (symbol > len(ROLES)))
        for i in range(STATES):
            for k in range(STATES):
                before, letters = inserted[i][k]
                edits = [(DELETE, "D", k)]
                if role is not None:
                    edits += [(REROLE + cut, "R", NEXT[r][k]) for r in "ua" if r != role]
                    if role in NEXT:
                        edits.append((KEEP + cut, "K", NEXT[role][k]))
                for cost, letter, j in edits:
                    if before < NEVER and j is not None:
                        old = (costs[symbol, i, j], strings[symbol][i][j] or "")
                        new = (before + cost, letters + letter)
                        if new < old:
                            costs[symbol, i, j], strings[symbol][i][j] = new
    order = [[[s if s is not None else "~" for s in row] for row in m] for m in strings]
    ranks = np.array([[[sorted(row).index(s) for s in row] for row in m] for m in order], np.int64)
    return costs, ranks, strings


COSTS, RANKS, STRINGS = _terminals()


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus products of stacks of matrices (costs, ranks): costs, ranks, and the state between the two."""
    cost = a[0][:, :, :, None] + b[0][:, None, :, :]
    via = (cost * (2 * STATES) + a[1][:, :, :, None]).argmin(axis=2)
    best = np.minimum(np.take_along_axis(cost, via[:, :, None, :], 2)[:, :, 0, :], NEVER)
    m, i = np.arange(len(via))[:, None, None], np.arange(STATES)[None, :, None]
    key = a[1][m, i, via] * (2 * STATES) + b[1][m, via, np.arange(STATES)[None, None, :]]
    key = np.where(best < NEVER, key, 1 << 20)
    return best, key.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable"), via


def re_pair(pieces: list[np.ndarray], rules: int = RULES, frequent: int = FREQUENT) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules (pairs of symbols; rule ``i`` is symbol ``len(COSTS) + i``) and what is left of every piece."""
    lengths = [len(p) + 1 for p in pieces]
    text = np.full(sum(lengths), -1, np.int64)
    at = 0
    for p, n in zip(pieces, lengths, strict=True):
        text[at : at + n - 1] = p
        at += n
    found: list[tuple[int, int]] = []
    while len(found) < rules:
        size = len(COSTS) + len(found)
        left, right = text[:-1], text[1:]
        inside = (left >= 0) & (right >= 0)
        pairs = np.bincount(left[inside] * size + right[inside], minlength=1)
        top = int(pairs.argmax())
        if pairs[top] < frequent:
            break
        a, b = divmod(top, size)
        places = np.flatnonzero((left == a) & (right == b))
        if a == b:  # of a run, every other place
            start = np.flatnonzero(np.diff(places, prepend=-2) > 1)
            run = np.repeat(places[start], np.diff(start, append=len(places)))
            places = places[(places - run) % 2 == 0]
        text[places] = size
        text = np.delete(text, places + 1)
        found.append((a, b))
    ends = np.flatnonzero(text < 0)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else []
    return found, [text[s:e] for s, e in zip(starts, ends, strict=True)]


class Transfers:
    """The matrices of pieces of symbols: costs, ranks, and the strings of entries."""

    def __init__(self, pieces: list[bytes]):
        self.rules, self.left = re_pair([np.frombuffer(p, np.uint8) for p in pieces])
        n = len(COSTS)
        self.costs = np.concatenate([COSTS, np.empty((len(self.rules), STATES, STATES), np.int64)])
        self.ranks = np.concatenate([RANKS, np.empty((len(self.rules), STATES, STATES), np.int64)])
        self.via = np.zeros((len(self.rules), STATES, STATES), np.int64)
        for r, (a, b) in enumerate(self.rules):
            c, k, v = product((self.costs[a : a + 1], self.ranks[a : a + 1]), (self.costs[b : b + 1], self.ranks[b : b + 1]))
            self.costs[n + r], self.ranks[n + r], self.via[r] = c[0], k[0], v[0]
        self.known: dict[tuple[int, int, int], str] = {}
        self._fold()

    def _fold(self) -> None:
        """Matrices of whole pieces, all at once, one symbol further a step; the states passed are kept."""
        order = sorted(range(len(self.left)), key=lambda p: -len(self.left[p]))
        self.place = {p: i for i, p in enumerate(order)}
        lengths = np.array([len(self.left[p]) for p in order])
        first = np.array([self.left[p][0] for p in order], np.int64)
        self.cost, self.rank = self.costs[first], self.ranks[first]
        self.steps = []
        for t in range(1, int(lengths.max(initial=0))):
            m = int((lengths > t).sum())
            symbol = np.array([self.left[p][t] for p in order[:m]])
            c, k, v = product((self.cost[:m], self.rank[:m]), (self.costs[symbol], self.ranks[symbol]))
            self.cost[:m], self.rank[:m] = c, k
            self.steps.append(v.astype(np.int8))

    def _letters(self, symbol: int, i: int, j: int) -> str:
        if symbol < len(COSTS):
            return STRINGS[symbol][i][j]
        got = self.known.get((symbol, i, j))
        if got is None:
            a, b = self.rules[symbol - len(COSTS)]
            k = int(self.via[symbol - len(COSTS), i, j])
            got = self.known[symbol, i, j] = self._letters(a, i, k) + self._letters(b, k, j)
        return got

    def audit(self, piece: int, i: int, j: int) -> str | None:
        """The letters of one entry of a piece's matrix; null if it cannot be."""
        p = self.place[piece]
        if self.cost[p, i, j] >= NEVER:
            return None
        parts = []
        for t in range(len(self.left[piece]) - 1, 0, -1):
            k = int(self.steps[t - 1][p, i, j])
            parts.append(self._letters(int(self.left[piece][t]), k, j))
            j = k
        parts.append(self._letters(int(self.left[piece][0]), i, j))
        return "".join(reversed(parts))


# Rows ----------------------------------------------------------------------------------------------------------------

def plain(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table of conversations; null roles and texts are one space."""
    got = pick(df, "conv_id", "turn", "role", "text")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return got.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` behind ``copies`` (0: dropped, 2: repeated): a twentieth each dropped, emptied, unstopped, repeated, made the user's.

    What happens to a row is the CRC of ``conv_id:turn`` (null: one space) modulo 20, so reruns agree.
    """
    spelt = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _same(a: str) -> Column:
    return F.col(f"l.{a}").eqNullSafe(F.col(f"r.{a}"))


def symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows of each turn, narrow: ``conv_id, turn, role, digest, n, fault`` (0, 1 blank, 2 duplicate, 3 truncated).

    A text is known by its SHA-256. ``fault`` is that of the first of ``n`` equal rows. Equal rows are counted before
    the shuffle, and where a role and text occur first is a minimum per key, so a text that fills a conversation is no large group.
    """
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", 1).when(~last.isin(*".!?"), 3).otherwise(0).cast("int")
    narrow = rows.where("copies > 0").select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"), "copies").groupBy(
        "conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"))
    joined = narrow.alias("l").join(first.alias("r"), _same("conv_id") & _same("role") & _same("digest"))
    later = F.struct(F.col("l.turn").isNotNull().alias("known"), F.col("l.turn").alias("turn")) > F.col("r.first")
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in ("conv_id", "turn", "role", "digest", "n")],
        F.when((F.col("l.fault") != 1) & later, 2).otherwise(F.col("l.fault")).cast("int").alias("fault"))


class _Piece:
    """What a task knows of up to ``PIECE`` rows of a conversation."""

    def __init__(self, conv_id, first: bool):
        self.conv_id, self.first = conv_id, first  # whether no other piece can come before
        self.symbols = bytearray()
        self.counts = dict.fromkeys(COUNTED, 0)
        self.opening = self.closing = None
        self.first_turn = self.last_turn = self.low = self.high = None
        self.turns = 0

    def add(self, initial: str, symbol: int, fault: int, turn: int | None, n: int = 1) -> None:
        """``n`` equal rows."""
        if self.opening is None:
            self.opening, self.first_turn = initial, turn
            self.counts["illegal"] += n - 1  # a role never follows itself
        else:
            self.counts["illegal"] += n - legal(self.closing, initial)
        self.closing = initial
        if turn is not None:
            self.turns += self.low is None or self.last_turn != turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last_turn = turn
        if fault:
            self.counts[COUNTED[fault - 1]] += n
        self.symbols += bytes([symbol]) * n


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _symbol(initial: str, fault: int) -> int:
    if fault in (1, 2):
        return GONE
    role = ROLES.index(initial) if initial in ROLES[:3] and initial else 3
    return 1 + role + (len(ROLES) if fault == 3 else 0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[_Piece]:
    piece, opened = None, False
    for batch in batches:
        for conv_id, turn, role, n, fault in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if piece is None or piece.conv_id != conv_id:
                if piece is not None:
                    yield piece
                # The first conversation of a range may have begun in the range before.
                piece, opened = _Piece(conv_id, opened), True
            initial, again = role[:1], fault if fault == 1 else 2
            piece_of = [(fault, 1)] + [(again, n - 1)] * (n > 1)
            for kind, count in piece_of:
                while count:
                    if len(piece.symbols) >= PIECE:
                        yield piece
                        piece = _Piece(conv_id, False)
                    some = min(count, PIECE - len(piece.symbols))
                    piece.add(initial, _symbol(initial, kind), kind, turn, some)
                    count -= some
    if piece is not None:
        yield piece


def _summaries(kind: pa.DataType):
    """Tasks' pieces with the costs, ranks and strings of their matrices."""
    types = [kind, pa.int32(), pa.int64(), *[pa.int64()] * len(COUNTED), pa.string(), pa.string(), *[pa.int64()] * 5,
             pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["conv_id", *[x.split()[0] for x in PIECES.split(", ")]]

    def emit(pieces, part, serial):
        distinct = {s: i for i, s in enumerate(dict.fromkeys(bytes(p.symbols) for p in pieces))}
        transfers = Transfers(list(distinct))
        rows = []
        for p in pieces:
            at = distinct[bytes(p.symbols)]
            where = transfers.place[at]
            # A conversation starts with nothing: other rows of its first piece's matrix are never asked for.
            states = 1 if p.first else STATES
            rows.append((
                p.conv_id, part, serial, *p.counts.values(), p.opening, p.closing, p.first_turn, p.last_turn, p.low, p.high, p.turns,
                transfers.cost[where, :states].ravel().tolist(), transfers.rank[where, :states].ravel().tolist(),
                [transfers.audit(at, i, j) for i in range(states) for j in range(STATES)]))
            serial += 1
        for s in range(0, len(rows), 2000):
            columns = zip(*rows[s : s + 2000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
        for piece in _pieces(batches):
            held.append(piece)
            size += len(piece.symbols)
            if size >= BATCH or len(held) >= BATCH // 4:
                yield from emit(held, part, serial)
                serial += len(held)
                held, size = [], 0
        if held:
            yield from emit(held, part, serial)

    return run


class _Joined:
    """A conversation put together from its pieces: four states, each with a cost, a rank and a chain of strings."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTED, 0)
        self.states = {0: (0, 0, None)}
        self.closing = self.last_turn = self.low = self.high = None
        self.turns = 0

    def add(self, r: dict) -> None:
        for c in COUNTED:
            self.counts[c] += r[c]
        if self.closing is not None:
            self.counts["illegal"] += not legal(self.closing, r["opening"])
        self.turns += r["turns"] - (self.last_turn is not None and self.last_turn == r["first_turn"])
        self.low = r["low"] if self.low is None else self.low
        self.high = self.high if r["high"] is None else r["high"]
        self.closing, self.last_turn = r["closing"], r["last_turn"]
        new = {}
        for j in range(STATES):
            ways = [
                (cost + r["costs"][i * STATES + j], rank, r["ranks"][i * STATES + j], i)
                for i, (cost, rank, _) in self.states.items() if r["costs"][i * STATES + j] < NEVER
            ]
            if ways:
                cost, rank, inner, i = min(ways)
                new[j] = (cost, (rank, inner), (self.states[i][2], r["audits"][i * STATES + j]))
        order = {k: n for n, k in enumerate(sorted(rank for _, rank, _ in new.values()))}
        self.states = {j: (cost, order[rank], rope) for j, (cost, rank, rope) in new.items()}

    def facts(self) -> tuple:
        ends = [(cost + INSERT * len(TAILS[j]), rank, j) for j, (cost, rank, _) in self.states.items()]
        cost, _, j = min(ends)
        parts, rope = [TAILS[j]], self.states[j][2]
        while rope is not None:
            rope, letters = rope
            parts.append(letters)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts.values(), cost, "".join(reversed(parts)))


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, copies``): ``gaps``, faults, the cost and the audit.

    Rows count in order of turn (nulls first), then role, then the text's SHA-256. A conversation whose rows all have
    ``copies`` 0 gives none. A null ``conv_id`` is one conversation. Long conversations are cut into pieces, without another result.
    """
    kind = rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "digest"]
    narrow = saved(symbols(rows), "symbols")
    ranges = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "n", "fault")
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    ddl = "string" if isinstance(kind, T.StringType) else "long"
    ranges = ranges.withColumn("conv_id", F.col("conv_id").cast(ddl))
    pieces = saved(ranges.mapInArrow(_summaries(arrow), f"conv_id {ddl}, {PIECES}"), "pieces")
    names = ["conv_id", *[x.split()[0] for x in FACTS.split(", ")]]

    def run(batches):
        current, joined, out = None, None, []

        def batch_of():
            types = [arrow, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                if joined is None or r["conv_id"] != current:
                    if joined is not None:
                        out.append((current, *joined.facts()))
                    current, joined = r["conv_id"], _Joined()
                    if len(out) >= 2000:
                        yield batch_of()
                        out = []
                joined.add(r)
        if joined is not None:
            out.append((current, *joined.facts()))
            yield batch_of()

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
    return dealt.mapInArrow(run, f"conv_id {ddl}, {FACTS}").withColumn("conv_id", F.col("conv_id").cast(kind))


def _dealt(rows: DataFrame, found: DataFrame) -> DataFrame:
    """All rows of a conversation behind its facts, in order: ``conv_id, kind`` (0 facts, 1 rows, 2 dropped), facts, rows."""
    texts = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text", F.col("copies").cast("int").alias("copies"))
    dropped = rows.where("copies = 0").select("conv_id", F.lit(2).alias("kind")).distinct()
    together = found.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True).unionByName(
        dropped, allowMissingColumns=True)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("digest", "turn")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(conv_id, facts)`` for each conversation, then ``(role, text)`` for each repaired row: three-tuples with a kind first."""
    facts = [x.split()[0] for x in FACTS.split(", ")]
    nothing = (0, 0, 0, 0, 0, 0, "")
    current, begun, audit, at, state = None, False, "", 0, 0

    def inserted():
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at += 1
            role = "assistant" if state == 2 else "user"
            state = NEXT[role[0]][state]
            yield "turn", role, ""

    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        texts = columns["text"]
        for i, (conv_id, kind) in enumerate(zip(columns["conv_id"], columns["kind"], strict=True)):
            if not begun or conv_id != current:
                if begun:
                    yield from inserted()
                known = tuple(columns[f][i] for f in facts) if kind == 0 else nothing
                current, begun, audit, at, state = conv_id, True, known[-1], 0, 0
                yield "conversation", conv_id, known
            for _ in range(columns["copies"][i] or 0 if kind == 1 else 0):
                yield from inserted()
                letter = audit[at]
                at += 1
                if letter != "D":
                    role = columns["role"][i]
                    if letter == "R":
                        role = "assistant" if state == 2 else "user"
                    state = NEXT[role[0]][state]
                    yield "turn", role, texts[i]
    if begun:
        yield from inserted()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, place`` (from 0), ``role, text``."""
    kind = rows.schema["conv_id"].dataType

    def run(batches):
        out, current, place, held = [], None, 0, 0
        names = ["conv_id", "place", "role", "text"]
        for what, a, b in _walked(batches):
            if what == "conversation":
                current, place = a, 0
                continue
            out.append((current, place, a, b))
            place, held = place + 1, held + len(b)
            if len(out) >= 2000 or held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    ddl = "string" if isinstance(kind, T.StringType) else "long"
    dealt = _dealt(rows, found).withColumn("conv_id", F.col("conv_id").cast(ddl))
    return dealt.mapInArrow(run, f"conv_id {ddl}, place long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One row per conversation, those without rows too: its facts and the SHA-256 of its repaired ``role:text`` lines.

    SHA-256 runs over a conversation from front to end, so one task reads a conversation's rows, in sorted order
    and without holding them.
    """
    kind = rows.schema["conv_id"].dataType
    text_id = isinstance(kind, T.StringType)
    names = ["conv_id", *[x.split()[0] for x in FACTS.split(", ")], "repaired_sha256"]
    types = [pa.string() if text_id else pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches):
        out, current, first, sha = [], None, True, None

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for what, a, b in _walked(batches):
            if what == "conversation":
                if current is not None:
                    out.append((*current, sha.hexdigest()))
                    if len(out) >= 2000:
                        yield batch_of()
                        out = []
                current, first, sha = (a, *b), True, hashlib.sha256()
            else:
                sha.update(f"{'' if first else chr(10)}{a}:{b}".encode("utf-8", "surrogatepass"))
                first = False
        if current is not None:
            out.append((*current, sha.hexdigest()))
            yield batch_of()

    ddl = "string" if text_id else "long"
    dealt = _dealt(rows, found).withColumn("conv_id", F.col("conv_id").cast(ddl))
    return dealt.mapInArrow(run, f"conv_id {ddl}, {FACTS}, repaired_sha256 string").withColumn("conv_id", F.col("conv_id").cast(kind))


def report(conversations: DataFrame) -> DataFrame:
    """Damage, repair and digest of a table of conversations: every ``conv_id``, once.

    Null ids are one conversation, null turns come first, null roles and texts are one space; repeated rows are duplicates of
    the first. An empty table gives no rows; other columns are not read.
    """
    rows = damaged(plain(conversations))
    return digests(rows, saved(repairs(rows), "repairs"))
