"""Repairs against a plain dynamic program over whole strings, one conversation at a time."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountlake.llm import turn_repair as R

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
BLANK = re.compile(r"[^\x20\x09-\x0D]")
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


@pytest.fixture
def talks(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(symbols):
    """Cost and least string: all states with all strings that may still win."""
    best = {"": (0, "")}

    def relax(states):
        states = dict(states)
        for _ in range(3):
            for at, (cost, audit) in list(states.items()):
                for role in "ua":
                    to = STEP.get((at, role))
                    if to and (cost + 5, audit + "I") < states.get(to, (1 << 60, "")):
                        states[to] = (cost + 5, audit + "I")
        return states

    for role, fault in symbols:
        new = {}
        for at, (cost, audit) in relax(best).items():
            ways = [(at, 2, "D")]
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                ways += [(STEP.get((at, role)), cut, "K")] + [(STEP.get((at, x)), cut + 1, "R") for x in "ua"]
            for to, more, letter in ways:
                if to is not None and (cost + more, audit + letter) < new.get(to, (1 << 60, "")):
                    new[to] = (cost + more, audit + letter)
        best = new
    done = relax(best)
    return min(done[at] for at in ("", "a") if at in done)


def repair(rows):
    """One conversation's expected row, from its damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, symbols = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, _, role, text in rows:
        fault = None
        if not BLANK.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        symbols.append((role[:1], fault))
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(symbols, symbols[1:], strict=False))
    cost, audit = cheapest(symbols)
    at, out, left = "", [], iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)[2:]
        if letter in "IR":
            role = "assistant" if at == "u" else "user"
        if letter != "D":
            at = STEP[at, role[0]]
            out.append(f"{role}:{text}")
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def expected(rows, kept=None):
    kept = damage(rows) if kept is None else kept
    out = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows}
    key = lambda r: (r[0] is not None, r[0] or 0)
    return out | {c: repair(list(rs)) for c, rs in groupby(sorted(kept, key=key), lambda r: r[0])}


def collected(df):
    rows = df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def talk(rnd, conv, n, words=("Yes.", "No", "Why?", " ", "", "So it is!", "Maybe \n")):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "unknown"]
    return [(conv, t, rnd.choice(roles), rnd.choice(words) + (f" {rnd.randint(0, 3)}." if rnd.random() < 0.3 else "")) for t in range(n)]


def test_against_the_plain_program(talks):
    rnd = random.Random(1)
    rows = [r for c in range(300) for r in talk(rnd, c, rnd.randint(1, 12))]
    rows = [(c, t * rnd.choice([1, 1, 1, 2]), r, x) for c, t, r, x in rows]
    rnd.shuffle(rows)
    assert collected(R.report(talks(rows).repartition(5))) == expected(rows)


def test_pieces_and_seams(talks, monkeypatch):
    """Conversations of many pieces over many ranges, and rows that repeat often."""
    rnd = random.Random(2)
    rows = talk(rnd, 1, 700) + talk(rnd, 2, 3) + [(3, 5, "user", "Same.")] * 300 + [(3, t, "assistant", "Same.") for t in range(200)] + talk(rnd, 4, 90)
    df = talks(rows).repartition(7)
    want = expected(rows)
    assert collected(R.report(df)) == want
    monkeypatch.setattr(R, "PIECE", 5)
    monkeypatch.setattr(R, "BATCH", 60)
    assert collected(R.report(df)) == want


def test_every_short_sequence(talks):
    """All sequences of up to three symbols, among them every tie."""
    shapes = [(r, x) for r in ("system", "user", "assistant", "tool") for x in ("{}.", "{}")] + [("user", " ")]
    kept, conv = [], 0
    for n in (1, 2, 3):
        for at in np.ndindex(*[len(shapes)] * n):
            conv += 1
            kept += [(conv, t, shapes[i][0], shapes[i][1].format(f"w{t}")) for t, i in enumerate(at)]
    df = talks(kept).withColumn("copies", F.lit(1))
    assert collected(R.digests(df, R.repairs(df))) == expected(kept, kept)


def test_repaired_rows(talks):
    rnd = random.Random(3)
    rows = [r for c in range(40) for r in talk(rnd, c, rnd.randint(1, 9))]
    df = R.damaged(R.plain(talks(rows)))
    found = R.repairs(df)
    sha = {}
    for c, rs in groupby(sorted(R.repaired(df, found).collect(), key=lambda r: (r[0], r[1])), lambda r: r[0]):
        rs = list(rs)
        assert [r.place for r in rs] == list(range(len(rs)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in rs))
        sha[c] = hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rs).encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert {c: sha.get(c, empty) for c in {r[0] for r in rows}} == {c: v[-1] for c, v in expected(rows).items()}


def test_the_grammar_shares_rules():
    """What Re-Pair leaves expands to the pieces again, and is much shorter where they repeat."""
    rnd = random.Random(4)
    pieces = [bytes(rnd.choices([2, 3], k=rnd.randint(1, 30))) for _ in range(200)] + [bytes([2, 3] * 250), bytes([0] * 501)]
    rules, left = R.re_pair([np.frombuffer(p, np.uint8) for p in pieces])

    def expand(symbol):
        return bytes([symbol]) if symbol < len(R.COSTS) else b"".join(map(expand, rules[symbol - len(R.COSTS)]))

    assert [b"".join(expand(s) for s in p) for p in left] == pieces
    assert sum(map(len, left)) < sum(map(len, pieces)) / 4
    transfers = R.Transfers(pieces[:50])
    for i, p in enumerate(pieces[:50]):
        cost, audit = cheapest([("u" if s == 2 else "a", None) for s in p])
        got = [(int(transfers.cost[transfers.place[i], 0, j]) + 5 * len(R.TAILS[j]), transfers.audit(i, 0, j)) for j in range(4)]
        assert min((c, a + R.TAILS[j]) for j, (c, a) in enumerate(got) if a is not None) == (cost, audit)


def test_odd_rows(spark, talks):
    long = "word " * 40_000 + "end."
    rows = [
        (None, None, None, None), (None, 0, "user", "Hello."), (1, None, "user", "First?"), (1, None, "", "No role."), (1, 3, None, "No role."),
        (1, 3, None, "No role."), (2, 7, "user", None), (2, 8, "assistant", ""), (3, -4, "système", "a　"), (3, 10**15, "user", "."),
        (4, 0, "user", long), (4, 1, "assistant", long), (4, 2, "user", long), (5, 1, "user", "x" * 300_000),
    ]
    rows += [(c, t, "user", "Gone or not.") for c in range(10, 40) for t in range(1)]
    df = talks(rows)
    assert collected(R.report(df)) == expected(rows)
    clash = df.selectExpr("conv_id", "turn", "role", "text", "1 as copies", "'x' as digest", "2 as kind", "'TEXT' as extra").toDF(
        "conv_id", "turn", "role", "text", "copies", "digest", "kind", "TEXT")
    assert collected(R.report(clash)) == expected(rows)
    assert R.report(df.limit(0)).count() == 0
    named = df.where("conv_id is not null").withColumn("conv_id", F.col("conv_id").cast("string"))
    assert {int(k): v for k, v in collected(R.report(named)).items()} == {k: v for k, v in expected(rows).items() if k is not None}
