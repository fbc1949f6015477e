from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from accountlake.llm import exact_dedup as ed


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return by


def check(rows, got):
    by = groups(rows)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    text_of = {hashlib.sha256(t.encode()).hexdigest(): t for t in by}
    for r in got:
        t = text_of[r.text_sha256]
        ids = by[t]
        assert r.group_size == len(ids) and r.doc_id in ids
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[t] == 1 for t in by)


@pytest.mark.parametrize("capacity", [ed.CAPACITY, 50])
def test_groups(docs, capacity):
    rnd = random.Random(1)
    texts = ["", None, "x", "X", "x ", "long " * 50] + [f"t{i}" for i in range(40)]
    rows = [(rnd.choice([None, *range(80)]), rnd.choice(texts)) for _ in range(400)]
    check(rows, ed.exact_copies(docs(rows).repartition(6), capacity).collect())


def test_collisions_of_the_key_do_not_join_texts(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, f"t{i % 5}") for i in range(60)]
    got = ed.exact_copies(docs(rows).repartition(5)).collect()
    check(rows, got)
    assert {r.chain for r in got} == set(range(5))


def test_small_local_steps(docs, monkeypatch):
    monkeypatch.setattr(ed, "LOCAL_BYTES", 20)
    rows = [(i, f"text {i % 7}") for i in range(100)]
    check(rows, ed.exact_copies(docs(rows).coalesce(2)).collect())


def test_directory_covers_all_keys(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) as key", "10L as bytes")
    table, depth = ed.directory(keys, 1000)
    rows = table.collect()
    assert depth > 0 and len({r.prefix for r in rows}) == len(rows)
    held = keys.withColumn("prefix", ed.prefix(keys.key, depth)).join(table, "prefix").groupBy("bucket", "depth").sum("bytes").collect()
    assert sum(r["sum(bytes)"] for r in held) == 20000
    assert all(r["sum(bytes)"] <= 1000 or r.depth == depth for r in held)


def test_odd_rows(odd):
    got = ed.exact_copies(odd).collect()
    assert len(got) == 11 and sum(r.kept for r in got) == 7
    kept = ed.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert ed.exact_copies(odd.limit(0)).count() == 0 and ed.without_copies(odd.limit(0)).count() == 0
