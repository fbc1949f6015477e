from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from accountlake.llm import jaccard_join as jj
from accountlake.llm.components import components


def plain_shingles(text):
    words = (text or "").split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Classes and links of all pairs of rows."""
    sets = [plain_shingles(t) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a or b) and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    classes = defaultdict(list)
    for i in range(n):
        classes[top(i)].append(i)
    out = Counter()
    for members in classes.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[(rows[i][0], min(ids, default=None), links[i], len(members))] += 1
    return out


def near_texts(words, seed=1):
    rnd = random.Random(seed)
    out = []
    for size in (12, 60, 300):
        for _ in range(4):
            base = words(size)
            out.append(" ".join(base))
            for edits in (0, 1, 1, 2, 5):
                changed = list(base)
                for _ in range(edits):
                    changed[rnd.randrange(size)] = "edit%d" % rnd.randrange(1000)
                out.append("  ".join(changed))
    out += ["a b c", "a b  c", "a b d", "", None, " \n"]
    # One large group of near copies of each other.
    base = words(120)
    for i in range(40):
        changed = list(base)
        changed[rnd.randrange(115)] = f"x{i}"
        out.append(" ".join(changed))
    return out


@pytest.mark.parametrize("blocks", [(4096, 512), (3, 5)])
def test_against_all_pairs(docs, words, monkeypatch, blocks):
    monkeypatch.setattr(jj, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(jj, "EXACT_BLOCK", blocks[1])
    texts = near_texts(words)
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    got = Counter((r.doc_id, r.class_id, r.n_links, r.class_size) for r in jj.near_copies(docs(rows).repartition(5)).collect())
    assert got == brute(rows)


def test_minhash_estimates_likeness(words):
    rnd = random.Random(3)
    for edits in (0, 3, 10, 40):
        a = words(400)
        b = list(a)
        for i in rnd.sample(range(400), edits):
            b[i] = f"e{i}"
        x, y = jj.shingles(" ".join(a)), jj.shingles(" ".join(b))
        likeness = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((jj.minhashes(x) == jj.minhashes(y)).mean() - likeness) < 0.15


def test_fewest_matches_are_those_of_the_posterior():
    rng = np.random.default_rng(1)
    t = 0.8 + 0.2 / 256
    for k, need in enumerate(jj.fewest_matches(tolerance=0.01)):
        n = jj.STEP * (k + 1)
        for m, over in ((need, True), (need - 1, False)):
            share = (rng.beta(m + 1, n - m + 1, 400_000) >= t).mean()
            assert (share >= 0.01 * 0.9) if over else (share <= 0.01 * 1.1)


def test_common_counts(words):
    rnd = random.Random(4)
    sets = [np.array(sorted(rnd.sample(range(9000), rnd.randint(1, 4000))), np.uint64) for _ in range(12)]
    got = jj.common_counts(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (103, 102), (7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_odd_rows(odd):
    got = jj.near_copies(odd).collect()
    assert len(got) == 11 and sum(r.stays for r in got) == 5
    kept = jj.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert jj.near_copies(odd.limit(0)).count() == 0 and jj.one_of_each(odd.limit(0)).count() == 0


def test_no_copies_at_all(docs, words):
    got = jj.near_copies(docs([" ".join(words(50)) for _ in range(5)])).collect()
    assert all(r.n_links == 0 and r.class_id == r.doc_id and r.stays for r in got)
