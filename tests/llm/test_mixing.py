from __future__ import annotations

from collections import defaultdict

from accountlake.llm import mixing


def filled(sizes, weights=(1, 2, 3), epochs=3):
    """Plain water-filling: clamp, share again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / share > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else left * weight[s] / share for s in names}
        full |= over


def rows_of(n=200):
    return [(i, " ".join(["w"] * (i * 7 % 23)), [None, "a", "b", "é", "zz", "big"][min(i % 9, 5)]) for i in range(n)]


def test_targets_and_taken(docs):
    rows = rows_of()
    got = mixing.mix_report(docs(rows).repartition(4)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(t.split())
    want = filled(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 12, (s, taken[s], t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs(rows)).collect()))


def test_the_mix_repeats_what_the_report_says(docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    rows = rows_of()
    report = {r.doc_id: r for r in mixing.mix_report(docs(rows)).collect()}
    counts = defaultdict(int)
    for r in mixing.mix(docs(rows)).collect():
        counts[r.doc_id] += 1
    for i, r in report.items():
        assert counts[i] * r.size == r.taken


def test_groups_do_not_change_the_sample(docs, monkeypatch):
    a = sorted(map(tuple, mixing.mix_report(docs(rows_of())).collect()))
    monkeypatch.setattr(mixing, "GROUP", 3)
    assert sorted(map(tuple, mixing.mix_report(docs(rows_of())).collect())) == a


def test_odd_rows(spark, odd):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == 11
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert mixing.mix_report(odd.limit(0)).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.mix(odd.limit(0)).count() == 0
