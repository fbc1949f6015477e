from __future__ import annotations

import hashlib
import random

from accountlake.llm import fingerprints as fp


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_distances_are_those_of_the_plain_table():
    rnd = random.Random(1)
    pairs = [("".join(rnd.choices("abcd", k=rnd.randint(1, 40))), "".join(rnd.choices("abcd", k=rnd.randint(1, 40))))
             for _ in range(100)]
    a, b = zip(*pairs, strict=True)
    assert fp.distances(list(a), list(b)).tolist() == [edit_distance(x, y) for x, y in pairs]


def test_chunks_follow_the_content():
    rnd = random.Random(2)
    text = "".join(rnd.choices("abcdefghij ", k=5000))
    same, moved, other = fp.fingerprint(text.encode()), fp.fingerprint(("xyz" + text).encode()), "".join(reversed(text))
    assert fp.likeness([(same, same)]) == [1.0]
    assert fp.likeness([(same, moved)])[0] > 0.9
    assert fp.likeness([(same, fp.fingerprint(other.encode()))])[0] < 0.2


def test_signatures_span_the_whole_text():
    rnd = random.Random(5)
    one, two = ("".join(rnd.choices("abcdefghij ", k=300)).encode() for _ in range(2))
    for k in (200, 400, 1000):
        whole, half, last = (fp.fingerprint(x) for x in (one * 2 * k, one * k + two * k, one * (2 * k - 1) + two))
        assert fp.likeness([(whole, half)])[0] < 0.7
        assert 0.9 < fp.likeness([(whole, last)])[0] < 1
        assert all(len(x) <= fp.LONGEST for x in whole.split(":")[1:])


def test_long_texts_are_hashed_in_blocks_alike():
    data = bytes(random.Random(3).choices(range(97, 123), k=300_000))
    ends, bits, sums, whole = fp._triggers(data, 6)
    block, fp.BLOCK = fp.BLOCK, 1 << 12
    try:
        again = fp._triggers(data, 6)
    finally:
        fp.BLOCK = block
    for x, y in zip((ends, bits, sums), again, strict=False):
        assert (x == y).all()
    assert whole == again[3]


def test_report_against_a_walk(spark, docs, words):
    rnd = random.Random(4)
    texts = [" ".join(words(rnd.randint(0, 300))) for _ in range(60)]
    ids = rnd.sample(range(1000), 60)
    got = {r.doc_id: r for r in fp.edit_report(docs(list(zip(ids, texts, strict=True))).repartition(7)).collect()}
    rows = sorted(zip(ids, texts, strict=True))
    assert len(got) == 60
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        r = got[i]
        marks = [fp.fingerprint(x.encode()) for x in (t, changed, n)]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(t), marks[0], marks[1])
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert [r.near_edited, r.near_next] == fp.likeness([(marks[0], marks[1]), (marks[0], marks[2])])


def test_odd_rows(spark, docs, odd):
    rows = fp.edit_report(odd).collect()
    assert len(rows) == 11
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"1:::"}
    assert len({r.fingerprint for r in rows if r.n_chars == 13}) == 1
    assert fp.edit_report(odd.limit(0)).count() == 0
    one = fp.edit_report(docs(["alone in here"])).first()
    assert one.near_next == 1.0
    assert fp.fingerprints(odd).count() == 11
