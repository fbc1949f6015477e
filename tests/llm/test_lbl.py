from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from accountlake.llm import lbl


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def base_scores(rows):
    """Counts in one place."""
    split = lambda t: [w for w in (t or "").encode().lower().split()]
    counts, n = Counter(), 0
    for i, t in rows:
        if not held_out("" if i is None else i):
            words = [*split(t), None]
            counts.update(words)
            n += len(words)
    out = []
    for i, t in rows:
        words = [*split(t), None]
        score = sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in words)
        out.append((i, held_out("" if i is None else i), len(words), sum(counts[w] > 0 for w in words), n, score))
    return out


def corpus(n=160):
    rnd = random.Random(1)
    tongues = [[f"{a}{i}" for i in range(60)] for a in "xyz"]
    out = []
    for i in range(n):
        words = tongues[i % 3]
        out.append((i, " ".join(words[min(int(rnd.expovariate(0.08)), 59)] for _ in range(rnd.randint(0, 120))) + (" Rare%d" % i) * (i % 2)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r[:6]) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) < 1e-6 for a, b in zip(got, want, strict=True))


def columns(df):
    return df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()


def test_base_scores(docs, monkeypatch):
    rows = corpus()
    same(columns(lbl.scores(docs(rows).repartition(3))), base_scores(rows))
    # With a small table most words come by the join.
    monkeypatch.setattr(lbl, "FLUSH", 10)
    same(columns(lbl.scores(docs(rows).repartition(3), words=5, classes=4, table=20)), base_scores(rows))


def test_the_model_learns_context(docs):
    got = columns(lbl.scores(docs(corpus(600)), rates=(0.15, 0.05, 0.05)))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.97 * sum(r.base_score for r in out)


def known_vocabulary(docs, texts, **sizes):
    counts = lbl.saved(lbl.word_counts(lbl._texts(docs(texts))), "counts")
    return lbl.vocabulary(counts, **sizes)[0]


def test_every_position_is_trained_on(docs, monkeypatch):
    """All positions count, however texts are dealt out and cut into pieces, also those of a text of one token."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices("abcdefg", k=rnd.choice([0, 1, 3, 7, 15, 40]))) + f" {i}" for i in range(800)] + ["a b c " * 900]
    vocab = known_vocabulary(docs, texts)
    want = Counter()
    for text in texts:
        units = lbl._units(lbl.tokens(text), vocab)[0].tolist()
        full = [vocab.end + 1] * 2 + units
        want.update(zip(full, full[1:], full[2:]))

    def made(parts):
        df = lbl.encoded(lbl._texts(docs(texts)).withColumn("row_id", F.lit(1)).repartition(parts), lambda: vocab)
        rows = df.where("units is not null").collect()
        pieces = [np.frombuffer(r["units"], vocab.dtype) for r in rows]
        assert [len(p) - 2 for p in pieces] == [r["places"] for r in rows]
        codes = lbl._codes(np.concatenate(pieces), np.array([len(p) for p in pieces]), vocab.contexts)
        found, weights = lbl.weighted(codes)
        assert weights.max() <= lbl.HEAVY
        total = Counter()
        for c, w in zip(found.tolist(), weights.tolist(), strict=True):
            pair, word = divmod(c, vocab.contexts)
            total[(*divmod(pair, vocab.contexts), word)] += w
        return {k: round(n, 3) for k, n in total.items()}

    assert made(3) == made(1) == want
    monkeypatch.setattr(lbl, "PIECE", 7)
    assert made(3) == want


def test_scores_are_those_of_the_model(docs, monkeypatch):
    """Every token's probability in plain arithmetic: its unit by all units, then its share of the class."""
    rows = corpus(60) + [(None, "x1 x2 Rare1 rare1 neverseen"), (900, None)]
    sizes = {"words": 8, "classes": 5, "table": 30}
    learnt = [(i, t) for i, t in rows if not held_out("" if i is None else i)]
    vocab = known_vocabulary(docs, learnt, **sizes)
    rng = np.random.default_rng(9)
    model = lbl.Model.start(vocab.unit_counts)
    model.context[:] = rng.normal(0, 1, model.context.shape)
    monkeypatch.setattr(lbl, "fitted", lambda *_: model)
    monkeypatch.setattr(lbl, "PIECE", 11)
    counts = Counter(w for _, t in learnt for w in lbl.tokens(t or ""))
    own = [w for w, u in ((w, vocab.units[i]) for w, i in vocab.table.items()) if u < sizes["words"]]
    unit = lambda w: vocab.units[vocab.table[w]] if w in own else vocab.endings.get(w[-3:], vocab.other)
    held = Counter()
    for w, n in counts.items():
        if w not in own:
            held[unit(w)] += n + 1
    m = [x.astype(float) for x in model.arrays()]
    context, near, far, out, bias = m

    def text_score(text):
        a = b = vocab.end + 1
        total = 0.0
        for w in [*lbl.tokens(text or ""), None]:
            u = vocab.end if w is None else unit(w)
            s = (context[b] @ near + context[a] @ far) @ out.T + bias
            total += (s[u] - math.log(np.exp(s).sum())) / math.log(10)
            if w is not None and w not in own:
                total += math.log10((counts[w] + 1) / (held[u] + 1))
            a, b = b, u
        return total

    got = {(r.doc_id, r.n_tokens): r.score for r in columns(lbl.scores(docs(rows).repartition(3), **sizes))}
    assert len(got) == len(rows)
    for i, t in rows:
        assert abs(got[i, len(lbl.tokens(t or "")) + 1] - text_score(t)) < 1e-3 * (1 + abs(text_score(t)))


def test_the_model_learns_context_by_default(docs):
    got = columns(lbl.scores(docs(corpus(600))))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(2)
    model = lbl.Model.start(rng.integers(1, 100, 30).astype(float))
    model.unit[:] = rng.normal(0, 1, model.unit.shape)
    near, far, z = lbl.tables(spark, model)
    total = np.exp(near[None, :, :] + far[:, None, :] - z[:, :, None]).sum(axis=2)
    assert np.allclose(total, 1, atol=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(3)
    n = 20
    word = rng.integers(0, n, 20_000)
    rows = np.stack([np.zeros(len(word)), word, (word + 1) % n], axis=1).astype(np.int16)
    model = lbl.Model.start(np.full(n, 1000.0))
    noise = np.full(n, 1 / n)
    codes = (np.zeros(len(word), int) * (n + 1) + word) * (n + 1) + (word + 1) % n
    got = lbl.train(model, codes, np.ones(len(codes), np.float32), noise)

    def likelihood(m):
        made = m.context[rows[:500, 1]] @ m.near + m.context[rows[:500, 0]] @ m.far
        s = made @ m.unit.T + m.bias
        s = s - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True)) - s.max(1, keepdims=True)
        return s[np.arange(500), rows[:500, 2]].mean()

    assert likelihood(got) > likelihood(model) + 1


def test_odd_rows(odd):
    got = columns(lbl.scores(odd))
    assert len(got) == 11
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lbl.scores(odd.limit(0)).count() == 0


def test_nothing_to_learn_from(docs):
    only = next(i for i in range(50) if held_out(i))
    got = columns(lbl.scores(docs([(only, "some words here")])))
    same(got, base_scores([(only, "some words here")]))
