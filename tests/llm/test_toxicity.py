from __future__ import annotations

import math
import random
import re
import time
import zlib

from pyspark.ml.linalg import DenseVector

from accountlake.llm import toxicity as tx


def labelled(spark, docs, words, n=400):
    rnd = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        text = words(rnd.randint(20, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                text.insert(rnd.randrange(len(text)), rnd.choice(["idiot", "you", "moron,", "1d1ot", "STUPID", "scum"]))
            text.insert(0, "pathetic")
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    return docs(rows), spark.createDataFrame(marks, "doc_id long, toxic int"), dict(marks)


def test_held_out_accuracy(spark, docs, words):
    table, labels, truth = labelled(spark, docs, words)
    rows = tx.toxicity(table, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark, docs, words):
    table, labels, _ = labelled(spark, docs, words, 200)
    swapped = labels.selectExpr(
        "doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = (sorted((r.doc_id, r.score) for r in tx.toxicity(table, x).collect()) for x in (labels, swapped))
    assert a == b


def test_words_are_learned_from_labels(spark, docs, words):
    """Toxic texts that only invented words give away; near copies of one text teach nothing."""
    rnd = random.Random(2)
    rows, marks = [], []
    copied = words(60)
    for i in range(600):
        text = words(60)
        if i % 5 == 0:
            for _ in range(3):
                text.insert(rnd.randrange(60), rnd.choice(["zorgel", "Quampf", "vilst"]))
        elif i % 5 == 1 and i % 2:
            text = [*copied, f"x{i}"]
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 5 == 0 or text[:60] == copied)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    learned = tx.learned_words(spark.createDataFrame(
        [(i % 2, float(m), t) for (i, m), (_, t) in zip(marks, rows, strict=True)], "fold int, label double, text string"))
    assert all({"zorgel", "quampf", "vilst"} == x for x in learned)
    got = {r.doc_id: r for r in tx.toxicity(docs(rows), labels).collect()}
    held = [i for i in got if got[i].held_out and i % 5 == 0]
    assert sum(got[i].predicted for i in held) >= 0.95 * len(held)
    assert not any(got[i].predicted for i in got if i % 5 > 1)


def test_scores_are_those_of_trees_and_steps_in_one_place(spark, docs, words):
    """Every tree walked and every step of the calibration interpolated here, over features counted word by word."""
    table, labels, _ = labelled(spark, docs, words, 240)
    scorer = tx.fit(table, labels)
    got = {r.doc_id: r.score for r in tx.toxicity(table, labels).collect()}
    trees = [(w, t) for w, t in zip(scorer.trees.treeWeights, scorer.trees.trees, strict=True)]
    steps = list(zip(scorer.calibration.boundaries.toArray(), scorer.calibration.predictions.toArray(), strict=True))

    def calibrated(p):
        if p <= steps[0][0]:
            return steps[0][1]
        for (x0, y0), (x1, y1) in zip(steps, steps[1:], strict=False):
            if p <= x1:
                return y1 if x1 == x0 else y0 + (y1 - y0) * (p - x0) / (x1 - x0)
        return steps[-1][1]

    for r in table.limit(60).collect():
        marks = tx.features(r.text, scorer.learned)
        found = [w for w in re.findall(r"\w+", r.text.lower())]
        assert marks[tx.FEATURES.index("learned")] == sum(w in scorer.learned for w in found)
        assert marks[tx.FEATURES.index("distinct_insults")] == len({w for w in found if w in tx.INSULTS and w not in scorer.learned} | {
            w for w in found if w in tx.INSULTS})
        margin = sum(w * t.predict(DenseVector(marks)) for w, t in trees)
        want = calibrated(1 / (1 + math.exp(-2 * margin)))
        assert abs(got[r.doc_id] - min(1.0, max(0.0, want))) < 1e-9


def test_few_labels_go_as_far_as_they_can(spark, docs, words):
    """Labels of both classes always give trees; a calibration where its part has both."""
    rnd = random.Random(8)
    rows = [(i, " ".join([*words(20), *(["idiot", "scum", "you"] if i % 3 == 0 else [])])) for i in range(24)]
    for n in (24, 9, 6):
        labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")
        scorer = tx.fit(docs(rows), labels)
        assert scorer.trees is not None
        scores = {r.doc_id: r.score for r in tx.toxicity(docs(rows), labels).collect()}
        assert min(scores[i] for i in scores if i % 3 == 0) >= max(scores[i] for i in scores if i % 3)
    one = spark.createDataFrame([(i, 1) for i in range(24)], "doc_id long, toxic int")
    assert tx.fit(docs(rows), one).trees is None and rnd


def test_texts_that_share_a_passage_teach_each(spark, words):
    """One passage in texts that differ otherwise does not make them one; reruns learn the same."""
    rnd = random.Random(4)
    passage = " ".join(words(8))
    rows = [(i % 2, float(i % 5 == 0), f"{passage} {' '.join(words(60))} {'zorgel vilst' if i % 5 == 0 else ''}") for i in range(400)]
    rows += rows[:100]
    table = spark.createDataFrame(rows, "fold int, label double, text string")
    first = tx.learned_words(table)
    assert all({"zorgel", "vilst"} <= x for x in first)
    rnd.shuffle(rows)
    assert tx.learned_words(spark.createDataFrame(rows, "fold int, label double, text string").repartition(5)) == first


def test_texts_without_spaces_take_linear_time():
    for text in ("a" * 1_000_000, "a_" * 500_000, "aB3x" * 250_000, "1" * 1_000_000, "a." * 300_000, "a....." * 150_000, "!" * 1_000_000):
        start = time.process_time()
        tx.features(text, frozenset({"x"}))
        assert time.process_time() - start < 8, text[:6]


def test_features():
    named = dict(zip(tx.FEATURES, tx.features("You IDIOT, you are a m0ron!! Go"), strict=True))
    assert named["insults"] == 2 and named["distinct_insults"] == 1 and named["nearness"] == 1.0
    assert named["obfuscated_per_100"] > 0 and named["capital_words"] > 0
    assert tx.features("") == [0.0] * len(tx.FEATURES)
    assert len(tx.features("x")) == len(tx.FEATURES)


def test_rejection_keeps_whole_rows(spark, docs, words):
    table, labels, truth = labelled(spark, docs, words)
    kept = tx.reject_toxic(table, labels)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, t in truth.items() if not t} <= ids
    assert len(ids) <= 302


def test_odd_rows(spark, odd):
    none = spark.createDataFrame([(None, 1), (1, None), (4, 1)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        rows = tx.toxicity(odd, labels).collect()
        assert len(rows) == 11 and all(r.score == 0 for r in rows)
        assert tx.reject_toxic(odd, labels).count() == 11
    assert tx.toxicity(odd.limit(0), none).count() == 0 and tx.reject_toxic(odd.limit(0), none).count() == 0
