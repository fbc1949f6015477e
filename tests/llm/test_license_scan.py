"""Notices against bounded-error matching over whole texts, and base places word by word."""

from __future__ import annotations

import random
import re

import pytest
import regex

from accountlake.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def base_row(text):
    """Words, base places, first and last start, base labels."""
    words = words_of(text)
    starts, labels = [], set()
    for label, phrase in L.BASE:
        of = phrase.split()
        for i in range(len(words) - len(of) + 1):
            if words[i : i + len(of)] == of:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def all_labels(text, searched):
    """Labels of notices that match anywhere with their errors, by a search of the whole text."""
    joined = f" {' '.join(words_of(text))} "
    return ",".join(sorted({n.label for n in searched if regex.search(rf"(?<= )(?:{n.phrase}){{e<={n.errors}}}(?= )", joined)}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def damaged(rnd, phrase, edits):
    s = list(phrase)
    for _ in range(edits):
        at, kind = rnd.randrange(len(s)), rnd.randrange(3)
        if kind == 0:
            s[at] = rnd.choice("aeiox ")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rnd.choice("aeiox "))
    return "".join(s)


def texts(n, seed):
    rnd = random.Random(seed)
    filler = "the license of this mit work cc by public general creative commons free apache Ünit 2 0 Gnu".split()
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            parts += rnd.choices(filler, k=rnd.randint(0, 12))
            n = rnd.choice(L.notices())
            phrase = damaged(rnd, n.phrase, rnd.choice([0, 0, 1, n.errors, n.errors + 1]))
            parts.append(phrase.replace(" ", rnd.choice([" ", "\n", "-", ", "])) if rnd.random() < 0.7 else phrase.upper())
        out.append(rnd.choice([" ", ". ", "; "]).join(parts))
    return out


def collected(df):
    return {r["doc_id"]: r for r in L.digests(L.license_spans(df)).collect()}


def test_against_whole_texts(docs):
    rows = texts(500, 1)
    got = collected(docs(rows).repartition(4))
    searched = L.notices()
    for i, text in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_row(text)
        assert r["labels"] == all_labels(text, searched), text
        assert {*r["base_labels"].split(",")} <= {"", *r["labels"].split(",")}
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and (r["score"] == 1 or not r["base_labels"])


def test_spans_are_places_in_the_text(docs):
    rows = texts(200, 2)
    for r in L.license_spans(docs(rows)).collect():
        text, words, behind = rows[r["doc_id"]], words_of(rows[r["doc_id"]]), {}
        for s in r["spans"]:
            found = " ".join(words[s["first_word"] : s["last_word"] + 1])
            assert distance(found, s["phrase"]) == s["edits"] and abs(s["likeness"] - 1 + s["edits"] / len(s["phrase"])) < 1e-12
            assert " ".join(words_of(text[s["start"] : s["end"]])) == found
            assert s["first_word"] > behind.get(s["phrase"], -1)
            behind[s["phrase"]] = s["last_word"]


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT Licence.", "mit"),
    ("licensed under the Apache-License, version 2", "apache"),
    ("GNU Genral Public Licence v3", "gpl"),
    ("GNU Lesser General Public License", "lgpl"),
    ("CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("a bit licensed, the mitten license, accuse by mail", ""),
    ("ＭＩＴ license, mıt license, Kmit license", "mit"),
    ("mitlicense", "mit"),
])
def test_examples(docs, text, labels):
    assert collected(docs([text]))[0]["labels"] == labels


def test_own_notices_and_errors(docs):
    own = L.notices([("house", "for use in this house only")], base=(), per_error=5, most=6)
    got = L.license_spans(docs(["For usage in those houses only.", "for use in this house only", "for use"]), own).orderBy("doc_id").collect()
    assert [[(s["label"], s["edits"], s["base"]) for s in r["spans"]] for r in got] == [[("house", 5, False)], [("house", 0, False)], []]
    assert [n.errors for n in own] == [5] and [p for _, p in own[0].parts] == ["for ", "use ", "in th", "is h", "ouse", " only"]


def test_long_texts_take_linear_time(docs):
    rows = ["a" * 1_000_000, "mit license " * 90_000, "mit l icense " * 40_000, "public" * 200_000, "é" * 500_000, "gnu general " * 50_000]
    got = collected(docs(rows))
    assert [got[i]["n_base"] for i in range(6)] == [0, 90_000, 0, 0, 0, 0]
    assert got[1]["last_word"] == 179_998 and got[2]["labels"] == "mit" and got[4]["n_words"] == 1


def test_odd_rows(odd):
    got = L.digests(L.license_spans(odd)).collect()
    assert len(got) == 11 and all(r["score"] == 0 and r["labels"] == "" and r["first_word"] is None for r in got)
    assert sorted(r["n_words"] for r in got)[:3] == [0, 0, 0]
    assert L.digests(L.license_spans(odd.limit(0))).count() == 0
