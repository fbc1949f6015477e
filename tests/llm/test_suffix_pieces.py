from __future__ import annotations

import random
import time

import numpy as np
import pytest

from accountlake.llm import suffix_pieces as sp


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.model_path())


@pytest.fixture(scope="module")
def vocab():
    return sp.vocabulary(sp.model_path())


PARTS = ["a", "ß", " ", "  ", "\n", "\t", "th", "ing", "er", "中", "😀", "7", "!", "'s", "é", "the ", " b", "Ж", "ция", "   ", "</s>",
         "<s>", "▁", "<0x41>", "ﬁ", "́", "\x00", "\xa0", "aaaa", "nnn", " " * 17, "ation", "ABC"]


def test_ids_are_the_librarys(vocab, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 30))) for _ in range(3000)]
    got = sp.Encoder(vocab, index_bytes=500).encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == library.encode(texts, num_threads=1)


def test_long_words(vocab, library, monkeypatch):
    """Words without spaces, over many stretches, as the library cuts them; a megabyte in seconds."""
    rnd = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    parts = [x for x in PARTS if not set(x) & set(" \n")]
    texts = ["".join(rnd.choices(parts, k=2_000)), "a" * 3_001, "ab_" * 1_500, "".join(rnd.choices(alphabet, k=5_000)),
             "Donaudampfschiff" * 300, "é" * 2_000, "x " + "thing" * 700 + " y", "中文" * 900]
    monkeypatch.setattr(sp, "STRETCH", 257)
    got = sp.Encoder(vocab).encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == library.encode(texts, num_threads=1)
    monkeypatch.undo()
    for text in ("".join(rnd.choices(alphabet, k=1_000_000)), "a" * 1_000_000, "a_a_" * 250_000):
        start = time.process_time()
        got = sp.Encoder(vocab).encode([text])[0]
        assert time.process_time() - start < 30
        assert np.frombuffer(got, "<i4").tolist() == library.encode(text, num_threads=1)


def test_words_of_few_letters(vocab, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abent ", k=rnd.randint(0, 40))) for _ in range(3000)]
    got = sp.Encoder(vocab).encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == library.encode(texts, num_threads=1)


def test_round_trip(docs, vocab):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices([p for p in PARTS if p != "▁"], k=20)) for _ in range(200)]
    back = sp.decoded(sp.encoded(docs(texts)))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_occurrences_against_find(vocab):
    text = np.frombuffer("the thing\xff".encode("latin-1"), np.uint8)
    places, ids = sp._occurrences(vocab, text)
    got = sorted((int(p), vocab.pieces[i]) for p, i in zip(places, ids, strict=True))
    used = {vocab.pieces[i] for i in vocab.matched}
    raw = text.tobytes()
    want = sorted((a, raw[a:b]) for a in range(9) for b in range(a + 1, 10) if raw[a:b] in used)
    assert got == want


def test_odd_rows(odd):
    rows = sp.piece_report(odd).collect()
    assert len(rows) == 11 and all(r.same for r in rows)
    assert {r.n_pieces for r in rows if r.n_chars == 0} == {0}
    assert sp.piece_report(odd.limit(0)).count() == 0
