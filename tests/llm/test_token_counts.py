from __future__ import annotations

import json
import random

import pytest

from accountlake.llm import token_counts as tc

PARTS = ["a", "ß", " ", "  ", "\n", "\t", "\x1c", "\xa0", "　", "<|endoftext|>", "7", "!", "'s", "x", "é", "\x85", " b", "😀", "中", " the", "\r\n"]


FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tc.tokenizer_path(name))


def texts(n=4000):
    rnd = random.Random(1)
    return ["".join(rnd.choices(PARTS, k=rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(name):
    rows = texts() + ["Mit Ümläuten und ΣΑΣ ΣΑΣ", "e\u0301 e \u0301 \u0301", "A" * 5000 + " b" * 5000]
    want = [len(x.ids) for x in library(name).encode_batch(rows, add_special_tokens=False)]
    assert tc.Counter(tc.tokenizer_path(name)).counts(rows) == want
    small = tc.Counter(tc.tokenizer_path(name), batch_bytes=64, known_bytes=200)
    assert small.counts(rows) == want


def test_other_rules_get_whole_texts(tmp_path):
    """A special token that takes the space before it: a cut there would hide the space."""
    rules = json.loads(library().to_str())
    rules["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(rules))
    from tokenizers import Tokenizer

    rows = texts(1000)
    want = [len(x.ids) for x in Tokenizer.from_file(str(path)).encode_batch(rows, add_special_tokens=False)]
    assert tc.Counter(str(path)).counts(rows) == want
    assert tc.Counter(str(path)).cut("a b") == ["a b"] and tc.Counter(tc.tokenizer_path()).cut("a b") == ["a", " b"]


def test_pieces_join_to_the_text():
    for text in texts(500):
        assert "".join(tc.pieces(text)) == text


def test_table(docs):
    rows = ["", "a b", "word " * 3000]
    got = {r.doc_id: r for r in tc.token_counts(docs(rows)).collect()}
    tokenizer = library()
    for i, text in enumerate(rows):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len(text.encode()), n, n > 1024)


def test_odd_rows(odd):
    rows = tc.token_counts(odd).collect()
    assert len(rows) == 11 and all((r.n_tokens == 0) == (r.n_bytes == 0) for r in rows)
    assert tc.token_counts(odd.limit(0)).count() == 0
