from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

from accountlake.llm import secret_scan as ss

KEY = "aB3xK9pQ2vL7mZ4wT8yR1nC6"


def entropy(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def test_windows_against_counting_anew():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choices("abcdefghABC123"[: rnd.randint(2, 14)], k=rnd.randint(0, 60)))
        bits = rnd.choice([1.0, 2.0, 2.5, 3.0])
        inside = [False] * len(text)
        for i in range(len(text) - 9):
            if entropy(text[i : i + 10]) >= bits - 1e-9:
                inside[i : i + 10] = [True] * 10
        got = [False] * len(text)
        for a, b in ss.entropy_windows(text, 10, bits):
            got[a:b] = [True] * (b - a)
        assert got == inside


def plain(text):
    """The fixed patterns, tried one after the other over the whole text."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text,
                         re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def test_base_spans_against_the_plain_patterns(docs):
    rnd = random.Random(2)
    parts = ["password", "Api_Key", "apikey", "TOKEN", "secret", "=", ":", " ", '"', "'", "abcdef0123456789", "AKIA", "ABCD1234EFGH56",
             "é", "x.y", "deadbeef", "\n", "passwd", "short", "0123456789abc", "-", "/", "😀"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(400)]
    rows = {r.doc_id: r for r in ss.digests(ss.secret_spans(docs(texts))).collect()}
    for i, text in enumerate(texts):
        want = plain(text)
        written = ",".join(f"{ss.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in want) for x in range(3)]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_random_strings_are_added_and_allowed_ones_are_not(docs):
    texts = [f"see {KEY} there", f"https://example.org/{KEY}", "id 123e4567-e89b-12d3-a456-426614174000", f"sha256:{KEY}",
             "Donaudampfschifffahrtsgesellschaft", "thhethnonedtionerreorhaoning", f"password={KEY}", f"mail {KEY}@host.org"]
    rows = [r.spans for r in ss.digests(ss.secret_spans(docs(texts))).orderBy("doc_id").collect()]
    assert rows == ["entropy_base64:4:28", "entropy_base64:16:44", "", "", "", "", "assign:0:33", "entropy_base64:5:29"]


def added(docs, texts):
    """Texts of the added spans."""
    rows = ss.secret_spans(docs(texts)).orderBy("doc_id").collect()
    return [[t[s.start : s.end] for s in r.added] for t, r in zip(texts, rows, strict=True)]


def test_allowed_strings_hide_only_themselves(docs):
    key, uuid = "aB3xK9pQ2vL7mZ4wT8yR1nC6dE5f", "123E4567-e89b-12D3-a456-426614174000"
    texts = [
        '{"endpoint":"https://api.host.com/v1","key":"%s"}' % key, f"https://api.host.com/v1?sig={key}&x=1",
        f'<a href="https://host.org/a">{key}</a>', f"(https://host.org/a,{key})", f'{{"name":"example","k":"{key}"}}',
        f"sha256:{'0aB' * 20},{key}", f"a@b.org,{key}", f"/example/dir/{key}",
    ]
    for text, got in zip(texts, added(docs, texts), strict=True):
        assert len(got) == 1 and key in got[0], text
    quiet = [f"run-{uuid}", f"sha512-{key}==", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]
    assert added(docs, quiet) == [[]] * len(quiet)


def test_keys_in_addresses_are_found_and_addresses_are_not(docs):
    """Passwords of connection strings, keys as part of a path or as a mail name; not what addresses are made of."""
    key = "aB3xK9pQ2vL7mZ4wT8yR1nC6dE5f"
    texts = [
        f"postgres://app:{key}@db.host.com/x", f"https://app:{key}@host.com/x", f"https://hooks.host.com/services/T00/B11/{key}",
        f"https://host.org/a/{key}", f"https://host.org/v1/{key}/edit?x=1", f"https://host.org/a?token_id={key}", f"x{key}@host.org",
    ]
    for text, got in zip(texts, added(docs, texts), strict=True):
        assert len(got) == 1 and key in got[0], text
    quiet = [
        "https://www.example-host.org/2026/12/01/some-long-article-name-about-things.html#Section-Two",
        "https://en.host.org/wiki/Rechtsschutzversicherungsgesellschaft_(Disambiguation)", "http://127.0.0.1:8080/api/v2/users/1234567890123456",
        "first.last-name_of2026@mail.some-host.co.uk", "https://cdn.host.org/Assets/JavaScript/ModuleLoader-3.11.0.min.js?version=20261201",
    ]
    assert added(docs, quiet) == [[]] * len(quiet)


def test_texts_without_spaces_take_linear_time():
    rnd = random.Random(9)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    scanner = ss.Scanner()
    texts = [
        "a" * 1_000_000, "".join(rnd.choices(alphabet, k=1_000_000)), "a_a_" * 250_000, "".join(rnd.choices("0123456789", k=500_000)),
        "https://a.b/cd" * 40_000, "Ab1." * 200_000, "".join(f"{''.join(rnd.choices(alphabet, k=24))}@h.org," for _ in range(20_000)),
        "https://" * 60_000, "token=" * 100_000,
    ]
    for text in texts:
        start = time.process_time()
        scanner.scan(text)
        assert time.process_time() - start < 12, text[:20]


def test_keys_of_every_kind_and_length(docs):
    """Keys of one case, of letters only, and of 16 characters on; not the words and names of clean texts."""
    rnd = random.Random(7)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [lower + digits, upper + digits, lower + upper, lower + upper + digits]
    named = ["k3m9x7q2w8z5t1r6y4n0p3s7v2h8j5l9", "aB3xK9pQ2vL7mZ4wT8yR"]
    assert added(docs, [f"see {k}." for k in named]) == [[k] for k in named]
    for alphabet in kinds:
        for width, share in ((16, 0.65), (20, 0.8), (32, 0.95)):
            found = added(docs, ["use " + "".join(rnd.choices(alphabet, k=width)) + " here" for _ in range(100)])
            assert sum(map(bool, found)) >= share * 100, (alphabet, width)
    clean = [
        "Internationalization of counterrevolutionaries, Rechtsschutzversicherungsgesellschaften, COVID-19-Pandemie",
        "getElementsByTagNameAndClass JavaScriptModuleLoader AbstractBeanFactory INTERNATIONALIZATION UTF-8 ISO-8859-1",
        "20261201193502 2026-12-01T19:35:02 mother-in-law/father-in-law snake_case_names_are_long 1234567890123456",
    ]
    assert added(docs, clean) == [[]] * len(clean)


def test_odd_rows(odd):
    rows = ss.digests(ss.secret_spans(odd)).collect()
    assert len(rows) == 11 and {r.spans for r in rows} == {""}
    assert ss.digests(ss.secret_spans(odd.limit(0))).count() == 0
