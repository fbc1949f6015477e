"""Texts of a megabyte without white space go through every operator in seconds."""

from __future__ import annotations

import random
import time

import pytest

from accountlake.llm import (
    exact_dedup, fingerprints, jaccard_join, lbl, license_scan, mixing, secret_scan, suffix_pieces, token_counts, toxicity,
)

SIZE = 1_000_000


def unbroken():
    rnd = random.Random(6)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    return ["a" * SIZE, "".join(rnd.choices("0123456789", k=SIZE)), "".join(rnd.choices(alphabet, k=SIZE)), "a_a_" * (SIZE // 4), "."
            * SIZE, "中" * (SIZE // 3)]


def score(spark, df):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    return toxicity.toxicity(df, labels)


OPERATORS = {
    "fingerprints": lambda spark, df: fingerprints.edit_report(df),
    "secrets": lambda spark, df: secret_scan.digests(secret_scan.secret_spans(df)),
    "mix": lambda spark, df: mixing.mix_report(df),
    "lbl": lambda spark, df: lbl.scores(df),
    "exact": lambda spark, df: exact_dedup.exact_copies(df),
    "pieces": lambda spark, df: suffix_pieces.piece_report(df),
    "jaccard": lambda spark, df: jaccard_join.near_copies(df),
    "tokens": lambda spark, df: token_counts.token_counts(df),
    "toxicity": score,
    "licenses": lambda spark, df: license_scan.digests(license_scan.license_spans(df)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_unbroken_texts(spark, docs, name):
    start = time.monotonic()
    assert len(OPERATORS[name](spark, docs(unbroken())).collect()) == 6
    assert time.monotonic() - start < 90
