"""Whitening against components computed in one place."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from accountlake.llm import whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], SCHEMA)


def plain(rows, k=8):
    """n, exact deviations, shares of the variance and whitened entries up to sign, from the whole matrix."""
    ids = [i for i, _ in rows]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = x * n - sums
    centred = (y / n).astype(float)
    # Of the rows, not of their covariance, whose small eigenvalues would lose half of their digits.
    _, sigma, v = np.linalg.svd(centred, full_matrices=False)
    e = sigma**2 / n
    return ids, n, [int(sum(c * c for c in row)) for row in y], (e / e.sum())[:k], centred @ v[:k].T / np.sqrt(e[:k])


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {i: sorted(rs, key=lambda r: r["component"]) for i, rs in out.items()}


def compare(df, rows, k=8):
    ids, n, deviations, shares, white = plain(rows, k)
    got = collected(whitening.report(df, k))
    assert sorted(got) == sorted(ids)
    entries = np.array([[r["whitened"] for r in got[i]] for i in ids])
    signs = np.sign((entries * white).sum(axis=0))
    assert np.abs(entries - white * signs).max() < 1e-6
    for i, d in zip(ids, deviations, strict=True):
        assert [r["component"] for r in got[i]] == list(range(1, min(k, white.shape[1]) + 1))
        assert {r["deviation"] for r in got[i]} == {d if d < 1 << 63 else None} and {r["n"] for r in got[i]} == {n}
        assert np.allclose([r["explained"] for r in got[i]], shares, rtol=1e-9)
        assert {r["identity_error"] for r in got[i]} == {got[ids[0]][0]["identity_error"]} and got[i][0]["identity_error"] < 1e-9


def test_against_the_covariance(vectors):
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(700, 20)) @ rng.normal(size=(20, 20)) * np.logspace(0, -3, 20)
    rows = list(enumerate(mixed))
    compare(vectors(rows).repartition(5), rows)


def test_ill_conditioned_columns(vectors):
    """Columns that all but repeat: eigenvalues over ten orders of magnitude."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 1)) * 1e5
    rows = list(enumerate(np.hstack([base + rng.normal(size=(400, 1)) * s for s in (0, 1e3, 10, 1, 0.1)])))
    compare(vectors(rows).repartition(3), rows, k=4)


def test_partial_sums_meet_in_a_tree(vectors, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    rows = list(enumerate(rng.normal(size=(90, 6))))
    compare(vectors(rows).repartition(9), rows)


def test_rows_that_are_dropped(spark, vectors):
    rng = np.random.default_rng(4)
    good = [(i, v) for i, v in enumerate(rng.normal(size=(50, 3)))]
    bad = [(100, None), (101, [1, None, 2]), (102, [1, math.nan, 2]), (103, [math.inf, 0, 0]), (104, []), (105, [1, 2]), (106, [1, 2, 3, 4])]
    df = vectors(good + bad).repartition(4)
    compare(df, good)
    clashing = df.selectExpr("vec_id", "embedding", "1 as key", "'x' as vector", "2 as n", "3 as EMBEDDING2", "array(1) as whitened", "label")
    compare(clashing.toDF(*[c if c != "label" else "EMBEDDING" for c in clashing.columns]), good)
    doubles = df.select("vec_id", df.embedding.cast("array<double>").alias("embedding"))
    compare(doubles, good)


def test_null_and_repeated_ids(vectors):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [3.0, -1.0]), (7, [0.5, 4.0])]
    got = whitening.report(vectors(rows)).collect()
    assert len(got) == 8 and sum(r["vec_id"] is None for r in got) == 4
    assert all(math.isfinite(r["whitened"]) for r in got)


def test_directions_without_variance(vectors):
    """Constant and repeated columns: components without variance have no entry and explain nothing."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 60))
    rows = [(i, [x, 5.0, x, y, x]) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    got = collected(whitening.report(vectors(rows).repartition(3)))
    for r in got.values():
        assert [x["whitened"] is None for x in r] == [False, False, True, True, True]
        assert abs(sum(x["explained"] for x in r) - 1) < 1e-9 and r[0]["identity_error"] < 1e-9
    ids, _, _, _, white = plain(rows, 2)
    entries = np.array([[x["whitened"] for x in got[i][:2]] for i in ids])
    assert np.abs(np.abs(entries) - np.abs(white)).max() < 1e-6


def test_equal_rows_and_one_row(vectors):
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)]):
        got = whitening.report(vectors(rows)).collect()
        assert len(got) == 2 * len(rows)
        assert all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 for r in got)


def test_large_entries_are_exact(vectors):
    """Sums beyond a long are exact; a deviation beyond a long is null."""
    rows = [(i, [1e9 * (i - 3), 2.0**i]) for i in range(7)]
    got = whitening.report(vectors(rows)).collect()
    assert len(got) == 14 and all((r["deviation"] is None) == (r["vec_id"] != 3) for r in got)
    assert all(math.isfinite(r["whitened"]) for r in got)
    huge = whitening.report(vectors([(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 1.5])])).collect()
    assert len(huge) == 6 and all(r["identity_error"] < 1e-4 for r in huge)


def test_without_vectors(vectors):
    assert whitening.report(vectors([])).count() == 0
    assert whitening.report(vectors([(1, None), (2, [])])).count() == 0
    assert whitening.report(vectors([])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
