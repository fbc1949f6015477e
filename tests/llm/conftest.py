from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def docs(spark):
    """Documents from texts, or from ``(doc_id, text[, source])``."""
    def build(rows):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if r is None or isinstance(r, str) else r
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")))
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture
def odd(spark, docs):
    """Nulls everywhere, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "one two three"), (None, None),
        (4, long), (5, long + " more"), (6, " \n\t "), (7, "Zoë 😀 ｗ▁x"), (1, "another text of id one"),
    ]
    sources = ["b", "b", None, "a", None, "c", "a", "é", "", "z", "b"]
    base = docs([(i, t, s) for (i, t), s in zip(rows, sources, strict=True)])
    extra = base.selectExpr(
        "doc_id", "text", "lang", "source", "n_chars", "cast(null as string) as score", "1 as size", "'x' as `row`",
        "array(1) as entry", "'y' as key", "2 as band", "'TEXT' as _0", "map('a', 1) as draw", "true as stays")
    # A column that differs from ``text`` in case only, under a name no resolver may guess at.
    return extra.toDF(*[c if c != "lang" else "TEXT" for c in extra.columns])


@pytest.fixture
def words():
    """A maker of pseudo-random words."""
    rnd = random.Random(5)
    stems = ["ra", "th", "on", "é", "ing", "ber", "qu", "st", "lo", "ña"]
    return lambda n: [("".join(rnd.choices(stems, k=rnd.randint(1, 4)))) for _ in range(n)]
