from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from samples import HOMEPAGE, NOW  # noqa: E402

from accountlake.spark import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column over one row of named values."""
    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
        return row.select(column.alias("x")).first()["x"]

    return evaluate


@pytest.fixture
def homepage():
    return HOMEPAGE


@pytest.fixture
def crawl(spark):
    def build(rows):
        schema = "url string, final_url string, status_code int, content_type string, html string, fetched_at timestamp"
        return spark.createDataFrame([(u, f or u, s, k, h, NOW) for u, f, s, k, h in rows], schema)

    return build
