"""The pipeline, stage by stage, and its queries beside their SQL."""

from __future__ import annotations

import os

import pytest
from compare import both, connect

import corpus_pipeline as cp
from accountlake.llm import queries

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, con, name):
    _, _, problems = both(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF_DIR)
    assert not problems, problems


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(cp.STAGES) == 5


def test_stages(spark, docs, words, tmp_path):
    clean = [" ".join(words(60)) for _ in range(30)]
    near = clean[0].split()
    near[3] = "changed"
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate([*clean, clean[1], " ".join(near), "you stupid idiot " * 5, "", None])]
    folder = str(tmp_path)
    docs(rows).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 0) for i in range(30)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for _, stage in cp.STAGES[:3]:
        table = stage(spark, table, folder)
        assert table.columns == docs([]).columns
        seen.append({r.doc_id for r in table.collect()})
    toxic = len(clean) + 2
    # Labels of one class give no model; the lexicon alone rejects the insults.
    assert seen[0] == set(range(len(rows))) - {toxic}
    assert seen[1] == seen[0] - {1, toxic + 1}
    assert seen[2] == seen[1] - {31}
    mixed = cp.STAGES[3][1](spark, table, folder)
    assert mixed.columns == table.columns
    last = cp.STAGES[4][1](spark, mixed, folder)
    assert last.count() == mixed.count() and last.where("not same").count() == 0
    assert cp.run(spark, folder).count() == last.count()
