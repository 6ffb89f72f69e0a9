"""Every query beside its DuckDB twin, and what its plan must not hold."""

import re
from pathlib import Path

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.views import view

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_sql_without_pairwise_joins(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert compare(df, duck, key) in ("", "both empty")


def test_sources_keep_to_the_rules():
    files = sorted((ROOT / "ripplemark").rglob("*.py"))
    every = "\n".join(p.read_text() for p in files)
    for banned in ("localCheckpoint", "crossJoin", "toPandas", ".rdd.map"):
        assert banned not in every
    # the training-data operators broadcast what they have checked the size of
    core = "\n".join(p.read_text() for p in files if "llm" not in p.parts)
    for banned in ("broadcast(", "toLocalIterator"):
        assert banned not in core


def test_texts_are_neither_shuffled_nor_written_again(spark, tmp_path):
    """A table in enough files is read where it lies; one in a single file is dealt out first, with the same rows."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    docs.repartition(16).write.parquet(f"{many}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{one}/documents.parquet")
    for name in ("files_old", "files_new", "files_moved"):
        near, dealt = view(spark, many, name), view(spark, one, name)
        assert "documents.parquet" in near.inputFiles()[0] and "Exchange" not in near._jdf.queryExecution().toString()
        assert "documents.parquet" not in dealt.inputFiles()[0]
        assert near.count() == dealt.count() and near.exceptAll(dealt).isEmpty()
