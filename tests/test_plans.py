"""Shapes of physical plans: what reaches the scan, and no all-pairs joins."""

import os

import pytest

import __spark_entry__  # noqa: F401  registers all queries
from brindle.operators import search
from brindle.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_and_filters_reach_the_scan(spark):
    english = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'")
    text = plan(search.keyword_search(english, ["text", "source"], "license akia", mode="any").select("doc_id", "source"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text and "n_chars" not in text.split("ReadSchema", 1)[1]
    assert "struct<event_type:string,value:double>" in plan(catalog.QUERIES["tool_metrics"](spark, DATA))


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["dense_cosine_topk"](spark, DATA))
