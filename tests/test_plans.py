"""Plan-shape guards: pruning and pushdown reach the scan; no cartesian
products or nested-loop joins in queries that do not need them."""

import pytest

import __spark_entry__ as E
from agrisentinel.plans import QUERIES, load_all
from conftest import SMALL

load_all()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d5_group_size", "e1_union_keep_first", "j7_class_tfidf",
                                  "d19_cooccurrence", "g3_cosine_doc_topic", "d12_precision_recall_f1_auc",
                                  "j16_representative_docs", "i9_extractive_summary"])
def test_no_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_filter_and_columns_pushed_to_scan(spark):
    p = _plan(E.queries()["b17_offset_resume"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,758)]" in p
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in p


MODEL_FITS = ("m5_", "m6_", "m7_", "m8_", "m9_", "m10_", "m11_", "m12_", "c1_")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(MODEL_FITS)))
def test_every_query_free_of_cartesian_products(spark, name):
    p = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p, name
    assert "BroadcastNestedLoopJoin" not in p, name
