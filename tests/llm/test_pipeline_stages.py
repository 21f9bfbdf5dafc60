"""Pipeline stages keep what is the user's: clashing columns, and rows of differing text."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from agrisentinel.llm import op9_separator_scan, op10_ngram_join
from conftest import SMALL

CLASHING = ["score", "held_out", "_margin", "hits", "n_hit", "n_items", "items", "n_words", "_tkey", "kept_text", "n_lines",
            "n_dropped", "gone", "lines", "hit", "cut", "row", "doc", "id", "component_id", "key", "_id", "_text", "_first"]


@pytest.mark.parametrize("name", ["quality_classifier", "line_dedup", "near_duplicates", "decontamination"])
def test_clashing_columns_keep_their_values(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, wide, SMALL)
    assert out.columns == wide.columns
    rows = out.collect()
    plain = {r.doc_id: r.text for r in stage(spark, docs, SMALL).collect()}
    assert {r.doc_id: r.text for r in rows} == plain
    assert all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in CLASHING)


def test_an_id_of_several_texts_loses_none(spark):
    base = [f"w{i} x{i}" for i in range(40)]
    one, near, other = " ".join(base), " ".join(base[:-1] + ["end"]), "quite another text of its own with ten words or so"
    rows = [(1, one, "a"), (1, other, "b"), (1, other, "c"), (5, near, "d"), (5, near, "d"), (7, "nothing like the others at all here", "e"),
            (None, one, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text, r.source) for r in op10_ngram_join.keep_one_per_class(docs).collect()), key=repr)
    assert got == sorted([(1, one, "a"), (1, other, "b"), (7, rows[5][1], "e"), (None, one, "f")], key=repr)


def test_token_counts_of_shuffled_frames(spark):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (i % 37))) for i in range(400)] + [(None, "word"), (3, "word word")],
                                 "doc_id long, text string")
    want = sorted(((r.doc_id, r.n_tokens) for r in op9_separator_scan.document_tokens(docs).collect()), key=repr)
    for frame in (docs.repartition(5), docs.orderBy(F.rand(3)), docs.distinct().union(docs.limit(0))):
        got = sorted(((r.doc_id, r.n_tokens) for r in op9_separator_scan.document_tokens(frame).collect()), key=repr)
        assert got == want
