"""The corpus pipeline: quality, lines, near duplicates, contamination, mix.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame.  A stage's result is written as Parquet in
the shared scratch folder and read again as the next stage's ``docs``; all
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agrisentinel.llm import op1_decontaminate, op3_mix, op5_line_templates, op6_nbsvm, op10_ngram_join
from agrisentinel.llm.tables import materialise, read_documents, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return op6_nbsvm.accepted(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; every document stays."""
    return op5_line_templates.keep_other_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return op10_ngram_join.keep_one_per_class(docs, shingle=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of ten words go."""
    return op1_decontaminate.uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return op3_mix.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix),
]

#: The classifier and the mix have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
