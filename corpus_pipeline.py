"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from massweave.llm import bpe, jaccard_join, quality_mcd, tiling, toxicity_crf
from massweave.llm.common import drop, materialise, table
from massweave.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field predicts toxic go."""
    return toxicity_crf.keep_clean(docs, toxicity_crf.fit(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers go."""
    return quality_mcd.keep_inliers(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word shingle sets with a similarity of 0.8 or more the smallest id stays."""
    return jaccard_join.keep_one(docs, jaccard_join.Scheme(5, 80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return tiling.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: Training, iterated estimates and components can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        drop(before)  # the stage's own input is no longer read
    return docs
